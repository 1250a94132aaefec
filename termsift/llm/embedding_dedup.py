"""Near-duplicates among embeddings by a random-projection tree forest.

Vectors of one label are split again and again by random directions, in several trees. A split
lies where few vectors are near it, and those that are go to both sides, so that near vectors stay
together in nearly every tree. Vectors that meet in a leaf are compared exactly; a pair is counted
in the first of the leaves that hold both. Equal vectors are one class and are compared once.

Splits are fitted to a bounded sample of each node, round by round until every node is small; all
vectors are sent through. A node that no direction can split is a dense ball of near-duplicates:
it stays a leaf and is compared in tiles of two blocks. A leaf returns one row per vector, its
number of links and one link towards the others of its group, and never the pairs.

Nulls, ties, repeats: vectors that are null, zero, or hold null or non-finite components link with
nothing, nor do those without a label or of another length; equal vectors, also rows with the same
vec_id, are linked; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termsift.llm.common import components, stored

THRESHOLD = 0.93
TREES = 8

#: Nodes up to this size are leaves; larger leaves are compared in blocks of this size.
LEAF = 512

#: Vectors that a node's splits are fitted to, about; and the levels of splits fitted at once.
SAMPLE, LEVELS = 2048, 6

#: Nodes that are split in one round: their splits are broadcast, 40 MB for 64 dimensions.
ROUND_NODES = 1024

#: Directions tried for a split, and the share of a node that a part of it may hold at most.
DIRECTIONS, MAX_PART = 12, 0.85

_SPLITS = (
    "node bigint, left array<int>, right array<int>, threshold array<double>,"
    " direction array<double>, dense array<boolean>"
)
_LINKS = "cid bigint, links bigint, other bigint"


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow on the way."""
    rows = np.asarray(rows, float)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def spill_width(dim: int, threshold: float = THRESHOLD) -> float:
    """Half the usual distance, along a direction, of two vectors just at the threshold."""
    return 0.5 * np.sqrt(2 - 2 * threshold) / np.sqrt(dim)


def _best_split(x: np.ndarray, width: float, rng: np.random.Generator):
    """(direction, threshold) with the fewest vectors near it; None if no part gets much smaller."""
    best, n = None, len(x)
    for direction in rng.normal(size=(DIRECTIONS, x.shape[1])):
        direction /= np.linalg.norm(direction)
        along = np.sort(x @ direction)
        inner = along[int(0.2 * n) : int(0.8 * n) + 1]
        below = np.searchsorted(along, inner + width, "right") / n
        above = 1 - np.searchsorted(along, inner - width) / n
        cost = np.where(np.maximum(below, above) <= MAX_PART, below + above, 9)
        k = int(np.argmin(cost + 0.2 * np.abs(below - above)))
        if cost[k] < 9 and (best is None or cost[k] < best[0]):
            best = (cost[k], direction, float(inner[k]))
    return best and best[1:]


def build_splits(
    x: np.ndarray, size: float, seed: int, threshold: float = THRESHOLD, leaf: int = LEAF
) -> tuple:
    """Splits of a node of ``size`` vectors from a sample of unit vectors.

    Arrays by node of the small tree: left and right child (-1: none), threshold, direction, and
    whether it can't be split further.
    """
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    width, scale = spill_width(x.shape[1], threshold), size / len(x)
    left, right, cut, direction, dense = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        own, level, parent, is_right = todo.pop()
        k = len(left)
        if parent >= 0:
            (right if is_right else left)[parent] = k
        for column, value in ((left, -1), (right, -1), (cut, 0.0), (dense, False)):
            column.append(value)
        direction.append(np.zeros(x.shape[1]))
        if len(own) * scale <= leaf or level >= LEVELS or (level and len(own) < 64):
            continue
        found = _best_split(x[own], width, rng)
        if found is None:
            dense[k] = True
            continue
        way, at = found
        cut[k], direction[k] = at, way
        along = x[own] @ way
        todo.append((own[along >= at - width], level + 1, k, True))
        todo.append((own[along <= at + width], level + 1, k, False))
    return left, right, cut, np.array(direction), dense


def _child(node: int, k: int) -> int:
    """Id of a part of a node: 64 mixed bits."""
    h = (node ^ (k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 31
    return h - (1 << 64) if h >> 63 else h


def _route(x: np.ndarray, splits: tuple, node: int, width: float):
    """(rows, id, dense) of every part of a node that rows of unit vectors go to."""
    left, right, cut, direction, dense = splits
    todo = [(np.arange(len(x)), 0)]
    while todo:
        own, k = todo.pop()
        if not len(own):
            continue
        if left[k] < 0:
            yield own, _child(node, k), dense[k]
            continue
        along = x[own] @ direction[k]
        todo.append((own[along <= cut[k] + width], left[k]))
        todo.append((own[along >= cut[k] - width], right[k]))


def _split_once(state: DataFrame, oversize: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """Send the vectors of the nodes in ``oversize`` (node, size) on to the parts of these nodes."""
    spark = state.sparkSession

    def build(table: pa.Table) -> pa.Table:
        node, size = table["node"][0].as_py(), table["size"][0].as_py()
        order = np.argsort(table["cid"].to_numpy(), kind="stable")
        found = build_splits(_unit(_matrix(table["x"]))[order], size, node, threshold, leaf)
        left, right, cut, direction, dense = found
        return pa.Table.from_arrays(
            [
                pa.array([node], pa.int64()), pa.array([left], pa.list_(pa.int32())),
                pa.array([right], pa.list_(pa.int32())), pa.array([cut], pa.list_(pa.float64())),
                pa.array([direction.ravel()], pa.list_(pa.float64())),
                pa.array([dense], pa.list_(pa.bool_())),
            ],
            names=["node", "left", "right", "threshold", "direction", "dense"],
        )

    mark = F.pmod(F.xxhash64("cid", "node"), F.lit(1 << 30))
    sample = (
        state.select("cid", "x", F.explode("open").alias("node"))
        .join(F.broadcast(oversize), "node")
        .where(mark * F.col("size") < F.lit(float(SAMPLE << 30)))
    )
    fitted = sample.groupBy("node").applyInArrow(build, _SPLITS).collect()
    shared = spark.sparkContext.broadcast({
        r["node"]: (
            r["left"], r["right"], r["threshold"],
            np.array(r["direction"]).reshape(len(r["left"]), -1), r["dense"],
        )
        for r in fitted
    })

    def send(batches):
        for batch in batches:
            opened, closed = batch.column("open").to_pylist(), batch.column("closed").to_pylist()
            dims = batch.column("x").value_lengths().to_numpy()
            now: list[list] = [[] for _ in opened]
            by_node: dict[int, list[int]] = {}
            for row, nodes in enumerate(opened):
                for node in nodes:
                    if node in shared.value:
                        by_node.setdefault(node, []).append(row)
                    else:
                        now[row].append(node)
            for dim in np.unique(dims[[r for rows in by_node.values() for r in rows]].astype(int)).tolist():
                own = np.flatnonzero(dims == dim)
                x = _unit(_matrix(batch.column("x").take(pa.array(own))))
                place = np.full(len(opened), -1)
                place[own] = np.arange(len(own))
                for node, rows in by_node.items():
                    if dims[rows[0]] != dim:
                        continue
                    width = spill_width(dim, threshold)
                    parts = _route(x[place[rows]], shared.value[node], node, width)
                    for part, child, dense in parts:
                        for k in part.tolist():
                            (closed if dense else now)[rows[k]].append(child)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("cid", "copies", "x")),
                    pa.array(now, pa.list_(pa.int64())), pa.array(closed, pa.list_(pa.int64())),
                ],
                names=["cid", "copies", "x", "open", "closed"],
            )

    return state.mapInArrow(send, state.schema)


def forest(
    classes: DataFrame, trees: int = TREES, threshold: float = THRESHOLD, leaf: int = LEAF
) -> DataFrame:
    """Classes with the leaves they are in: ``open`` small ones, ``closed`` dense ones.

    ``classes`` has ``cid, copies, x`` and ``root``, which only vectors to be compared share.
    """
    roots = F.array(*[F.xxhash64("root", F.lit(k)) for k in range(trees)])
    none = F.array().cast("array<bigint>")
    state = stored(
        classes.select("cid", "copies", "x", roots.alias("open"), none.alias("closed")), "forest"
    )
    while True:
        sizes = state.select(F.explode("open").alias("node")).groupBy("node")
        large = sizes.agg(F.count("*").alias("size")).where(F.col("size") > leaf)
        large = large.orderBy("node").limit(ROUND_NODES)
        rows = [(r["node"], r["size"]) for r in large.collect()]
        if not rows:
            return state
        oversize = state.sparkSession.createDataFrame(rows, "node bigint, size bigint")
        state = stored(_split_once(state, oversize, threshold, leaf), "forest")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of every member's group, by links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    while (root[root] != root).any():
        root = root[root]
    return root


def compare_leaf(
    leaf: int, cid: np.ndarray, copies: np.ndarray, x: np.ndarray, leaves: list[list[int]],
    second: np.ndarray, threshold: float = THRESHOLD,
) -> tuple[np.ndarray, np.ndarray]:
    """Per member: copies it links with here, and the smallest member of its group.

    ``second`` marks members of the second block of a tile; all-equal means one block. A pair
    that shares a smaller leaf id than this one is found there.
    """
    n = len(cid)
    linked = _unit(x) @ _unit(x).T >= threshold
    np.fill_diagonal(linked, False)
    if second.any() and not second.all():
        linked &= second[:, None] != second
    earlier = [[v for v in each if v < leaf] for each in leaves]
    seen, repeats = np.unique([v for each in earlier for v in each], return_counts=True)
    column = {v: k for k, v in enumerate(seen[repeats > 1].tolist())}
    if column:
        holds = np.zeros((n, len(column)), np.float32)
        for row, each in enumerate(earlier):
            holds[row, [column[v] for v in each if v in column]] = 1
        own = linked & (holds @ holds.T == 0)
    else:
        own = linked
    a, b = np.nonzero(np.triu(own))
    return own @ copies, _roots(n, a, b)


def link_classes(
    state: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF
) -> DataFrame:
    """Links of the classes in their leaves: (cid, links, other), a few rows per class."""
    every = F.concat("open", "closed").alias("leaves")
    rows = state.select("cid", "copies", "x", "open", "closed", every)
    columns = ["cid", "copies", "x", "leaves", "leaf", "first", "last", "block"]
    zero = F.lit(0)
    small = rows.withColumn("leaf", F.explode("open")).select(
        *columns[:5], zero.alias("first"), zero.alias("last"), zero.alias("block")
    )
    dense = rows.withColumn("leaf", F.explode("closed"))
    blocks = dense.groupBy("leaf").agg(F.ceil(F.count("*") / leaf).cast("int").alias("blocks"))
    dense = dense.join(blocks, "leaf")
    dense = dense.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dense = dense.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dense = dense.withColumn("first", F.least("block", "partner")).withColumn(
        "last", F.greatest("block", "partner")
    )

    def compare(table: pa.Table) -> pa.Table:
        copies, cid = table["copies"].to_numpy(), table["cid"].to_numpy()
        second = table["block"].to_numpy() != table["first"].to_numpy()
        links, root = compare_leaf(
            table["leaf"][0].as_py(), cid, copies, _matrix(table["x"]),
            table["leaves"].to_pylist(), second, threshold,
        )
        there = links > 0
        return pa.Table.from_arrays(
            [pa.array(cid[there]), pa.array(links[there].astype(np.int64)), pa.array(cid[root][there])],
            names=["cid", "links", "other"],
        )

    tiles = small.union(dense.select(*columns))
    return tiles.groupBy("leaf", "first", "last").applyInArrow(compare, _LINKS)


def _usable(x: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF
) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    x = F.col("embedding")
    rows = embeddings.select("vec_id", "label", x.alias("x"))
    usable = F.col("label").isNotNull() & _usable(F.col("x"))
    keys = [F.xxhash64("label", "x").alias("k1"), F.xxhash64(F.lit(1), "x", "label").alias("k2")]
    usable_rows = rows.where(usable)
    classes = (
        usable_rows.groupBy("label", "x")
        .agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
        .withColumn("root", F.xxhash64("label", F.size("x")))
        .where("cid is not null")
    )
    classes = stored(classes.select("cid", "copies", "x", "root", *keys), "classes")
    found = stored(link_classes(forest(classes, trees, threshold, leaf), threshold, leaf), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    group = components(found.where("cid != other"), "cid", "other")
    result = (
        classes.select("cid", "copies", "k1", "k2")
        .join(links, "cid", "left")
        .join(group.withColumnRenamed("node", "cid"), "cid", "left")
        .select(
            "k1", "k2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "cid").alias("component_id"),
        )
    )
    by_class = rows.select(
        "vec_id", *[F.when(usable, key).alias(name) for key, name in zip(keys, ("k1", "k2"), strict=True)]
    )
    return by_class.join(result, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
