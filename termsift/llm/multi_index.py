"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves and each half is quantised by its own codebook, so that a few
hundred centroids make a fine grid of cells. A query walks over pairs of centroids in the order of
their summed distance, taken from a heap, and the vectors of the cells it meets are reranked by
their inner product in double precision.

Nearness is the largest inner product, so the distance of a half from a centroid is their negative
inner product: its sum over both halves is what a vector at the centre of the cell would have.

How far a query walks is not a fixed number of cells or candidates. The inner products of a cell's
vectors with the query are about normal, with a mean and a variance that follow from the centroids
and the variances of their residuals; a query goes on until the cells it has met are expected to
hold all but ``MISSED`` of its nearest. In data with clusters that is soon, in data without any it is
half of the grid. The codebooks are fitted to a bounded sample, the grid holds every vector.

Copies of a vector are one entry with its smallest ids, one more than a query can return: no others
can be among the nearest. Entries are dealt into blocks of cells of bounded size; a block is held by
one task while the queries that meet it stream past, and returns only the best of each. By the same
estimate a query has a bound that a few times the wanted number should pass, so that what it gets
back does not grow with the blocks; queries for which the bound was too high go a second time
without one.

Nulls, ties, repeats: vectors that are null, empty, zero, hold null or non-finite components or have
another length than most, and rows without an id, take no part; equal scores are ordered by id;
rows with the same id are no candidates of each other, each of their vectors is a query and a
candidate, and repeated rows are one query; extra columns are ignored; an empty table gives an
empty table. A vector costs in proportion to its length, however long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termsift.cluster import may_broadcast
from termsift.llm.common import stored
from termsift.llm.vectors import finite_vectors, matrix

NEAREST = 20

#: Distinct vectors that the codebooks are fitted to, at most.
SAMPLE = 32_768

#: Vectors per cell that the number of centroids aims at, and centroids of a half at most.
PER_CELL, MOST_CENTROIDS = 16, 512

#: Rounds of refinement of a codebook.
ROUNDS = 10

#: Share of a query's nearest that is expected outside the cells it walks over.
MISSED = 0.05

#: Entries of a block that a task holds, about; and queries that are compared at once.
BLOCK, QUERIES = 1024, 256

#: A block returns what is beyond the bound that so many times the wanted ones are expected to pass.
PASSING = 5

#: Copies of a vector from which it is counted as common, and the parts its rows are dealt into.
COMMON, PARTS = 1000, 12

_ENTRY, _QUERY = 0, 1


class Grid(NamedTuple):
    """The codebooks of both halves, and how the vectors of a centroid scatter around it."""

    books: tuple[np.ndarray, np.ndarray]
    scatter: tuple[np.ndarray, np.ndarray]  # variance of the residuals, per centroid and dimension

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Number of the cell of each vector."""
        first, second = (nearest(h, book) for h, book in zip(halves(x), self.books, strict=True))
        return first * len(self.books[1]) + second

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves from the centroids."""
        return tuple(-(book @ h[0]) for h, book in zip(halves(query[None]), self.books, strict=True))

    def spread(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Variance of the inner products of a query's halves with the vectors of a centroid."""
        return tuple(s @ h[0] ** 2 for h, s in zip(halves(query[None]), self.scatter, strict=True))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return x[:, :half], x[:, half:]


def nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the centroid nearest to each row."""
    if not rows.shape[1]:
        return np.zeros(len(rows), np.int64)
    return np.argmin((book**2).sum(axis=1) - 2 * rows @ book.T, axis=1)


def codebook(rows: np.ndarray, centroids: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of rows by k-means from random ones, and the variances of their residuals."""
    book = rows[rng.choice(len(rows), centroids, replace=False)].copy()
    for last in [False] * ROUNDS + [True]:
        own = nearest(rows, book)
        count = np.maximum(np.bincount(own, minlength=centroids), 1)[:, None]
        sums = np.zeros_like(book)
        if last:
            np.add.at(sums, own, (rows - book[own]) ** 2)
            return book, sums / count
        np.add.at(sums, own, rows)
        book = np.where(np.bincount(own, minlength=centroids)[:, None] > 0, sums / count, book)
    raise AssertionError


def normal_below(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution below z, to seven places."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / np.sqrt(2))
    terms = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
    tail = np.zeros_like(z)
    for term in terms:
        tail = (tail + term) * t
    tail *= np.exp(-z * z / 2) / 2
    return np.where(z < 0, tail, 1 - tail)


class Odds(NamedTuple):
    """Mean and spread of the inner products of a query with the vectors of cells, and their number."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray

    def beyond(self, bound: float) -> np.ndarray:
        """How many of each cell are expected beyond a bound."""
        return self.weight * normal_below((self.mean - bound) / self.spread)

    def bound(self, number: float) -> float:
        """The inner product that so many are expected to pass."""
        low, high = float((self.mean - 9 * self.spread).min()), float((self.mean + 9 * self.spread).max())
        for _ in range(18):
            middle = (low + high) / 2
            low, high = (middle, high) if self.beyond(middle).sum() > number else (low, middle)
        return low


def odds(grid: Grid, counts: np.ndarray, query: np.ndarray) -> Odds:
    there = counts > 0
    pair = lambda parts: (parts[0][:, None] + parts[1][None])[there]
    mean = -pair(grid.distances(query))
    spread = np.sqrt(pair(grid.spread(query))) + 1e-9 * (1 + np.abs(mean))
    return Odds(mean, spread, counts[there])


def walk(
    grid: Grid, counts: np.ndarray, query: np.ndarray, wanted: int, missed: float = MISSED
) -> tuple[list[int], float]:
    """Cells with entries for a query, by summed distance, as far as it has to go; and its bound."""
    first, second = grid.distances(query)
    own = odds(grid, counts, query)
    hits = np.zeros(counts.shape)
    hits[counts > 0] = own.beyond(own.bound(wanted))
    enough = (1 - missed) * hits.sum()
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    d1, d2 = first[rows].tolist(), second[columns].tolist()
    hits, held = hits[np.ix_(rows, columns)].tolist(), counts[np.ix_(rows, columns)].tolist()
    number = (rows[:, None] * len(second) + columns[None]).tolist()
    out, met, seen = [], 0.0, 0
    heap = [(d1[0] + d2[0], 0, 0)]
    while heap:
        _, a, b = heapq.heappop(heap)
        if b + 1 < len(d2):
            heapq.heappush(heap, (d1[a] + d2[b + 1], a, b + 1))
        if not b and a + 1 < len(d1):
            heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
        if held[a][b]:
            out.append(number[a][b])
            met += hits[a][b]
            seen += held[a][b]
            if met >= enough and seen > wanted:
                break
    return out, own.bound(PASSING * wanted)


def fit_grid(entries: DataFrame, n: int, seed: int = 5) -> Grid:
    """Codebooks from a sample of the entries (vector)."""
    parts = 1 << 20
    share = min(1.0, 0.9 * SAMPLE / n)
    picked = entries.where(F.pmod(F.xxhash64("vector"), F.lit(parts)) < int(share * parts))
    rows = picked if share < 1 else entries
    x = matrix(rows.select("vector").limit(SAMPLE).toArrow()["vector"])
    rng = np.random.default_rng(seed)
    centroids = int(np.clip(np.ceil(np.sqrt(n / PER_CELL)), 1, min(MOST_CENTROIDS, len(x))))
    return Grid(*zip(*(codebook(half, centroids, rng) for half in halves(x)), strict=True))


# -- entries --------------------------------------------------------------------------------------


def _least_ids(rows: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("_number", number).where(F.col("_number") <= wanted).drop("_number")


def entries_of(rows: DataFrame, wanted: int) -> DataFrame:
    """Distinct vectors of (id, vector) with their ``wanted`` smallest ids, sorted.

    The rows of a vector with very many copies are dealt into parts first.
    """
    key = F.xxhash64("vector").alias("_key")
    counted = rows.groupBy(key).count().where(F.col("count") > COMMON).select("_key")
    common = stored(counted, "common_vectors")
    common = F.broadcast(common) if may_broadcast(common.count()) else common
    keyed = rows.withColumn("_key", F.xxhash64("vector"))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    many = keyed.join(common, "_key", "left_semi").withColumn("_part", part)
    many = _least_ids(many, ["vector", "_part"], wanted).select("id", "vector")
    few = keyed.join(common, "_key", "left_anti").select("id", "vector")
    least = _least_ids(few.unionByName(many), ["vector"], wanted)
    return least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _with_cells(entries: DataFrame, grid: Grid) -> DataFrame:
    shared = entries.sparkSession.sparkContext.broadcast(grid)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell = shared.value.cells(matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell, pa.int32())], names=[*part.schema.names, "cell"]
                )

    return entries.mapInArrow(assign, entries.select("*", F.lit(0).alias("cell")).schema)


class Blocks(NamedTuple):
    """Runs of rows of the grid: which block a row begins, and in how many blocks its run is dealt."""

    first: np.ndarray  # by row of the grid
    parts: np.ndarray


def blocks_of(counts: np.ndarray, size: int = BLOCK) -> Blocks:
    """Rows of the grid gathered to about ``size`` entries; a larger row is dealt into several."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block, held = 0, 0
    for row, n in enumerate(counts.sum(axis=1).tolist()):
        if held and held + n > size:
            block, held = block + parts[row - 1], 0
        first[row] = block
        parts[row] = max(1, -(-n // size)) if not held else 1
        held += n
        if held >= size:
            block, held = block + parts[row], 0
    return Blocks(first, parts)


# -- search ---------------------------------------------------------------------------------------


def _walks(
    queries: DataFrame, grid: Grid, counts: np.ndarray, blocks: Blocks, wanted: int, missed: float,
    bounded: bool,
) -> DataFrame:
    """Queries by the blocks they meet, with the cells they meet there."""
    shared = queries.sparkSession.sparkContext.broadcast((grid, counts, blocks))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, counts, blocks = shared.value
        width = counts.shape[1]
        for batch in batches:
            vectors = matrix(batch.column("vector"))
            for at in range(batch.num_rows):
                found, bound = walk(grid, counts, vectors[at], wanted, missed)
                cells = np.array(found)
                row = cells // width
                block, inside = np.unique(blocks.first[row], return_inverse=True)
                order = np.argsort(inside, kind="stable")
                ends = np.cumsum(np.bincount(inside))
                own = np.split(cells[order], ends[:-1])
                # a row that is dealt into several blocks is met in all of them
                parts = np.maximum.reduceat(blocks.parts[row][order], np.concatenate(([0], ends[:-1])))
                target = np.concatenate([b + np.arange(p) for b, p in zip(block, parts, strict=True)])
                lists = [own[k] for k, p in enumerate(parts) for _ in range(p)]
                one = batch.slice(at, 1)
                taken = pa.array(np.zeros(len(target), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(target, pa.int32()), pa.array(np.full(len(target), _QUERY), pa.int32()),
                        one.column("vector").take(taken), one.column("ids").take(taken),
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array(np.full(len(target), bound if bounded else -np.inf)),
                    ],
                    names=["block", "kind", "vector", "ids", "cells", "bound"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    ids = queries.schema["ids"].dataType.simpleString()
    return queries.mapInArrow(go, f"block int, kind int, vector {kind}, ids {ids}, cells array<int>, bound double")


def _pick(scores: np.ndarray, allowed: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) of all that may be among the best of a query, rounding errors included."""
    scores = np.where(allowed, scores, -np.inf)
    if scores.shape[1] > wanted:
        least = np.partition(scores, scores.shape[1] - wanted, axis=1)[:, scores.shape[1] - wanted]
        least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
        return np.nonzero((scores >= least[:, None]) & allowed)
    return np.nonzero(allowed)


def best_of(
    queries: np.ndarray, own: np.ndarray, bound: np.ndarray, allowed: np.ndarray, entries: np.ndarray,
    ids: list[np.ndarray], wanted: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best ``wanted`` candidates of each query that pass its bound.

    The query's own id is none of them.
    """
    scores = queries @ entries.T
    allowed = allowed & (scores >= bound[:, None])
    # one entry may hold nothing but the query's own id
    q, e = _pick(scores, allowed, wanted + 1)
    parts = [np.arange(0)], [np.arange(0)], [np.zeros(0)]
    for at in range(0, len(q), 1 << 16):
        # summed row by row, so that copies have the very same score wherever they stand
        exact = (queries[q[at : at + (1 << 16)]] * entries[e[at : at + (1 << 16)]]).sum(axis=1)
        sizes = np.array([len(ids[k]) for k in e[at : at + (1 << 16)]])
        parts[0].append(np.repeat(q[at : at + (1 << 16)], sizes))
        parts[1].append(np.concatenate([ids[k] for k in e[at : at + (1 << 16)]]))
        parts[2].append(np.repeat(exact, sizes))
    query, candidate, score = (np.concatenate(p) for p in parts)
    other = candidate != own[query]
    query, candidate, score = query[other], candidate[other], score[other]
    order = np.lexsort((candidate, -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    starts = np.searchsorted(query, np.arange(len(queries)))
    keep = np.arange(len(query)) - starts[query] < wanted
    return query[keep], candidate[keep], score[keep]


def _rerank(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, entries before queries: the best of every query in every block."""
    block, vectors, ids, cells = None, [], [], []
    entries = cell = names = None
    for batch in batches:
        number = batch.column("block").to_numpy()
        kind = batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
            if start == end:
                continue
            if number[start] != block:
                block, vectors, ids, cells, entries = int(number[start]), [], [], [], None
            for at in range(start, end, QUERIES):
                part = batch.slice(at, min(QUERIES, end - at))
                own_ids = part.column("ids")
                if kind[start] == _ENTRY:
                    vectors.append(matrix(part.column("vector")))
                    ids += [np.array(i, np.int64) for i in own_ids.to_pylist()]
                    cells.append(np.array([c[0] for c in part.column("cells").to_pylist()], np.int64))
                    continue
                if not vectors:
                    continue
                if entries is None:
                    entries = np.concatenate(vectors)
                    names, cell = np.unique(np.concatenate(cells), return_inverse=True)
                met = part.column("cells").to_pylist()
                rows = np.repeat(np.arange(len(met)), [len(m) for m in met])
                flat = np.concatenate([np.array(m, np.int64) for m in met])
                place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                hit = names[place] == flat
                visited = np.zeros((len(met), len(names)), bool)
                visited[rows[hit], place[hit]] = True
                own = np.array([i[0] for i in own_ids.to_pylist()], np.int64)
                queries = matrix(part.column("vector"))
                bound = part.column("bound").to_numpy()
                query, candidate, score = best_of(
                    queries, own, bound, visited[:, cell], entries, ids, wanted
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[query]), part.column("key").take(pa.array(query)),
                        pa.array(candidate), pa.array(score),
                    ],
                    names=["query_id", "key", "vec_id", "score"],
                )


def nearest_neighbours(
    embeddings: DataFrame, is_query: Column, id_column: str = "vec_id", column: str = "embedding",
    wanted: int = NEAREST, missed: float = MISSED,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found for each row that ``is_query``."""
    table = embeddings.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("vector"), is_query.alias("_query")
    )
    rows, _ = finite_vectors(table.where("id is not null"), "vector")
    rows = rows.where(F.exists("vector", lambda c: c != 0))
    entries = stored(entries_of(rows.select("id", "vector"), wanted + 1), "entries")
    n = entries.count()
    if not n:
        return embeddings.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double"
        )
    grid = fit_grid(entries, n)
    entries = stored(_with_cells(entries, grid), "cells")
    width = len(grid.books[1])
    counts = np.zeros((len(grid.books[0]), width))
    found = entries.groupBy("cell").count().toArrow()
    counts.ravel()[found["cell"].to_numpy()] = found["count"].to_numpy()
    blocks = blocks_of(counts.astype(np.int64))
    start = F.array(*[F.lit(int(k)) for k in blocks.first])
    parts = F.array(*[F.lit(int(k)) for k in blocks.parts])
    row = (F.col("cell") / width).cast("int")
    dealt = F.get(start, row) + F.pmod(F.xxhash64("vector"), F.get(parts, row)).cast("int")
    held = entries.select(
        dealt.cast("int").alias("block"), F.lit(_ENTRY).alias("kind"), "vector", "ids",
        F.array("cell").alias("cells"),
    )
    held = held.withColumn("bound", F.lit(None).cast("double"))
    queries = rows.where("_query").select("vector", F.array("id").alias("ids")).distinct()
    queries = stored(queries.withColumn("key", F.xxhash64("vector")), "queries")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")

    def ranked(some: DataFrame, bounded: bool) -> DataFrame:
        walks = _walks(some.select("vector", "ids"), grid, counts, blocks, wanted, missed, bounded)
        both = held.unionByName(walks).withColumn("key", F.xxhash64("vector"))
        dealt = both.repartition("block").sortWithinPartitions("block", "kind")
        best = dealt.mapInArrow(
            lambda batches: _rerank(batches, wanted), "query_id bigint, key bigint, vec_id bigint, score double"
        )
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)

    found = stored(ranked(queries, True), "nearest")
    # the bound was too high for queries that have too few; theirs are sought without one
    full = found.where(F.col("rank") == wanted).select(F.array("query_id").alias("ids"), "key")
    rest = stored(queries.join(full, ["ids", "key"], "left_anti"), "rest")
    if not rest.isEmpty():
        short = rest.select(F.element_at("ids", 1).alias("query_id"), "key")
        found = found.join(short, ["query_id", "key"], "left_anti").unionByName(ranked(rest, False))
    return found.select("query_id", "rank", "vec_id", "score")
