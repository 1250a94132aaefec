"""Whitening of embeddings by a covariance that is weighted with multiplicities.

Every component is put on a grid of whole numbers. Rows with equal grid vectors are one group, and
everything is computed once for a group: the covariance is a centred product of matrices in which
a group weighs as many times as it has rows (or once, with ``weighted=False``), and each distinct
vector is whitened once before the results are joined back to the rows.

Sums of whole numbers are exact. Tasks add up products of the groups they hold, Spark adds up the
tasks; the driver sees one covariance, whose size is that of a vector squared. A group may hold
any share of the rows: groups are counted before the shuffle, and the join back broadcasts the
groups of more than a thousandth of the rows, of which there are fewer than a thousand.

Nulls, ties, repeats: rows whose vector is null, empty or holds null or non-finite entries go, and
those of another length than most; rows without an id or with the same id are whitened each for
itself; extra columns are ignored; an empty table gives an empty table. Vectors have no texts, and
very long ones cost their length squared. Directions without variance (eigenvalue below 1e-12 of the
largest) cannot be whitened and are no components, so a table of equal vectors gives no row. The
sign of a component is that its largest entry is positive. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsift.llm.common import stored
from termsift.llm.vectors import finite_vectors, matrix

#: The grid: a component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000

#: Components returned at most.
COMPONENTS = 32

#: A group with more rows than this share of all is joined by broadcast.
HOT_SHARE = 1000

#: Eigenvalues below this share of the largest are no variance.
LEAST_VARIANCE = 1e-12

_SAFE = 1 << 62
_SLICE = 4096


class Whitening(NamedTuple):
    """What whitens a grid vector."""

    n: int
    sums: list[int]  # per dimension, exact
    directions: np.ndarray  # a column per component
    variances: np.ndarray  # eigenvalues of the components
    trace: float


def grid_vectors(embeddings: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """Rows that can be whitened, as (id, x) of whole numbers, and their number of dimensions."""
    rows, size = finite_vectors(embeddings.select(id_column, column), column)
    x = F.transform(column, lambda c: F.floor(SCALE * c.cast("double")) + F.lit(SHIFT).cast("bigint"))
    return rows.select(F.col(id_column).alias("id"), x.alias("x")), size


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _exact(x: np.ndarray, weight: int) -> np.ndarray:
    """The same numbers in a type in which ``weight`` of them can be added up."""
    largest = max(abs(int(x.max())), abs(int(x.min())), 1) if x.size else 1
    return x if largest * max(weight, 1) < _SAFE else x.astype(object)


def exact_sums(groups: DataFrame, size: int) -> tuple[int, list[int]]:
    """Weight of all groups (x, weight) and their weighted sum per dimension, exact at any size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * size
        for batch in _slices(batches):
            weight = batch.column("weight").to_numpy()
            x = _exact(matrix(batch.column("x"), np.int64), int(weight.sum()))
            total += int(weight.sum())
            sums = [a + int(b) for a, b in zip(sums, (x * weight[:, None]).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(size)], pa.int32()), pa.array([str(s) for s in (total, *sums)])],
            names=["dim", "part"],
        )

    parts = groups.mapInArrow(add, "dim int, part string")
    parts = parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    found = {row["dim"]: int(row["s"]) for row in parts}
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision: the whole part of the mean goes first, without rounding."""
    whole = np.array([s // n for s in sums], dtype=object)
    rest = np.array([(s % n) / n for s in sums])
    if all(abs(w) < _SAFE for w in whole) and (not x.size or np.abs(x).max() < _SAFE):
        return (x - whole.astype(np.int64)).astype(float) - rest
    return (x.astype(object) - whole).astype(float) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2 for each row, exact; None beyond 64 bits."""
    whole = [s // n for s in sums]
    if all(abs(w) < _SAFE for w in whole) and x.size and np.abs(x).max() < _SAFE:
        near = x - np.array(whole, np.int64)
        reach = (int(np.abs(near).max()) + 1) * n
        if reach * reach * x.shape[1] < _SAFE:
            off = n * near - np.array([s % n for s in sums], np.int64)
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [value if value < 1 << 63 else None for value in exact]


def _summed_products(table: DataFrame, column: str, size: int, make) -> np.ndarray:
    """Weighted sum of the products of rows ``make(column)`` with themselves: one matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in _slices(batches):
            y = make(batch.column(column))
            total += (y * batch.column("weight").to_numpy()[:, None]).T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    parts = table.mapInArrow(multiply, "i int, j int, v double")
    out = np.zeros((size, size))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def fit_whitening(groups: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit to distinct vectors (x, weight); None where there are none."""
    n, sums = exact_sums(groups, size)
    if not n:
        return None
    covariance = _summed_products(
        groups, "x", size, lambda x: centred(matrix(x, np.int64), n, sums)
    ) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_VARIANCE * max(values.max(), 0)]
    chosen = vectors[:, order]
    largest = np.abs(chosen).argmax(axis=0)
    signs = np.sign(chosen[largest, np.arange(chosen.shape[1])])
    return Whitening(n, sums, chosen * signs, values[order], float(np.trace(covariance)))


def whiten_groups(groups: DataFrame, model: Whitening) -> DataFrame:
    """Distinct vectors with their ``deviation`` and ``whitened`` vector."""
    scaled = model.directions / np.sqrt(model.variances)
    n, sums = model.n, model.sums

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = matrix(batch.column("x"), np.int64)
            if not len(x):
                continue
            whitened = centred(x, n, sums) @ scaled
            width = np.arange(0, whitened.size + 1, max(whitened.shape[1], 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("x"), batch.column("count"), batch.column("weight"),
                    pa.array(deviations(x, n, sums), pa.int64()),
                    pa.ListArray.from_arrays(width, whitened.ravel()),
                ],
                names=["x", "count", "weight", "deviation", "whitened"],
            )

    return groups.mapInArrow(
        whiten, "x array<bigint>, count bigint, weight bigint, deviation bigint, whitened array<double>"
    )


def identity_error(whitened: DataFrame, n: int, size: int) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity."""

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in _slices(batches):
            total += batch.column("weight").to_numpy() @ matrix(batch.column("whitened"))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "v"])

    mean = np.zeros(size)
    parts = whitened.mapInArrow(means, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    for row in parts.collect():
        mean[row["i"]] = row["v"] / n
    covariance = _summed_products(whitened, "whitened", size, lambda w: matrix(w) - mean) / n
    return float(np.abs(covariance - np.eye(size)).max())


def whiten(
    embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding",
    components: int = COMPONENTS, weighted: bool = True,
) -> tuple[DataFrame, Whitening | None, float]:
    """Rows (id, deviation, whitened), the fitted model, and its identity error."""
    rows, size = grid_vectors(embeddings, id_column, column)
    weight = F.col("count") if weighted else F.lit(1).cast("bigint")
    groups = stored(rows.groupBy("x").count().withColumn("weight", weight), "grid_groups")
    model = fit_whitening(groups, size, components)
    if model is None or not len(model.variances):
        nothing = groups.limit(0).select(F.lit(0).cast(rows.schema["id"].dataType).alias("id"))
        nothing = nothing.select(
            "id", F.lit(0).cast("bigint").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")
        )
        return nothing, model, 0.0
    whitened = stored(whiten_groups(groups, model), "whitened")
    error = identity_error(whitened, model.n, len(model.variances))
    # fewer than HOT_SHARE groups can hold more than that share of the rows each
    total = groups.agg(F.sum("count")).first()[0]
    hot = F.col("count") * HOT_SHARE > total
    columns = ["id", "deviation", "whitened"]
    common = F.broadcast(whitened.where(hot).select("x", "deviation", "whitened"))
    others = whitened.where(~hot).select("x", "deviation", "whitened")
    of_common = rows.join(common, "x").select(*columns)
    of_others = rows.join(F.broadcast(whitened.where(hot).select("x")), "x", "left_anti").join(others, "x")
    return of_common.unionByName(of_others.select(*columns)), model, error


def whitened_components(embeddings: DataFrame) -> DataFrame:
    """One row per row of ``embeddings`` and component, with what the whole table says of both."""
    rows, model, error = whiten(embeddings)
    explained = (model.variances / model.trace).tolist() if model and len(model.variances) else [0.0]
    shares = F.array(*[F.lit(value) for value in explained])
    spread = rows.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return spread.select(
        F.col("id").alias("vec_id"),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
