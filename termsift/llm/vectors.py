"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type = float) -> np.ndarray:
    """A column of lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def finite_vectors(table: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows whose vector is whole and finite, and the length they have.

    Null and empty vectors and those with null or non-finite components go. Vectors of different
    lengths cannot be told apart by one covariance or one distance: the length that most rows have
    stays, the smaller one of two that are as frequent.
    """
    good = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = table.where(F.col(column).isNotNull() & (F.size(column) > 0) & good)
    sizes = whole.groupBy(F.size(column).alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    size = most["size"] if most else 0
    return whole.where(F.size(column) == size), size
