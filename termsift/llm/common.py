"""What several operators share: written intermediate tables, splits and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.cluster import drop_scratch, may_broadcast, write_scratch

#: Documents whose texts are handed to numpy together: bounded by bytes, not by rows.
SLICE_BYTES = 1 << 20


#: Bytes of a batch that goes to Python while a table is written for later steps, and rows that a
#: task decodes of a file at once: the texts of a batch lie in one array of the executor's heap.
BATCH_BYTES, READ_ROWS = 2 << 20, 512
_SMALL = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS),
}

_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def stored(table: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The table, written to the shared scratch folder and read back: its lineage ends there.

    Inside ``scratch_dropped`` the folder goes at the end, unless the result still reads it.
    """
    path = written(table, name)
    folders = _folders.get()
    if folders is not None and not keep:
        folders.append(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def written(table: DataFrame, name: str) -> str:
    """Path of the table in the scratch folder; its rows went to Python in small batches."""
    spark = table.sparkSession
    usual = {option: spark.conf.get(option) for option in _SMALL}
    small_batches(spark)
    try:
        return write_scratch(table, name)
    finally:
        for option, value in usual.items():
            spark.conf.set(option, value)


def small_batches(spark: SparkSession) -> None:
    """From now on, rows of long texts or sets are read and go to Python in batches of few megabytes."""
    for option, value in _SMALL.items():
        spark.conf.set(option, value)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files of finished jobs are deleted with it."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Drop what ``stored`` writes meanwhile, whether the work ends well or not."""
    folders: list[str] = []
    token = _folders.set(folders)
    try:
        yield
    finally:
        _folders.reset(token)
        for path in folders:
            drop_scratch(spark, path)
        release_shuffles(spark)


def free_name(table: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {column.lower() for column in table.columns}:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_split(doc_id: Column, parts: int, held_out: int) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == held_out, F.lit(False))


def slices(values, size: Callable = len, limit: int = SLICE_BYTES):
    """Cut a list into runs of about ``limit`` bytes; a larger value is a run of its own."""
    run, held = [], 0
    for value in values:
        run.append(value)
        held += size(value)
        if held >= limit:
            yield run
            run, held = [], 0
    if run:
        yield run


_tool: dict[tuple, Any] = {}


def _release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def worker_tool(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, made once: one thing at a time.

    A worker serves all stages of an application. What the stage before has kept, a cache of words
    or of token ids, is given back to the system before the next one fills its own.
    """
    if key not in _tool:
        if _tool:
            _tool.clear()
            _release_memory()
        _tool[key] = make()
        _release_memory()  # of what making it took
    return _tool[key]


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches that keeps nothing in the worker, neither its own nor of earlier stages."""

    def run(batches: Iterator) -> Iterator:
        if _tool:
            _tool.clear()
            _release_memory()
        try:
            yield from step(batches)
        finally:
            _release_memory()

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table as (node, root): the root is the smallest node.

    Roots themselves and nodes without edges are not listed. Large-star and small-star rounds,
    which are joins and aggregates with map-side combining; no neighbourhood is gathered in one
    row, so a hub may hold any share of the edges. Each round is written to the scratch folder.
    """
    spark = edges.sparkSession
    pair = lambda hi, lo: (F.greatest(hi, lo).alias("hi"), F.least(hi, lo).alias("lo"))
    start = edges.select(*pair(F.col(a), F.col(b))).where("hi > lo").distinct()
    path = write_scratch(start, "edges")
    state = None
    while True:
        current = spark.read.schema(start.schema).parquet(path)
        sign = F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
        found = current.agg(F.count("*"), sign).first()
        if found == state:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = found
        # a table of edges of a checked size need not be shuffled for the joins
        side = F.broadcast if may_broadcast(found[0]) else lambda table: table
        both = current.union(current.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = both.join(side(least), "hi").where("lo > hi")
        large = large.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        middle = write_scratch(large, "edges")
        large = spark.read.schema(start.schema).parquet(middle)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(side(least), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.where("hi != lo").union(least.select("hi", "m")).distinct()
        following = write_scratch(small, "edges")
        drop_scratch(spark, path)
        drop_scratch(spark, middle)
        path = following
