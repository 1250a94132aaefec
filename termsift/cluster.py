"""Small helpers that depend on the session: folders, parallelism and size checks."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size up to which a table may be broadcast. Every caller measures before it broadcasts.
BROADCAST_BYTES = 64 << 20

#: What a row of a few numbers takes in a broadcast table, texts aside.
_ROW_BYTES = 64

#: Rows of a piece, about, into which a common key is cut when the other side is too large to
#: broadcast; and pieces at most.
PIECE_ROWS, MOST_PIECES = 1_000_000, 1024


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Path of a new folder for a written table, under the cluster's checkpoint folder.

    A machine-local folder serves only a local session that names none, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        return f"{tempfile.mkdtemp(prefix='termsift-')}/{name}"
    return f"{root.rstrip('/')}/termsift-{uuid.uuid4().hex}/{name}"


def write_scratch(table: DataFrame, name: str) -> str:
    """Write a table that is needed more than once to a scratch folder, and return its path."""
    path = scratch_dir(table.sparkSession, name)
    table.write.parquet(path)
    return path


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this package once nothing reads it any more."""
    files, folder = _file_system(spark, path)
    files.delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _file_system(spark, path)
    return files.exists(folder)


def rename_folders(spark: SparkSession, path: str, mark: str, target: str) -> None:
    """Move the folders ``<mark><name>`` of a path to ``<target>/<name>``."""
    files, folder = _file_system(spark, path)
    join = spark._jvm.org.apache.hadoop.fs.Path
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(mark) and not files.rename(status.getPath(), join(f"{target}/{name[len(mark):]}")):
            raise OSError(f"{name} could not be renamed to {target}")


#: Tasks a core, at most, that list the folders of a table.
LISTING_TASKS = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Tables that are opened meanwhile have their folders listed by a few tasks a core.

    Spark runs a task for each folder, up to 10,000, and starting one takes longer than listing
    a folder of a file or two.
    """
    usual = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, LISTING_TASKS * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(_LISTING, usual)


def spread(table: DataFrame) -> DataFrame:
    """Use every core on an input that is cut into fewer pieces than there are cores.

    A file with a single row group is one task however many cores are idle. Inputs with at least
    one piece per core, that is every large one, are returned unchanged and are not shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def may_broadcast(rows: int, text_bytes: int = 0) -> bool:
    """Whether a table of so many rows, with so many bytes of text in all, may be broadcast."""
    return rows * _ROW_BYTES + text_bytes <= BROADCAST_BYTES


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: list[str], small: bool, salt_by: str,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join of many rows with a lookup table, safe for keys that hold most rows.

    A lookup that was found small is broadcast and the rows stay where they are. A larger one is
    joined by a shuffle. The rows of each key are counted for it, and a key with many is cut into
    as many pieces as it has use for; only the lookups of such keys are copied.
    """
    if small:
        return rows.join(F.broadcast(lookup), keys, how)
    cut = common_keys(rows, keys)
    if cut is None:
        return rows.join(lookup, keys, how)
    pieces = F.coalesce("_pieces", F.lit(1))
    salted = rows.join(cut, keys, "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(salt_by), pieces).cast("int"))
    copies = lookup.join(cut, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    joined = salted.drop("_pieces").join(copies.drop("_pieces"), [*keys, "_salt"], how)
    return joined.drop("_salt")


def common_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more rows than a piece, and their ``_pieces``; None where there are none.

    Counted before the shuffle. There is less than one such key for every ``PIECE_ROWS`` rows.
    """
    pieces = F.ceil(F.col("count") / PIECE_ROWS).cast("int")
    counted = rows.groupBy(*keys).count().where(F.col("count") > PIECE_ROWS)
    counted = counted.select(*keys, F.least(pieces, F.lit(MOST_PIECES)).alias("_pieces"))
    spark = rows.sparkSession
    cut = spark.read.schema(counted.schema).parquet(write_scratch(counted, "common"))
    n = cut.count()
    return (F.broadcast(cut) if may_broadcast(n) else cut) if n else None
