"""Posting lists in blocks: one row per term and run of ids.

A block names its first and last id and holds its ids as offsets from the first. A list with many
ids is cut at multiples of a power of two, chosen for the term so that a block has about
``IDS_PER_BLOCK`` of them; a list with fewer ids is one block (two if it has negative ids as well). The
block of an id is thus known without looking, and a search opens only blocks that can hold an id it
asks for.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.cluster import drop_scratch, join_lookup, may_broadcast, path_exists, write_scratch
from termsift.schemas import BLOCKS
from termsift.sources.index import filter_terms, kept_postings, tasks_for

#: Ids of a block, on the average of its term.
IDS_PER_BLOCK = 512

#: Blocks of terms that have fewer ids: all of them from zero upwards, and all below.
_WHOLE = 62

_BLOCKS_ENCODING = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#offsets.list.element": "false",
    "parquet.enable.dictionary#first_id": "false",
    "parquet.enable.dictionary#last_id": "false",
}


def build_blocks(postings: DataFrame, ids_per_block: int = IDS_PER_BLOCK) -> DataFrame:
    """Postings (prefix, term, doc_id) as blocks; repeated postings count once.

    The postings are written to a scratch folder, since they are counted before they are cut. Then one
    shuffle of them, by term and block, so that a term with a third of all rows is spread over its
    blocks. It comes before anything is gathered: gathering sorts all postings of a task, which spills
    where a task reads a large piece of the texts, while the dealt parts have a known size. Only terms of
    more than one block are looked up for their cuts.
    """
    keys = ["prefix", "term"]
    spark = postings.sparkSession
    postings = kept_postings(postings)
    counted = postings.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")
    )
    span = F.col("_high").cast("double") - F.col("_low").cast("double") + 1
    shift = F.ceil(F.log2(span * ids_per_block / F.col("_n")))
    shift = F.greatest(F.lit(0), F.least(F.lit(_WHOLE), shift)).cast("int").alias("shift")
    cuts = counted.where(F.col("_n") > ids_per_block).select(*keys, shift)
    path = write_scratch(cuts, "cuts")
    cuts = spark.read.schema(cuts.schema).parquet(path)
    text = F.sum(F.octet_length("term") + F.octet_length("prefix"))
    rows, text_bytes = cuts.agg(F.count("*"), text).first()
    small = may_broadcast(rows, text_bytes or 0)
    cut = join_lookup(postings.select(*keys, "doc_id"), cuts, keys, small, "doc_id", how="left")
    cut = cut.withColumn("shift", F.coalesce("shift", F.lit(_WHOLE)))
    block = F.expr("shiftright(doc_id, shift)").alias("_block")
    tasks = tasks_for(spark, postings.count())
    dealt = cut.select("*", block).repartition(tasks, *keys, "shift", "_block")
    # a number in front, so that the sort in which ids are gathered rarely compares terms
    dealt = dealt.withColumn("_hash", F.xxhash64(*keys, "_block"))
    ids = F.sort_array(F.collect_set("doc_id")).alias("_ids")
    gathered = dealt.groupBy("_hash", *keys, "shift", "_block").agg(ids)
    first = F.element_at("_ids", 1)
    return gathered.select(
        "term",
        "shift",
        first.alias("first_id"),
        F.element_at("_ids", -1).alias("last_id"),
        F.size("_ids").alias("n"),
        F.transform("_ids", lambda i: i - first).alias("offsets"),
        "prefix",
    )


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write blocks as Parquet, one folder per prefix, sorted by term and first id."""
    spark = blocks.sparkSession
    scratch = write_scratch(blocks.select(*BLOCKS.names), "blocks")
    try:
        rows = spark.read.schema(BLOCKS).parquet(scratch)
        ids = rows.agg(F.sum("n")).first()[0] or 0
        tasks = tasks_for(spark, ids)
        ranged = rows.repartitionByRange(tasks, F.xxhash64("prefix"), "term", "first_id")
        ordered = ranged.sortWithinPartitions("prefix", "term", "first_id")
        writer = ordered.write.mode(mode).options(**_BLOCKS_ENCODING).partitionBy("prefix")
        writer.parquet(path)
    finally:
        drop_scratch(spark, scratch)


def read_blocks(spark: SparkSession, path: str, words: list[str] | None = None) -> DataFrame:
    """Written blocks, all of them or those of some words; only folders of their prefixes are listed."""
    reader = spark.read.schema(BLOCKS).option("basePath", path)
    if words is None:
        return reader.parquet(path)
    folders = [f"{path}/prefix={prefix}" for prefix in sorted({word[:2] for word in words})]
    folders = [folder for folder in folders if path_exists(spark, folder)]
    if not folders:
        return spark.createDataFrame([], BLOCKS)
    return filter_terms(reader.parquet(*folders), words)


def block_postings(blocks: DataFrame) -> DataFrame:
    """The postings in some blocks: ``(term, doc_id, prefix)``."""
    ids = blocks.select("term", "prefix", "first_id", F.explode("offsets").alias("_offset"))
    return ids.select("term", (F.col("first_id") + F.col("_offset")).alias("doc_id"), "prefix")
