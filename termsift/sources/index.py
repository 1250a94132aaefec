"""The inverted index, the article files and their ranges as written tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.cluster import drop_scratch, listed_by_few, path_exists, write_scratch
from termsift.functions.words import letter_runs, term_prefix
from termsift.schemas import ARTICLE_FILES, POSTINGS

#: Postings per task when the index is written: few enough that a task sorts them in memory.
ROWS_PER_TASK = 2_000_000

#: Sorted ids are written as differences, about a tenth of their plain size for a common term.
_POSTINGS_ENCODING = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#doc_id": "false",
}


def build_postings(articles: DataFrame) -> DataFrame:
    """Inverted index of ``articles(doc_id, content)``: one row per document and distinct term.

    Distinct inside the row, hence without a shuffle.
    """
    return articles.select(
        F.explode(F.array_distinct(letter_runs(F.col("content")))).alias("term"), "doc_id"
    ).withColumn("prefix", term_prefix(F.col("term")))


def tasks_for(spark: SparkSession, postings: int) -> int:
    """How many tasks so many postings are dealt to; none of them has to spill what it sorts."""
    return max(spark.sparkContext.defaultParallelism, -(-postings // ROWS_PER_TASK))


def kept_postings(postings: DataFrame) -> DataFrame:
    """Postings written to a scratch folder, for steps that read them more than once.

    The texts are cut into words once, and the written rows are counted without reading them.
    """
    path = write_scratch(postings.select("term", "doc_id", "prefix"), "postings")
    return postings.sparkSession.read.schema(POSTINGS).parquet(path)


def write_postings(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write postings as Parquet, one folder per prefix, sorted by term and document.

    Partitioned by range over prefix, term and document: a common prefix or term is spread over as
    many tasks as its share of the rows asks for, a rare one gets one small file, and every row
    group covers few terms, so that a filter on ``term`` skips the rest.

    Finding the ranges takes a sampling pass. The postings are written to a scratch folder first,
    so that the texts are cut into words once and not once per pass.
    """
    spark = postings.sparkSession
    scratch = write_scratch(postings.select("term", "doc_id", "prefix"), "postings")
    try:
        rows = spark.read.schema(POSTINGS).parquet(scratch)
        tasks = tasks_for(spark, rows.count())
        # Hashed, so that the many rare prefixes, one small file each, do not gather in a few tasks.
        ranged = rows.repartitionByRange(tasks, F.xxhash64("prefix"), "term", "doc_id")
        ordered = ranged.sortWithinPartitions("prefix", "term", "doc_id")
        writer = ordered.write.mode(mode).options(**_POSTINGS_ENCODING).partitionBy("prefix")
        writer.parquet(path)
    finally:
        drop_scratch(spark, scratch)


def read_postings(spark: SparkSession, path: str, words: list[str] | None = None) -> DataFrame:
    """Written postings, all of them or those of some words.

    With words, only the folders of their prefixes are listed and only row groups that may hold
    the words are read. A word without a folder has no postings.
    """
    reader = spark.read.schema(POSTINGS).option("basePath", path)
    if words is None:
        return reader.parquet(path)
    prefixes = sorted({word[:2] for word in words})
    folders = [f"{path}/prefix={prefix}" for prefix in prefixes]
    folders = [folder for folder in folders if path_exists(spark, folder)]
    if not folders:
        return spark.createDataFrame([], POSTINGS)
    return filter_terms(reader.parquet(*folders), words)


def filter_terms(postings: DataFrame, words: list[str]) -> DataFrame:
    """Postings of some words. The prefix is filtered too, since it is what prunes folders."""
    prefixes = sorted({word[:2] for word in words})
    return postings.where(F.col("prefix").isin(prefixes) & F.col("term").isin(words))


def write_articles(
    articles: DataFrame, path: str, ids_per_file: int = 100_000, mode: str = "errorifexists"
) -> None:
    """Write articles as Parquet, one folder ``file=part_N`` per run of consecutive ids.

    Files are sorted by id, so that the bounds of a search skip row groups.
    """
    # integers all along: a quotient in floating point is wrong for ids beyond 2^53
    number = F.expr(f"(doc_id - pmod(doc_id, {ids_per_file}L)) DIV {ids_per_file}L").cast("string")
    placed = articles.withColumn("file", F.concat(F.lit("part_"), number))
    placed = placed.hint("rebalance", "file").sortWithinPartitions("file", "doc_id")
    placed.write.mode(mode).partitionBy("file").parquet(path)


def read_article_files(spark: SparkSession, path: str) -> DataFrame:
    """Written articles with their ``file``. Their folders are listed here, once."""
    with listed_by_few(spark):
        return spark.read.schema(ARTICLE_FILES).parquet(path)


def build_file_ranges(articles: DataFrame) -> DataFrame:
    """The ids each file holds: ``(file, begin_id, end_id)`` of ``articles(file, doc_id)``."""
    return articles.groupBy("file").agg(
        F.min("doc_id").alias("begin_id"), F.max("doc_id").alias("end_id")
    )
