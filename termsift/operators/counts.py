"""Word counts and words by prefix."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termsift.cluster import write_scratch
from termsift.functions.words import line_words, term_prefix, text_lines


def split_lines(texts: DataFrame) -> DataFrame:
    """Lines of ``texts(text)`` as ``lines(value)``."""
    return texts.select(F.explode(text_lines(F.col("text"))).alias("value"))


def split_words(lines: DataFrame) -> DataFrame:
    """Words of ``lines(value)``, one row each."""
    return lines.select(F.explode(line_words(F.col("value"))).alias("word"))


def word_count(words: DataFrame) -> DataFrame:
    """How often each ``word`` occurs. Counted before the shuffle, so common words do no harm."""
    return words.groupBy("word").agg(F.count("*").alias("n"))


def terms_by_prefix(terms: DataFrame, *by: str) -> DataFrame:
    """Search words of ``terms(term)`` as a sorted set per prefix, and per ``by`` if given.

    For the words of queries: a group is never larger than the words of what it is grouped by. For
    the words of a whole index, whose prefixes have no bound, see ``term_chunks``.
    """
    return terms.groupBy(*by, term_prefix(F.col("term")).alias("prefix")).agg(
        F.sort_array(F.collect_set("term")).alias("terms")
    )


def term_chunks(terms: DataFrame, most: int = 1000) -> DataFrame:
    """Distinct words of ``terms(term)`` by prefix, ``(prefix, terms)``, at most so many in a row.

    The words are dealt by range, so that a prefix of very many is cut into sorted runs that
    several tasks make; a run ends at the end of a task, too.
    """
    distinct = terms.select("term").distinct().withColumn("prefix", term_prefix(F.col("term")))
    spark = terms.sparkSession
    path = write_scratch(distinct, "terms")  # finding the ranges takes a pass of its own
    distinct = spark.read.schema(distinct.schema).parquet(path)
    dealt = distinct.repartitionByRange("prefix", "term").withColumn("_task", F.spark_partition_id())
    order = Window.partitionBy("_task", "prefix").orderBy("term")
    run = F.floor((F.row_number().over(order) - 1) / most).alias("_run")
    runs = dealt.select("prefix", "term", "_task", run).groupBy("_task", "prefix", "_run")
    return runs.agg(F.sort_array(F.collect_list("term")).alias("terms")).select("prefix", "terms")
