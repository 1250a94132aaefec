"""Text sources: plain lines, index lines, article lines and the range file."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.cluster import drop_scratch, path_exists, rename_folders
from termsift.functions.words import term_prefix
from termsift.schemas import FILE_RANGES, LINES
from termsift.sources.index import kept_postings, tasks_for

# Fixed value: name of an index shard of text lines, followed by the prefix of its terms.
INDEX_SHARD = "invertedindex_"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as ``value``."""
    return spark.read.text(path)


# -- index lines: "term docId docId ..." ------------------------------------------------------


def _index_fields(lines: DataFrame) -> DataFrame:
    fields = F.split(F.regexp_replace("value", r"\s+$", ""), r"\s+")
    return lines.select("value", fields.alias("_fields")).select(
        "value",
        F.element_at("_fields", 1).alias("term"),
        F.slice("_fields", F.lit(2), F.size("_fields")).alias("_ids"),
    )


def parse_postings(lines: DataFrame) -> DataFrame:
    """Index lines as postings; a term may have many lines and all of them count.

    Ids that are no numbers are left out; ``bad_index_lines`` shows where they are.
    """
    return (
        _index_fields(lines)
        .select("term", F.explode("_ids").alias("_id"))
        .select("term", F.expr("try_cast(_id AS bigint)").alias("doc_id"))
        .where("doc_id IS NOT NULL")
        .withColumn("prefix", term_prefix(F.col("term")))
    )


def bad_index_lines(lines: DataFrame) -> DataFrame:
    """Index lines that hold an id which is no number."""
    wrong = F.exists("_ids", lambda i: i.try_cast("bigint").isNull())
    return _index_fields(lines).where(wrong).select("value")


def index_lines(postings: DataFrame, ids_per_line: int = 1000) -> DataFrame:
    """Postings as index lines, ``(prefix, value)``.

    A term gets one line per run of ``ids_per_line`` consecutive ids, so a line stays short
    however common its term is; readers merge the lines of a term.
    """
    rows = kept_postings(postings)
    tasks = tasks_for(rows.sparkSession, rows.count())
    dealt = _with_run(rows, ids_per_line).repartition(tasks, "prefix", "term", "_run")
    return _gathered(dealt).select("prefix", "value")


def _with_run(postings: DataFrame, ids_per_line: int) -> DataFrame:
    run = F.expr(f"(doc_id - pmod(doc_id, {ids_per_line}L)) DIV {ids_per_line}L")
    return postings.withColumn("_run", run)


def _gathered(dealt: DataFrame, *more: str) -> DataFrame:
    """Lines of postings that were dealt by prefix, term, run and ``more``, where they lie.

    Dealt before they are gathered: gathering sorts all postings of a task, which spills where a task
    reads a large piece of the texts, while the dealt parts have a known size. A number comes first, so
    that the sort rarely compares terms.
    """
    ids = F.sort_array(F.collect_set("doc_id")).cast("array<string>")
    keys = ["prefix", "term", "_run"]
    dealt = dealt.withColumn("_hash", F.xxhash64(*keys))
    gathered = dealt.groupBy("_hash", *more, *keys).agg(ids.alias("_ids"))
    return gathered.withColumn("value", F.concat_ws(" ", "term", "_ids"))


def write_index_shards(postings: DataFrame, path: str, ids_per_line: int = 1000) -> None:
    """Write postings as text shards, one folder per prefix; fails when the path exists.

    One job writes all shards below a hidden folder, with large prefixes cut into several files and
    lines sorted; each shard then gets its name by a rename, and none of them is there half. The
    postings, written to a scratch folder for that, are dealt once, by ranges of prefix, term and run:
    lines are gathered, sorted and written where they lie.
    """
    spark = postings.sparkSession
    if path_exists(spark, path):
        raise FileExistsError(path)
    rows = kept_postings(postings)
    # hashed, so that the many rare prefixes, one small file each, do not gather in a few tasks
    dealt = _with_run(rows, ids_per_line).withColumn("_shard", F.xxhash64("prefix"))
    dealt = dealt.repartitionByRange(tasks_for(spark, rows.count()), "_shard", "term", "_run")
    lines = _gathered(dealt, "_shard")
    lines = lines.select("value", F.concat(F.lit(INDEX_SHARD), "prefix").alias("shard"))
    hidden = f"{path}/_writing"
    try:
        lines.sortWithinPartitions("shard", "value").write.partitionBy("shard").text(hidden)
        rename_folders(spark, hidden, "shard=", path)
    finally:
        drop_scratch(spark, hidden)


def read_index_shards(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Postings of some words from text shards; only the shards of their prefixes are opened.

    A prefix without a shard has no postings.
    """
    prefixes = sorted({word[:2] for word in words})
    shards = [f"{path}/{INDEX_SHARD}{prefix}" for prefix in prefixes]
    shards = [shard for shard in shards if path_exists(spark, shard)]
    lines = read_lines(spark, shards) if shards else spark.createDataFrame([], LINES)
    return parse_postings(lines).where(F.col("term").isin(words))


# -- article lines: "docID,URL,title,content" -------------------------------------------------


def _article_fields(lines: DataFrame) -> DataFrame:
    carried = [c for c in lines.columns if c != "value"]
    fields = lines.select("value", *carried, F.split("value", ",", 4).alias("_fields"))
    text: dict[str, Column] = {
        name: F.get("_fields", F.lit(i)) for i, name in enumerate(("url", "title", "content"), 1)
    }
    return fields.select(
        "value",
        F.get("_fields", F.lit(0)).try_cast("bigint").alias("doc_id"),
        *[column.alias(name) for name, column in text.items()],
        *carried,
        (F.size("_fields") > 1).alias("_has_comma"),
    )


def parse_articles(lines: DataFrame) -> DataFrame:
    """Article lines as articles. The content keeps its commas; missing fields are null.

    Further columns of ``lines`` are kept. Lines without a comma or without a numeric id are left
    out, see ``bad_article_lines``.
    """
    good = _article_fields(lines).where("_has_comma AND doc_id IS NOT NULL")
    return good.drop("value", "_has_comma")


def bad_article_lines(lines: DataFrame) -> DataFrame:
    """Article lines without a comma or without a numeric id."""
    return _article_fields(lines).where("NOT _has_comma OR doc_id IS NULL").select("value")


def article_lines(articles: DataFrame) -> DataFrame:
    """Articles as article lines; line breaks inside an article become blanks."""
    text = [F.regexp_replace(c, r"[\r\n]", " ") for c in ("url", "title", "content")]
    return articles.select(F.concat_ws(",", F.col("doc_id").cast("string"), *text).alias("value"))


def read_articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Articles from text files, with the name of the ``file`` each one is in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_articles(lines)


# -- range file: "fileName,begin,end" ---------------------------------------------------------


def read_file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The range file: which inclusive range of ids each article file holds."""
    return spark.read.schema(FILE_RANGES).csv(path)
