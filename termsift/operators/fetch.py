"""From document ids to files and articles."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsift.cluster import may_broadcast, write_scratch
from termsift.operators.doc_sets import DocSet, in_runs, keep_documents, write_ids

#: Bins of the range join are at most 2**20 ids wide, so no bin gathers more documents than that.
_MAX_LEVEL = 20


def _leveled(ranges: DataFrame) -> DataFrame:
    level = F.least(F.length(F.bin(F.col("end_id") - F.col("begin_id"))), F.lit(_MAX_LEVEL))
    return ranges.where("begin_id <= end_id").withColumn("_level", level)


class RangeSize(NamedTuple):
    """Size of a range file, and of its bins for the range join."""

    files: int
    name_bytes: int
    bins: int
    bin_bytes: int
    levels: list[int]  # the width classes that occur, at most ``_MAX_LEVEL``


def range_size(ranges: DataFrame) -> RangeSize:
    """Measure a range file; one row reaches the driver."""
    bins = F.expr("shiftright(end_id, _level) - shiftright(begin_id, _level) + 1")
    name = F.octet_length("file")
    row = _leveled(ranges).agg(
        F.count("*"), F.sum(name), F.sum(bins), F.sum(bins * name), F.collect_set("_level")
    )
    *sums, levels = row.first()
    return RangeSize(*[value or 0 for value in sums], sorted(levels))


def doc_file_ranges(
    doc_ids: DataFrame, ranges: DataFrame, size: RangeSize | None = None
) -> DataFrame:
    """The file that holds each document: ``(doc_id, file)``. Ids outside all ranges drop out.

    An equi-join over bins of ids. Each range is binned at the power of two just above its own
    width, so it touches two bins, and a bin touches a handful of ranges, whatever the mix of
    widths. A document looks at one bin for each width class that occurs.
    """
    size = size or range_size(ranges)
    spans = "explode(sequence(shiftright(begin_id, _level), shiftright(end_id, _level)))"
    bins = _leveled(ranges).withColumn("_bin", F.expr(spans))
    levels = F.array(*[F.lit(level) for level in size.levels]).cast("array<int>")
    docs = doc_ids.select("doc_id", F.explode(levels).alias("_level"))
    docs = docs.withColumn("_bin", F.expr("shiftright(doc_id, _level)"))
    if may_broadcast(size.bins, size.bin_bytes):
        bins = F.broadcast(bins)
    inside = F.col("doc_id").between(F.col("begin_id"), F.col("end_id"))
    return docs.join(bins, ["_level", "_bin"]).where(inside).select("doc_id", "file")


def matched_files(
    doc_ids: DataFrame, ranges: DataFrame, size: RangeSize | None = None
) -> DataFrame:
    """Names of the files that hold any of the documents."""
    return doc_file_ranges(doc_ids, ranges, size).select("file").distinct()


def placed_ids(doc_ids: DataFrame, ranges: DataFrame) -> tuple[DataFrame, bool]:
    """Documents with the file of their own range, ``(doc_id, file)``, and whether they are few.

    Written once, since it is measured and then read for the files and for the documents. An id
    outside all ranges has no row: whatever article file holds it, it is not found.
    """
    size = range_size(ranges)
    placed = doc_file_ranges(doc_ids, ranges, size).distinct()
    path = write_scratch(placed, "placed")
    placed = doc_ids.sparkSession.read.schema(placed.schema).parquet(path)
    row = placed.agg(F.count("*"), F.sum(F.octet_length("file"))).first()
    return placed, may_broadcast(row[0], row[1] or 0)


def fetch_articles(
    articles: DataFrame,
    doc_ids: DataFrame | DocSet,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """The articles of some documents.

    The ids are computed once and written, and what is needed of them is read from there. A set of
    bounded size is broadcast, as ids or as a bitmap, and the articles, which are the large side,
    stay where they are; a larger one takes a shuffle join. With ``ranges``, articles have a
    ``file``, and an article is found only in the file of the range its id lies in, at any size.
    Files without matches are not read where their names can be broadcast, by dynamic partition
    pruning; row groups outside the runs of the ids are not read. Both skip and decide nothing.
    """
    docs = doc_ids if isinstance(doc_ids, DocSet) else write_ids(doc_ids)
    if not docs.n:
        return articles.limit(0)
    if ranges is None:
        return keep_documents(articles, docs)[0]
    found = articles.where(in_runs(F.col("doc_id"), docs.runs))
    placed, few = placed_ids(docs.ids, ranges)
    if few:
        found = found.join(F.broadcast(placed.select("file").distinct()), "file", "left_semi")
        placed = F.broadcast(placed)
    return found.join(placed, ["doc_id", "file"], "left_semi")
