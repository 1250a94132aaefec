"""Set operations on tables of document ids; every result is a set."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bool_and(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents in both."""
    return left.select("doc_id").intersect(right.select("doc_id"))


def bool_or(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents in either."""
    return left.select("doc_id").union(right.select("doc_id")).distinct()


def bool_and_not(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents in the left that are not in the right."""
    return left.select("doc_id").subtract(right.select("doc_id"))


def cast_doc_id(doc_id: Column) -> Column:
    """A document id that came as text; null when it is no number."""
    return doc_id.try_cast("bigint")


def sort_doc_ids(doc_ids: DataFrame) -> DataFrame:
    """Document ids, ascending."""
    return doc_ids.select("doc_id").orderBy("doc_id")


def no_match(doc_ids: DataFrame) -> DataFrame:
    """One row telling whether a result is empty; stops at the first match."""
    return doc_ids.select("doc_id").limit(1).agg((F.count("*") == 0).alias("no_match"))
