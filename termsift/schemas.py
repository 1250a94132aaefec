"""Declared schemas of every table the package reads or writes."""

from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


LINES = _struct(("value", StringType()))

#: One row per (term, document) pair; ``prefix`` is the partition column.
POSTINGS = _struct(("term", StringType()), ("doc_id", LongType()), ("prefix", StringType()))

#: Runs of the ids of a term; ``offsets`` are from ``first_id``, ``prefix`` is the partition column.
BLOCKS = _struct(
    ("term", StringType()),
    ("shift", IntegerType()),
    ("first_id", LongType()),
    ("last_id", LongType()),
    ("n", IntegerType()),
    ("offsets", ArrayType(LongType())),
    ("prefix", StringType()),
)

ARTICLES = _struct(
    ("doc_id", LongType()),
    ("url", StringType()),
    ("title", StringType()),
    ("content", StringType()),
)

#: The written form of the articles; ``file`` is the partition column.
ARTICLE_FILES = _struct(*[(f.name, f.dataType) for f in ARTICLES], ("file", StringType()))

#: Both bounds are inclusive.
FILE_RANGES = _struct(("file", StringType()), ("begin_id", LongType()), ("end_id", LongType()))

RESULTS = _struct(
    ("doc_id", LongType()),
    ("url", StringType()),
    ("title", StringType()),
    ("snippet", StringType()),
)

DOC_IDS = _struct(("doc_id", LongType()))

QUERIES = _struct(("query_id", LongType()), ("query", StringType()))

WORD_COUNTS = _struct(("word", StringType()), ("n", LongType()))
