"""What the jobs write: word counts as text, results as Parquet or as lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The form of a word count and the labels of a result line.
WORD_COUNT_FORM = "(%s,%d)"
RESULT_LABELS = {
    "doc_id": "docID:",
    "url": ",URL:",
    "title": ",Title:",
    "snippet": ",Content:",
}


def word_count_line(counts: DataFrame) -> DataFrame:
    """Word counts as lines ``(word,n)``."""
    return counts.select(F.format_string(WORD_COUNT_FORM, "word", "n").alias("value"))


def write_word_count(counts: DataFrame, path: str) -> None:
    """Write word counts as text; fails when the path exists."""
    word_count_line(counts).write.mode("errorifexists").text(path)


def result_line(results: DataFrame) -> DataFrame:
    """Results as lines ``docID:..,URL:..,Title:..,Content:..``."""
    parts = []
    for name, label in RESULT_LABELS.items():
        parts += [F.lit(label), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return results.select(F.concat(*parts).alias("value"))


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write results as Parquet."""
    results.write.mode(mode).parquet(path)
