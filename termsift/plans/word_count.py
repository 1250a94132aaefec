"""Word count of text files, from path to path."""

from pyspark.sql import SparkSession

from termsift.operators.counts import split_words, word_count
from termsift.sources.lines import read_lines
from termsift.sources.sinks import write_word_count


def word_count_job(spark: SparkSession, input_path: str, output_path: str) -> None:
    """Count the words of text files and write ``(word,n)`` lines to a new path."""
    write_word_count(word_count(split_words(read_lines(spark, input_path))), output_path)
