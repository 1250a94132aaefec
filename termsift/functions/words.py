"""Column functions that cut text into words."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the standard analyzer used for snippets.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is",
    "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
)


def string_array(words: Sequence[str]) -> Column:
    """A literal ``array<string>``, typed even when it is empty."""
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def text_lines(text: Column) -> Column:
    """The lines of a text, as an array."""
    return F.split(text, "\n")


def line_words(line: Column) -> Column:
    """Words of a line, cut at every single space.

    Leading and inner empty words are kept and trailing ones are not; an empty line has one empty
    word and a line of spaces has none. Spark's own ``split`` keeps trailing empty words.
    """
    body = F.rtrim(line, F.lit(" "))
    return (
        F.when(line == "", string_array([""]))
        .when(body == "", string_array([]))
        .otherwise(F.split(body, " "))
    )


def letter_runs(text: Column) -> Column:
    """Lower-cased maximal runs of letters, in order and with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def term_prefix(term: Column) -> Column:
    """Index shard of a term: its first two letters, or the only one."""
    return F.substring(term, 1, 2)


def drop_stop_words(words: Column) -> Column:
    """Distinct words of an array without the English stop words."""
    return F.array_except(words, string_array(STOP_WORDS))
