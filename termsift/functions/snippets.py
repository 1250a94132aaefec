"""Snippets: the piece of a text with the most search words, hit words in bold.

Everything happens inside the row, so a snippet never needs a shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from termsift.functions.words import letter_runs, string_array

# Piece length and highlight marks.
FRAGMENT_SIZE = 100
HIT_BEGIN, HIT_END = "<B>", "</B>"

_SPACE = r"[ \t\n\f\r]"
# Up to 100 characters that end at white space. A longer run without white space is one piece of
# its own, so no text is lost and no word is cut.
_FRAGMENT = (
    rf"(?s).{{1,{FRAGMENT_SIZE}}}(?:{_SPACE}|\z)"
    rf"|.[^ \t\n\f\r]*(?:{_SPACE}|\z)"
)


def fragments(text: Column) -> Column:
    """Non-overlapping pieces of a text, in order."""
    return F.regexp_extract_all(text, F.lit(_FRAGMENT), F.lit(0))


def fragment_score(fragment: Column, words: Sequence[str]) -> Column:
    """Number of distinct search words in a piece."""
    if not words:
        return F.lit(0)
    low = F.lower(fragment)
    # A substring test is far cheaper than cutting into words, and most pieces fail it.
    maybe = F.lit(False)
    for word in words:
        maybe = maybe | F.contains(low, F.lit(word))
    hits = F.size(F.array_intersect(letter_runs(fragment), string_array(words)))
    return F.when(maybe, hits).otherwise(F.lit(0))


def best_fragment(text: Column, words: Sequence[str]) -> Column:
    """``struct(score, place, fragment)`` of the best piece; earliest on ties, null for no text."""
    scored = F.transform(
        fragments(text),
        lambda piece, i: F.struct(
            fragment_score(piece, words).alias("score"),
            (-i).alias("place"),
            piece.alias("fragment"),
        ),
    )
    return F.array_max(scored)


def best_hits(text: Column, words: Sequence[str]) -> Column:
    """The best piece as an array: one element, or none when no search word occurs."""
    return F.filter(F.array(best_fragment(text, words)), lambda b: b["score"] > 0)


def highlight(text: Column, words: Sequence[str]) -> Column:
    """A text with every search word in bold; only whole letter runs are marked."""
    marked = string_array(words)
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                F.array_contains(marked, F.lower(p)), F.concat(F.lit(HIT_BEGIN), p, F.lit(HIT_END))
            ).otherwise(p),
        ),
        "",
    )


def snippet_or_null(text: Column, words: Sequence[str]) -> Column:
    """The highlighted best piece, or null when no search word occurs."""
    if not words:
        return F.lit(None).cast("string")
    hit = F.transform(best_hits(text, words), lambda b: highlight(b["fragment"], words))
    return F.get(hit, F.lit(0))


def snippet(text: Column, words: Sequence[str]) -> Column:
    """The highlighted best piece, or an empty string."""
    return F.coalesce(snippet_or_null(text, words), F.lit(""))


def title_or_plain(title: Column, words: Sequence[str]) -> Column:
    """The highlighted title when it has a hit, else the title as it is."""
    return F.coalesce(snippet_or_null(title, words), title)
