"""Search strings: words, parentheses and the operators ``and``, ``or``, ``and not``.

Operators have equal precedence and group from left to right. A single search string is compiled
on the driver, where it is a few words long; a table of them stays a table.
"""

import re
import sys
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from termsift.functions.words import string_array

# Ship the query helper with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AND, OR, AND_NOT = "and", "or", "and not"
OPERATORS = (AND, OR, AND_NOT)


class Query(NamedTuple):
    """A compiled search string."""

    words: list[str]  # every search word, in order, with repeats
    positive: list[str]  # the words that are not behind "and not"
    postfix: list[str]  # words and operators, operands first


#: Runs of characters that may be letters, and parentheses; digits like "\u00b2" are in the runs, too.
_RUNS = re.compile(r"[^\W\d_]+|[()]")


def _is_plain(text: str, runs: list[str]) -> bool:
    """Whether the runs of a lower-cased text hold letters only."""
    return text.isascii() or all(run.isalpha() or run in "()" for run in runs)


def _runs(text: str) -> Iterator[tuple[int, str]]:
    """Runs of letters and single parentheses, with their positions."""
    text = text.lower()
    if _is_plain(text, _RUNS.findall(text)):
        return ((found.start(), found.group()) for found in _RUNS.finditer(text))
    marked = ((at, c) for at, c in enumerate(text) if c.isalpha() or c in "()")
    # neighbours have the same difference of position and number; a parenthesis stands alone
    groups = groupby(enumerate(marked), lambda n: (n[1][0] - n[0], n[1][0] if n[1][1] in "()" else -1))
    parts = ([item for _, item in group] for _, group in groups)
    return ((part[0][0], "".join(c for _, c in part)) for part in parts)


def _tokens(text: str) -> Iterator[tuple[int, str]]:
    held = None  # an "and" that may turn out to be "and not"
    for at, token in _runs(text):
        if token == "not":
            yield (held[0] if held else at), AND_NOT
            held = None
            continue
        if held:
            yield held
        held = (at, token) if token == AND else None
        if not held:
            yield at, token
    if held:
        yield held


def compile_query(text: str) -> Query:
    """Compile one search string; raise ``ValueError`` with the position of the first fault."""
    words, positive, postfix = [], [], []
    pending = [""]  # operator waiting for its right side, one entry per open parenthesis
    excluded = [False]  # whether the open parenthesis stands behind "and not"
    operand_next = True
    for at, token in _tokens(text):
        if token in OPERATORS or token == ")":
            if operand_next:
                raise ValueError(f"operand expected before {token!r} at position {at}: {text!r}")
        elif not operand_next:
            raise ValueError(f"operator expected before {token!r} at position {at}: {text!r}")

        if token in OPERATORS:
            pending[-1] = token
            operand_next = True
            continue
        hidden = excluded[-1] or pending[-1] == AND_NOT
        if token == "(":
            pending.append("")
            excluded.append(hidden)
            continue
        if token == ")":
            if len(pending) == 1:
                raise ValueError(f"unmatched ')' at position {at}: {text!r}")
            pending.pop()
            excluded.pop()
        else:
            words.append(token)
            postfix.append(token)
            if not hidden:
                positive.append(token)
        if pending[-1]:
            postfix.append(pending[-1])
            pending[-1] = ""
        operand_next = False
    if operand_next:
        raise ValueError(f"operand expected at the end: {text!r}")
    if len(pending) > 1:
        raise ValueError(f"unmatched '(': {text!r}")
    return Query(words, positive, postfix)


def as_query(query: "str | Query") -> Query:
    return compile_query(query) if isinstance(query, str) else query


def fold(postfix: list[str], operand: Callable[[str], Any], apply: dict[str, Callable]) -> Any:
    """Combine the operands of a compiled query; ``apply`` holds one function per operator."""
    stack = []
    for token in postfix:
        if token in OPERATORS:
            right = stack.pop()
            stack[-1] = apply[token](stack[-1], right)
        else:
            stack.append(operand(token))
    return stack.pop()


def condition(postfix: list[str], operand: Callable[[str], Column]) -> Column:
    """The whole query as one boolean column, grouped exactly as the query is."""
    return fold(
        postfix,
        operand,
        {AND: lambda a, b: a & b, OR: lambda a, b: a | b, AND_NOT: lambda a, b: a & ~b},
    )


def query_tokens(query: Column) -> Column:
    """Tokens of a search string column; ``not``, alone or after ``and``, is ``and not``."""
    runs = F.regexp_extract_all(F.lower(query), F.lit(r"\p{L}+|[()]"), F.lit(0))
    # Every token gets its own blanks, so that neighbours cannot share one.
    padded = F.array_join(F.transform(runs, lambda t: F.concat(F.lit(" "), t, F.lit(" "))), "")
    fused = F.regexp_replace(padded, "(?: and )? not ", " and_not ")
    tokens = F.regexp_extract_all(fused, F.lit(r"and_not|\p{L}+|[()]"), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t == "and_not", F.lit(AND_NOT)).otherwise(t))


def search_words(query: Column) -> Column:
    """Words of a search string column, without operators and parentheses."""
    marks = string_array([*OPERATORS, "(", ")"])
    return F.filter(query_tokens(query), lambda t: ~F.array_contains(marks, t))


#: Operators in ``slots``; a search word is its place among the distinct words, from 0.
SLOT_OF = {AND: -1, OR: -2, AND_NOT: -3}

_COMPILED = {
    "words": ArrayType(StringType()),
    "positive": ArrayType(StringType()),
    "slots": ArrayType(IntegerType()),
    "depth": IntegerType(),
    "error": StringType(),
}


class _Shape(NamedTuple):
    """What search strings share that differ only in their words; these are places among the words."""

    positive: list[int]
    slots: list[int]
    depth: int


#: Shapes met in this process, by their tokens; a table of queries mostly has few.
_shapes: dict[tuple, _Shape] = {}
_MOST_SHAPES, _SHAPE_TOKENS = 4096, 64  # longer strings are compiled each for itself

_RESERVED = frozenset([AND, OR, "not", "(", ")"])


def _compile_row(text: str | None) -> tuple:
    text = text or ""
    lower = text.lower()
    runs = _RUNS.findall(lower)
    key = None
    if len(runs) <= _SHAPE_TOKENS and _is_plain(lower, runs):
        place: dict[str, int] = {}
        key = tuple([run if run in _RESERVED else place.setdefault(run, len(place)) for run in runs])
        shape = _shapes.get(key)
        if shape:
            words = list(place)
            return words, [words[i] for i in shape.positive], shape.slots, shape.depth, None
    try:
        query = compile_query(text)
    except ValueError as fault:
        return [], [], [], 0, str(fault)
    words = list(dict.fromkeys(query.words))
    slot_of = {word: slot for slot, word in enumerate(words)} | SLOT_OF
    slots = [slot_of[token] for token in query.postfix]
    depth = max(accumulate(1 if slot >= 0 else -1 for slot in slots))
    if key is not None:
        if len(_shapes) >= _MOST_SHAPES:
            _shapes.clear()
        _shapes[key] = _Shape([slot_of[word] for word in query.positive], slots, depth)
    return words, query.positive, slots, depth, None


def _compile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    kinds = (strings, strings, pa.list_(pa.int32()), pa.int32(), pa.string())
    for batch in batches:
        rows = [_compile_row(text) for text in batch.column("query").to_pylist()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        added = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *added], names=[*batch.schema.names, *_COMPILED]
        )


def compile_queries(queries: DataFrame) -> DataFrame:
    """Compile the ``query`` column of a table of queries.

    Adds ``words`` (distinct), ``positive``, ``slots`` (postfix form over places in ``words``),
    ``depth`` (operands that wait at the same time) and ``error``, null for a valid query. Only the query side passes through Python.
    """
    added = [StructField(name, kind) for name, kind in _COMPILED.items()]
    return queries.mapInArrow(_compile_batches, StructType([*queries.schema.fields, *added]))
