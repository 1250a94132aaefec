import random

import pytest
from data import INDEX, INVALID, RESULTS

from termsift.functions.queries import (
    AND,
    AND_NOT,
    OR,
    compile_queries,
    compile_query,
    fold,
    query_tokens,
    search_words,
)
from termsift.schemas import QUERIES

SETS = {AND: set.__and__, OR: set.__or__, AND_NOT: set.__sub__}


def evaluate(text, index=INDEX):
    return fold(compile_query(text).postfix, lambda w: index.get(w, set()), SETS)


def random_query(rng, words, depth=3):
    parts = []
    for _ in range(rng.randint(1, 4)):
        if depth and rng.random() < 0.35:
            parts.append(f"({random_query(rng, words, depth - 1)})")
        else:
            parts.append(rng.choice(words))
    text = parts[0]
    for part in parts[1:]:
        text += f" {rng.choice(['and', 'or', 'and not', 'AND', 'not'])} {part}"
    return text


@pytest.mark.parametrize(
    "text, postfix, positive",
    [
        ("a or b and c", "a b or c and", "a b c"),
        ("a and b or c", "a b and c or", "a b c"),
        ("a and (b or c)", "a b c or and", "a b c"),
        ("a and not (b or c) and d", "a b c or and-not d and", "a d"),
        ("a and not b or c and not d", "a b and-not c or d and-not", "a c"),
        ("a AND NOT b", "a b and-not", "a"),
        ("a not b", "a b and-not", "a"),
        ("covid19 and x", "covid x and", "covid x"),
        ("((a))", "a", "a"),
        ("a and not ((b or c) or d)", "a b c or d or and-not", "a"),
        ("a and not (b and not c) or d", "a b c and-not and-not d or", "a d"),
        ("Über AND naïve", "über naïve and", "über naïve"),
    ],
)
def test_grammar(text, postfix, positive):
    query = compile_query(text)
    assert query.postfix == [t.replace("-", " ") for t in postfix.split()]
    assert query.positive == positive.split()


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    with pytest.raises(ValueError):
        compile_query(text)


def test_error_names_the_position():
    with pytest.raises(ValueError, match="position 4"):
        compile_query("cat dog")


@pytest.mark.parametrize("text, wanted", RESULTS.items())
def test_left_to_right(text, wanted):
    assert evaluate(text) == wanted


def test_deep_nesting():
    assert compile_query("(" * 5000 + "a" + ")" * 5000).postfix == ["a"]


def test_table_of_queries(spark):
    rng = random.Random(7)
    texts = [*RESULTS, *INVALID, *[random_query(rng, ["cat", "ab", "x"]) for _ in range(40)], None]
    table = spark.createDataFrame(list(enumerate(texts)), QUERIES)
    rows = {
        r["query_id"]: r
        for r in compile_queries(table)
        .withColumn("tokens", query_tokens("query"))
        .withColumn("search_words", search_words("query"))
        .collect()
    }
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        row = rows[i]
        assert row["query"] == text
        try:
            query = compile_query(text or "")
        except ValueError as fault:
            assert row["error"] == str(fault) and not row["slots"]
            continue
        assert row["error"] is None
        assert row["words"] == list(dict.fromkeys(query.words))
        assert row["positive"] == query.positive
        assert row["search_words"] == query.words
        known = {-1: AND, -2: OR, -3: AND_NOT} | dict(enumerate(row["words"]))
        assert [known[s] for s in row["slots"]] == query.postfix
        # The tokens of a column are those of the string, in the order they are written.
        assert [t for t in row["tokens"] if t not in ("(", ")", AND, OR, AND_NOT)] == query.words
        assert compile_query(" ".join(row["tokens"])) == query
