import random

import pytest
from data import INDEX, INDEX_LINES, INVALID, RESULTS
from test_query_language import evaluate, random_query

from termsift import cluster
from termsift.functions.queries import AND, AND_NOT, OR, compile_query, fold
from termsift.operators.boolean import _of_candidates, boolean_search, boolean_search_batch, matched_terms, reach
from termsift.operators.sets import bool_and, bool_and_not, bool_or, no_match, sort_doc_ids
from termsift.schemas import LINES, QUERIES
from termsift.sources.lines import parse_postings

WORDS = ["cat", "car", "dog", "bird", "a", "zzzz"]


@pytest.fixture(scope="module")
def postings(spark):
    # A repeated line: results are sets all the same.
    lines = spark.createDataFrame([(line,) for line in [*INDEX_LINES, INDEX_LINES[0]]], LINES)
    return parse_postings(lines).cache()


def ids(table):
    found = [r["doc_id"] for r in table.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("text, wanted", RESULTS.items())
def test_results(postings, text, wanted):
    found = boolean_search(postings, text)
    assert ids(found) == wanted
    assert no_match(found).first()["no_match"] == (not wanted)


@pytest.mark.parametrize("text", INVALID)
def test_invalid(postings, text):
    with pytest.raises(ValueError):
        boolean_search(postings, text)


def test_one_shuffle(postings):
    plan = boolean_search(postings, "cat and (dog or bird) and not car")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ObjectHashAggregate" not in plan


def test_same_as_set_operations(postings):
    rng = random.Random(1)

    def of(word):
        return postings.where(postings.term == word).select("doc_id")

    for _ in range(12):
        text = random_query(rng, WORDS, depth=2)
        sets = {AND: bool_and, OR: bool_or, AND_NOT: bool_and_not}
        composed = fold(compile_query(text).postfix, of, sets)
        wanted = evaluate(text)
        assert ids(boolean_search(postings, text)) == ids(composed.distinct()) == wanted, text


def test_reach_bounds_every_result(postings, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 4 * 64)  # four rows are few
    for text in [*RESULTS, *[random_query(rng, WORDS, depth=2) for _ in range(20)]]:
        bounds, wanted = reach(postings, text), evaluate(text)
        assert len(wanted) <= bounds.n
        assert all(bounds.low <= i <= bounds.high for i in wanted)
        assert all(any(i in INDEX[w] for w in bounds.cover) for i in wanted)
        assert ids(boolean_search(postings, text, bounds)) == wanted, text


def test_rare_words_filter_common_ones(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 50 * 64)
    postings = spark.range(1000).selectExpr("'the' AS term", "id AS doc_id", "'th' AS prefix").union(
        spark.range(10).selectExpr("'rare' AS term", "id * 7 AS doc_id", "'ra' AS prefix")
    )
    bounds = reach(postings, "the and rare")
    assert (bounds.n, bounds.low, bounds.high, bounds.cover) == (10, 0, 63, {"rare"})
    found = boolean_search(postings, "the and rare", bounds)
    assert ids(found) == {i * 7 for i in range(10)}
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("deep", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [cluster.BROADCAST_BYTES, 16_000, 0])
def test_batch(spark, postings, monkeypatch, broadcast_bytes, deep):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(3)
    texts = [*RESULTS, *INVALID, *[random_query(rng, WORDS) for _ in range(60)]]
    # More words than one flag column holds.
    wide = [a + b for a in "bcdfghjklm" for b in "aeiouvwx"]
    texts += [" or ".join([*wide, "cat"]), " or ".join(wide) + " and cat"]
    texts += ["(" + " or ".join([*wide, "cat"]) + ") and not " + " and not ".join(["dog", *wide])]
    if deep:
        # More waiting operands than bits: a and (b or (a and (b or ...
        texts += ["cat and (dog or (" * 40 + "bird" + "))" * 40, "dog not (cat and (" * 50 + "a" + "))" * 50]
    queries = spark.createDataFrame(list(enumerate(texts)), QUERIES)
    found = boolean_search_batch(postings, queries).collect()
    pairs = {tuple(r) for r in found}
    assert len(pairs) == len(found)
    wanted = {
        (i, doc) for i, text in enumerate(texts) if text not in INVALID for doc in evaluate(text)
    }
    assert pairs == wanted


def test_batch_without_a_valid_query(spark, postings):
    queries = spark.createDataFrame([(1, "(cat")], QUERIES)
    assert boolean_search_batch(postings, queries).collect() == []


def test_matched_terms(postings):
    found = {r["doc_id"]: r["terms"] for r in matched_terms(postings, ["dog", "cat", "zzzz"]).collect()}
    assert found == {1: ["cat"], 2: ["cat", "dog"], 3: ["cat", "dog"], 5: ["cat"], 6: ["dog"]}


def test_set_operations(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    right = spark.createDataFrame([(1,), (3,), (3,)], "doc_id long")
    assert ids(bool_and(left, right)) == {1}
    assert ids(bool_or(left, right)) == {1, 2, 3}
    assert ids(bool_and_not(left, right)) == {2}
    assert [r[0] for r in sort_doc_ids(right).collect()] == [1, 3, 3]


def test_batch_candidates_come_from_the_rare_word(spark):
    """A common word that a query requires too makes no candidates of its own."""
    rows = [("common", k, "co") for k in range(500)] + [("rare", k, "ra") for k in (3, 4)]
    postings = spark.createDataFrame(rows, "term string, doc_id long, prefix string")
    texts = ["rare and common", "common and rare", "common and not rare and rare", "rare or zzzz"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    found = boolean_search_batch(postings, queries)
    assert sorted(map(tuple, found.collect())) == [(q, d) for q in (0, 1, 3) for d in (3, 4)]


@pytest.mark.parametrize("size, kept", [(64 << 20, 4), (5000, 5), (0, 2003)])
def test_postings_of_candidates_only_are_shuffled(spark, monkeypatch, size, kept):
    """By word and document; by document where bitmaps per word are too large; else all."""
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
    rows = [("common", k, "co") for k in range(2000)] + [("rare", k, "ra") for k in (3, 4, 90)]
    postings = spark.createDataFrame(rows, "term string, doc_id long, prefix string")
    asked = [(1, 3, 0, "co", "common"), (1, 4, 0, "co", "common"), (2, 3, 1, "ra", "rare"), (2, 4, 1, "ra", "rare"), (2, 9, 1, "ra", "rare")]
    asked = spark.createDataFrame(asked, "query_id long, doc_id long, slot int, prefix string, term string")
    found = _of_candidates(postings, asked)
    assert found.columns == postings.columns and found.count() == kept
    wanted = [("common", 3), ("common", 4), ("rare", 3), ("rare", 4)]
    assert {(r.term, r.doc_id) for r in found.collect()} >= set(wanted)
