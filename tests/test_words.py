import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from termsift.functions.words import drop_stop_words, letter_runs, line_words
from termsift import cluster
from termsift.operators.counts import split_words, term_chunks, terms_by_prefix, word_count
from termsift.plans.word_count import word_count_job
from termsift.schemas import LINES
from termsift.sources.lines import read_lines


@pytest.mark.parametrize(
    "line, words",
    [
        ("a  b  ", ["a", "", "b"]),
        ("", [""]),
        ("   ", []),
        (" a", ["", "a"]),
        ("a\tb c", ["a\tb", "c"]),
    ],
)
def test_line_words(spark, line, words):
    lines = spark.createDataFrame([(line,)], LINES)
    assert lines.select(line_words(F.col("value"))).first()[0] == words
    assert [r["word"] for r in split_words(lines).collect()] == words


def test_word_count_job(spark, tmp_path):
    (tmp_path / "in.txt").write_text("line1\nline2\nline3\n")
    word_count_job(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"))
    lines = {r["value"] for r in read_lines(spark, str(tmp_path / "out")).collect()}
    assert lines == {"(line1,1)", "(line2,1)", "(line3,1)"}
    with pytest.raises(AnalysisException):
        word_count_job(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"))


def test_word_count_counts_before_the_shuffle(spark):
    words = spark.createDataFrame([("a",)] * 5 + [("b",)], "word string")
    counts = word_count(words)
    assert {tuple(r) for r in counts.collect()} == {("a", 5), ("b", 1)}
    assert "partial_count" in counts._jdf.queryExecution().executedPlan().toString()


def test_terms_by_prefix(spark):
    terms = spark.createDataFrame([("cat",), ("car",), ("cat",), ("dog",), ("a",)], "term string")
    found = {r["prefix"]: r["terms"] for r in terms_by_prefix(terms).collect()}
    assert found == {"ca": ["car", "cat"], "do": ["dog"], "a": ["a"]}


def test_letter_runs_and_stop_words(spark):
    row = spark.createDataFrame([("The COVID19 don't été, the_end",)], "t string").select(
        letter_runs(F.col("t")).alias("runs"), drop_stop_words(letter_runs(F.col("t"))).alias("kept")
    )
    row = row.first()
    assert row["runs"] == ["the", "covid", "don", "t", "été", "the", "end"]
    assert row["kept"] == ["covid", "don", "t", "été", "end"]


def test_chunks_of_a_prefix_are_bounded(spark):
    terms = spark.range(100_000).selectExpr("concat('ab', lpad(id % 90000, 6, '0')) AS term")
    more = spark.createDataFrame([("b",), ("ba",), ("bb",), ("bb",)], "term string")
    found = term_chunks(terms.union(more), 1000).collect()
    assert max(len(r.terms) for r in found) == 1000 and all(r.terms == sorted(set(r.terms)) for r in found)
    own = [r for r in found if r.prefix == "ab"]
    assert 90 <= len(own) <= 90 + 8 and sum(len(r.terms) for r in own) == 90_000
    runs = sorted((r.terms[0], r.terms[-1]) for r in own)
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
    assert sorted(t for r in found if r.prefix != "ab" for t in r.terms) == ["b", "ba", "bb"]
    assert term_chunks(terms.limit(0)).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_only_common_keys_are_cut(spark, monkeypatch, how):
    monkeypatch.setattr(cluster, "PIECE_ROWS", 100)
    rows = [("hot", k) for k in range(1000)] + [(f"k{k % 300}", k) for k in range(1000)] + [("none", 1)]
    rows = spark.createDataFrame(rows, "term string, doc_id long")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{k}", k) for k in range(300)]], "term string, x long")
    cut = cluster.common_keys(rows, ["term"])
    assert [tuple(r) for r in cut.collect()] == [("hot", 10)]
    found = cluster.join_lookup(rows, lookup, ["term"], False, "doc_id", how)
    wanted = rows.join(lookup, "term", how)
    assert found.columns == wanted.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    monkeypatch.setattr(cluster, "PIECE_ROWS", 1000)
    assert cluster.common_keys(rows, ["term"]) is None
    plain = cluster.join_lookup(rows, lookup, ["term"], False, "doc_id", how)
    assert "_salt" not in plain._jdf.queryExecution().executedPlan().toString()
    assert plain.count() == wanted.count()
