import random

import pytest
from data import ARTICLE_LINES, RANGES

from termsift import cluster
from termsift.operators.doc_sets import (
    MAX_RUNS,
    bitmaps,
    fold_runs,
    keep_documents,
    test_bits,
    write_ids,
)
from termsift.operators.fetch import doc_file_ranges, fetch_articles, matched_files
from termsift.schemas import DOC_IDS, FILE_RANGES, LINES
from termsift.sources.index import read_article_files, write_articles
from termsift.sources.lines import parse_articles


@pytest.fixture(params=[cluster.BROADCAST_BYTES, 0], ids=["broadcast", "shuffle"])
def either_join(request, monkeypatch):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", request.param)


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], DOC_IDS)


def ranges_of(spark, ranges):
    return spark.createDataFrame(list(ranges), FILE_RANGES)


def test_gap_drops_only_its_own_id(spark, either_join):
    ranges = ranges_of(spark, RANGES)
    docs = ids_of(spark, [0, 1, 2, 3, 4, 5, 8, 9])
    found = {tuple(r) for r in doc_file_ranges(docs, ranges).collect()}
    assert found == {(1, "w1"), (2, "w1"), (3, "w1"), (5, "w2"), (8, "w2")}
    assert {r[0] for r in matched_files(docs, ranges).collect()} == {"w1", "w2"}
    assert matched_files(ids_of(spark, [4]), ranges).collect() == []


def test_ranges_of_mixed_widths(spark, either_join):
    rng = random.Random(4)
    ranges, at = [], -1000
    for i in range(300):
        at += rng.choice([1, 1, 2, 50])
        width = rng.choice([0, 0, 1, 3, 10, 100, 5000])
        ranges.append((f"f{i}", at, at + width))
        at += width
    ranges.append(("wide", at + 1, at + 3_000_000))  # wider than the widest bin
    ranges.append(("inverted", 7, 3))
    docs = sorted({rng.randint(-1100, at) for _ in range(2000)} | {at, at + 1, at + 2_500_000, at + 3_000_001})
    wanted = {(d, f) for d in docs for f, a, b in ranges if a <= d <= b}
    found = doc_file_ranges(ids_of(spark, docs), ranges_of(spark, ranges)).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_no_ranges(spark):
    assert doc_file_ranges(ids_of(spark, [1]), ranges_of(spark, [])).collect() == []


def test_fetch_articles(spark, either_join):
    articles = parse_articles(spark.createDataFrame([(line,) for line in ARTICLE_LINES], LINES))
    found = fetch_articles(articles, ids_of(spark, [2, 5, 5, 99]))
    assert sorted(r["doc_id"] for r in found.collect()) == [2, 5]
    assert fetch_articles(articles, ids_of(spark, [])).collect() == []


@pytest.mark.parametrize("size", [64 << 20, 192, 0])
def test_an_article_is_found_in_the_file_of_its_range_only(spark, monkeypatch, size):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
    rows = [(1, "w1"), (2, "w1"), (4, "w9"), (4, "w1"), (5, "w2"), (7, "w1")]
    articles = spark.createDataFrame(
        [(doc, "u", "t", "cat", file) for doc, file in rows],
        "doc_id long, url string, title string, content string, file string",
    )
    ranges = ranges_of(spark, [*RANGES, ("absent", 20, 30)])
    found = fetch_articles(articles, ids_of(spark, [1, 2, 4, 5, 7, 25]), ranges)
    assert sorted((r["doc_id"], r["file"]) for r in found.collect()) == [
        (1, "w1"), (2, "w1"), (5, "w2"),
    ]


def test_only_files_with_matches_are_read(spark, tmp_path, either_join):
    articles = spark.range(100).selectExpr(
        "id AS doc_id", "'u' AS url", "'t' AS title", "'c' AS content"
    )
    write_articles(articles, str(tmp_path / "a"), ids_per_file=10)
    ranges = ranges_of(spark, [(f"part_{i}", i * 10, i * 10 + 9) for i in range(10)])
    found = fetch_articles(
        read_article_files(spark, str(tmp_path / "a")), ids_of(spark, [15, 17, 42]), ranges
    )
    assert {(r["doc_id"], r["file"]) for r in found.collect()} == {
        (15, "part_1"),
        (17, "part_1"),
        (42, "part_4"),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The join on file and id lets Spark prune by itself where it finds the ids small.
    assert "dynamicpruning" in plan or not cluster.BROADCAST_BYTES


def test_runs_are_parted_at_the_widest_gaps():
    spans = [(1, 3), (5, 9), (40, 41), (50, 60), (900, 900)]
    assert fold_runs(spans, 10) == spans
    assert fold_runs(spans, 3) == [(1, 9), (40, 60), (900, 900)]
    assert fold_runs(spans, 1) == [(1, 900)] and fold_runs([], 5) == []
    assert fold_runs([(1, 2), (3, 4)], 5) == [(1, 4)]


def test_a_set_is_folded_and_measured(spark):
    ids = [-(1 << 62), -7, 0, 5, 6, 7, 1 << 40, (1 << 62) + 5]
    docs = write_ids(ids_of(spark, [*ids, None]))
    assert docs.n == len(ids) and len(docs.runs) <= MAX_RUNS
    assert all(any(a <= i <= b for a, b in docs.runs) for i in ids)
    assert write_ids(ids_of(spark, [])).runs == []


@pytest.mark.parametrize("ids", [[1], [0, -1, -32767, -32768, 5], [32768, 32769, 65536, 1 << 40], range(7, 90_000, 8)])
def test_bitmaps_test_exactly(spark, ids):
    asked = sorted({i + d for i in ids for d in (-1, 0, 1, 8, 32768)})
    found = test_bits(ids_of(spark, asked), bitmaps(ids_of(spark, list(ids))))
    assert sorted(r[0] for r in found.collect()) == sorted(set(asked) & set(ids))


@pytest.mark.parametrize("size, form", [(64 << 20, "ids"), (100_000, "bitmap"), (0, "shuffle")])
def test_forms_of_a_set_give_the_same(spark, monkeypatch, size, form):
    docs = write_ids(spark.range(0, 60_000, 3).withColumnRenamed("id", "doc_id"))
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
    rows = spark.range(70_000).selectExpr("id AS doc_id", "id * 2 AS x")
    found, stays = keep_documents(rows, docs)
    assert found.columns == ["doc_id", "x"] and found.count() == 20_000
    assert found.agg({"x": "sum"}).first()[0] == 2 * sum(range(0, 60_000, 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert stays == (form != "shuffle") and ("_bits" in plan) == (form == "bitmap")


def test_scattered_ids_reach_the_scan_as_runs(spark, tmp_path):
    path = str(tmp_path / "articles")
    table = spark.range(200_000).selectExpr("id AS doc_id", "cast(id AS string) AS content").coalesce(1)
    table.write.option("parquet.block.size", 64 << 10).parquet(path)
    ids = [2000 * k + (k * k) % 900 for k in range(0, 100, 1)]
    near = [i for i in ids if i < 30_000 or i > 170_000]  # two ends of the table
    articles = spark.read.parquet(path)
    found = fetch_articles(articles, ids_of(spark, near))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Or(" in plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert sorted(r["doc_id"] for r in found.collect()) == near

    def rows_read(frame):
        frame.collect()
        text = frame._jdf.queryExecution().executedPlan()
        leaves = text.collectLeaves() if "AdaptiveSparkPlan" not in text.getClass().getName() else text.finalPhysicalPlan().collectLeaves()
        return sum(
            leaves.apply(k).metrics().apply("numOutputRows").value()
            for k in range(leaves.size())
            if "Scan" in leaves.apply(k).nodeName() and "content" in leaves.apply(k).toString()
        )

    bounds = articles.where(f"doc_id BETWEEN {near[0]} AND {near[-1]}")
    assert rows_read(fetch_articles(articles, ids_of(spark, near))) < rows_read(bounds) / 2
