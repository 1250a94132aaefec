"""What must not grow faster than the input: read off plans and counts on small rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termsift.functions import queries as language
from termsift.sources import blocks, index, lines


def _plan(table) -> str:
    return table._jdf.queryExecution().executedPlan().toString()


def test_search_strings_carry_only_their_own_words(spark):
    words = [a + b + c for a in "abcdefghij" for b in "abcdefghij" for c in "klm"]
    texts = spark.createDataFrame([(4, " ".join(words)), (5, ""), (6, None)], "id bigint, text string")
    made = entry._queries(texts, "id")
    generate = next(line for line in _plan(made).splitlines() if "Generate explode" in line)
    assert "words#" not in generate.rsplit("), [", 1)[1]  # what is repeated into each row
    rows = {r["query_id"]: r["query"] for r in made.collect()}
    assert len(rows) == 77
    assert rows[400_001] == "{} and ({} or {}) and not {}".format(*words[4:8])
    assert rows[500_000] == "zzzz AND NOT (zzzz or zzzz) and zzzz"


def test_a_shape_of_search_strings_is_compiled_once(monkeypatch):
    compiled = []
    one = language.compile_query
    monkeypatch.setattr(language, "compile_query", lambda text: compiled.append(text) or one(text))
    monkeypatch.setattr(language, "_shapes", {}, raising=False)
    rows = [language._compile_row(f"a{c} and (b or Not a{c}) not {c}x") for c in "cdefg"]
    assert all(r[4] for r in rows)  # a fault is told for each string, with its own words
    compiled.clear()
    rows = [language._compile_row(f"a{c} AND ({c} or a{c}) not (é or {c})") for c in "cdefg"]
    assert len(compiled) == 1
    assert rows[4] == (["ag", "g", "é"], ["ag", "g", "ag"], [0, 1, 0, -2, -1, 2, 1, -2, -3], 3, None)


@pytest.mark.parametrize("text", ["x² and y", "½(a)", "aⅧb or c", "(a)) and"])
def test_runs_of_letters_are_cut_at_other_characters(text):
    expected, word = [], ""
    for c in text.lower() + " ":
        if word and not c.isalpha():
            expected.append(word)
        word = word + c if c.isalpha() else ""
        expected += [c] if c in "()" else []
    assert [run for _, run in language._runs(text)] == expected


def _postings(spark, n=300):
    own = [(F.lit("the"), 1), (F.lit("rare"), 50), (F.concat(F.lit("w"), F.col("id").cast("string")), 7)]
    ids = spark.range(n)
    parts = [ids.where(F.col("id") % k == 0).select(t.alias("term"), F.col("id").alias("doc_id")) for t, k in own]
    return parts[0].union(parts[1]).union(parts[2]).select("*", F.substring("term", 1, 2).alias("prefix"))


def _before_gathering(plan: str) -> list[str]:
    """Exchanges above the first gathering of ids, that is after it."""
    steps = [line for line in plan.splitlines() if "Exchange" in line or "collect_set" in line]
    last = max(i for i, line in enumerate(steps) if "collect_set" in line)
    return [line for line in steps[:last] if "Exchange" in line]


def test_postings_are_dealt_before_they_are_gathered(spark):
    postings = _postings(spark)
    for made in (blocks.build_blocks(postings, 16), lines.index_lines(postings, 16)):
        assert not _before_gathering(_plan(made))


def test_postings_are_dealt_to_tasks_that_can_sort_them(spark, tmp_path, monkeypatch):
    assert index.ROWS_PER_TASK * 150 < 1 << 29  # bytes of a row while it is sorted
    monkeypatch.setattr(index, "ROWS_PER_TASK", 20)
    postings = _postings(spark)
    n = postings.count()
    assert index.tasks_for(spark, n) >= n / 20
    dealt = blocks.build_blocks(postings, 16).withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() > 8
    lines.write_index_shards(postings, f"{tmp_path}/shards", 16)
    files = spark.read.text(f"{tmp_path}/shards/invertedindex_th").select("_metadata.file_name")
    assert files.distinct().count() > 1  # one prefix, several tasks
    read = lines.parse_postings(lines.read_lines(spark, f"{tmp_path}/shards/*"))
    found = sorted(map(tuple, read.collect()))
    assert found == sorted(map(tuple, postings.collect()))


def _listing_tasks(spark, step, group) -> list[int]:
    """Tasks of each job that a step runs."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        step()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    return [info.numTasks for info in map(tracker.getStageInfo, stages) if info]


def test_folders_of_article_files_are_listed_by_few_tasks(spark, tmp_path):
    ids = spark.range(0, 3000, 10).selectExpr("id as doc_id", "'u' url", "'t' title", "'c' content")
    index.write_articles(ids, f"{tmp_path}/articles", 10)
    usual = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    read = []
    step = lambda: read.append(index.read_article_files(spark, f"{tmp_path}/articles"))
    tasks = _listing_tasks(spark, step, f"listing {tmp_path}")
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 300
    assert read[0].select("file").distinct().count() == 300
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == usual


def test_article_files_are_listed_once(spark, tmp_path):
    rows = [(k, f"a text {k}", "s") for k in range(0, 6000, 100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    first = entry._article_files(spark, str(tmp_path))
    assert first.count() == 60
    assert not _listing_tasks(spark, lambda: entry._article_files(spark, str(tmp_path)), f"again {tmp_path}")
