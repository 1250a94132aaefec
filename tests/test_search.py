import pytest
from data import ARTICLE_LINES, INDEX_LINES, RANGES
from pyspark.sql import functions as F

from termsift import __main__ as command
from termsift import cluster
from termsift.functions.snippets import best_fragment, fragments, highlight, snippet, title_or_plain
from termsift.plans import search as plan
from termsift.plans.search import search, search_files, snippet_words
from termsift.schemas import FILE_RANGES, LINES
from termsift.sources.index import build_postings
from termsift.sources.lines import parse_articles, parse_postings
from termsift.sources.sinks import result_line, write_results


@pytest.fixture(scope="module")
def articles(spark):
    return parse_articles(spark.createDataFrame([(line,) for line in ARTICLE_LINES], LINES)).cache()


@pytest.fixture(scope="module")
def postings(spark, articles):
    return build_postings(articles).cache()


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0]


def rows(results):
    return [tuple(r) for r in results.collect()]


TEXTS = [
    "",
    "short",
    "a b\nc\td " * 60,
    "x" * 250,
    "word " * 30 + "y" * 301 + " tail words " + "z" * 99,
    " " * 230 + "q" * 120 + " ",
    "é" * 100 + " " + "ü" * 101 + "\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fragments_lose_no_text(spark, text):
    pieces = one(spark, text, fragments)
    assert "".join(pieces) == text
    for piece in pieces:
        # A piece is longer only when it is a single run.
        assert len(piece) <= 101 or not piece[1:].rstrip().count(" ")


def test_word_after_a_long_run_is_found(spark):
    text = "x" * 300 + " cat " + "y" * 300
    assert "<B>cat</B>" in one(spark, text, lambda t: snippet(t, ["cat"]))
    assert one(spark, "cat" * 60, lambda t: snippet(t, ["cat" * 60])) == "<B>" + "cat" * 60 + "</B>"


def test_best_fragment(spark):
    first, second = "cat " + "x " * 48, "cat dog " + "y " * 40
    best = one(spark, first + second, lambda t: best_fragment(t, ["cat", "dog"]))
    assert best["fragment"].startswith("cat dog") and best["score"] == 2
    best = one(spark, first + first, lambda t: best_fragment(t, ["cat"]))
    assert best["place"] == 0  # the earlier one on ties
    best = one(spark, "cat cat cat", lambda t: best_fragment(t, ["cat"]))
    assert best["score"] == 1  # distinct words count
    assert one(spark, "", lambda t: best_fragment(t, ["cat"])) is None


def test_highlight(spark):
    marked = one(spark, "Cat, cats and CAT7 concat", lambda t: highlight(t, ["cat"]))
    assert marked == "<B>Cat</B>, cats and <B>CAT</B>7 concat"
    assert one(spark, "nothing", lambda t: highlight(t, [])) == "nothing"
    assert one(spark, "concat only", lambda t: snippet(t, ["cat"])) == ""
    assert one(spark, "Plain", lambda t: title_or_plain(t, ["cat"])) == "Plain"
    assert one(spark, "A Cat", lambda t: title_or_plain(t, ["cat"])) == "A <B>Cat</B>"


def test_snippet_words():
    assert snippet_words("the and cat or cat and not (dog or bird)") == ["cat"]


def test_search(articles, postings):
    assert rows(search(articles, postings, "cat and not bird")) == [
        (1, "http://x/1", "One", "A <B>cat</B> sat"),
        (2, "http://x/2", "<B>Cat</B> and dog", "The <B>cat</B>, the dog and a car"),
        (5, "http://x/5", "<B>Cat</B>", "<B>cat</B>"),
    ]


def test_result_line(articles, postings):
    found = rows(result_line(search(articles, postings, "cat and not (dog or sat)")))
    assert found == [("docID:5,URL:http://x/5,Title:<B>Cat</B>,Content:<B>cat</B>",)]


def test_empty_results_have_the_schema(articles, postings):
    for text in ["zzzz", "cat and zzzz", "the"]:
        found = search(articles, postings, text)
        assert found.columns == ["doc_id", "url", "title", "snippet"] and rows(found) == []


def test_stop_words_only_are_kept_on_request(articles, postings):
    found = search(articles, postings, "the", drop_empty_snippet=False)
    assert rows(found) == [(2, "http://x/2", "Cat and dog", "")]


@pytest.mark.parametrize("text", ["cat or dog", "car or not_there or sat", "the or cat"])
@pytest.mark.parametrize("drop", [True, False])
def test_large_results_equal_small_ones(articles, postings, monkeypatch, text, drop):
    text = text.replace("not_there", "zzzz")
    small = rows(search(articles, postings, text, drop_empty_snippet=drop))
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 0)
    large = search(articles, postings, text, drop_empty_snippet=drop)
    assert rows(large) == small and small
    executed = large._jdf.queryExecution().optimizedPlan().toString()
    # Only snippets go through the join.
    join = executed[executed.index("Join LeftSemi") :]
    assert "_best" in join


def test_no_python_in_the_plan(articles, postings):
    found = search(articles, postings, "cat and not bird")._jdf.queryExecution().executedPlan()
    assert "Python" not in found.toString() and "Arrow" not in found.toString()


def test_write_results(spark, articles, postings, tmp_path):
    write_results(search(articles, postings, "dog", ordered=False), str(tmp_path / "r"))
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {2, 3, 6}


@pytest.fixture(scope="module")
def text_files(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name in ("index", "articles"):
        (root / name).mkdir()
    for prefix in {line[:2].strip() for line in INDEX_LINES}:
        shard = [line for line in INDEX_LINES if line.split()[0][:2] == prefix]
        (root / "index" / f"invertedindex_{prefix}").write_text("\n".join(shard) + "\n")
    (root / "ranges.csv").write_text("".join(f"{f},{a},{b}\n" for f, a, b in RANGES))
    (root / "articles" / "w1").write_text("\n".join(ARTICLE_LINES[:3]) + "\n")
    (root / "articles" / "w2").write_text("\n".join(ARTICLE_LINES[4:]) + "\n")
    return root


@pytest.mark.parametrize("size", [64 << 20, 192, 0])
def test_ranges_decide_at_every_size(spark, monkeypatch, size):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
    rows_ = [(1, "w1"), (2, "w1"), (4, "w9"), (4, "w1"), (5, "w2")]
    articles = spark.createDataFrame(
        [(doc, "u", "t", "cat", file) for doc, file in rows_],
        "doc_id long, url string, title string, content string, file string",
    )
    own = build_postings(articles)
    ranges = spark.createDataFrame(list(RANGES), FILE_RANGES)
    assert [r[0] for r in rows(search(articles, own, "cat", ranges=ranges))] == [1, 2, 5]


@pytest.mark.parametrize("listed", [plan.MAX_LISTED_FILES, 1])
def test_search_files_ignores_gaps_and_absent_files(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(plan, "MAX_LISTED_FILES", listed)
    for name in ("index", "articles"):
        (tmp_path / name).mkdir()
    (tmp_path / "index" / "invertedindex_ca").write_text("cat 1 4 5 25\n")
    (tmp_path / "ranges.csv").write_text("w1,1,3\nw2,5,8\nabsent,20,30\n")
    for name, docs in (("w1", [1, 4]), ("w2", [5]), ("w9", [4])):
        lines = [f"{doc},http://x/{doc},T,cat" for doc in docs]
        (tmp_path / "articles" / name).write_text("\n".join(lines) + "\n")
    paths = [str(tmp_path / name) for name in ("index", "ranges.csv", "articles")]
    assert [r[0] for r in rows(search_files(spark, *paths, "cat"))] == [1, 5]


@pytest.mark.parametrize("listed", [plan.MAX_LISTED_FILES, 0])
def test_search_files(spark, text_files, monkeypatch, listed):
    monkeypatch.setattr(plan, "MAX_LISTED_FILES", listed)
    paths = [str(text_files / name) for name in ("index", "ranges.csv", "articles")]
    found = search_files(spark, *paths, "cat and not bird")
    assert [r[0] for r in rows(found)] == [1, 2, 5]
    assert rows(search_files(spark, *paths, "car and zzzz")) == []
    # Document 4 lies in no file.
    assert [r[0] for r in rows(search_files(spark, *paths, "car"))] == [2]


def test_command_line(spark, text_files, tmp_path, capsys):
    command.main(["search-files", "cat and not dog", *map(str, (
        text_files / "index", text_files / "ranges.csv", text_files / "articles"))])
    assert capsys.readouterr().out.splitlines() == [
        "docID:1,URL:http://x/1,Title:One,Content:A <B>cat</B> sat",
        "docID:5,URL:http://x/5,Title:<B>Cat</B>,Content:<B>cat</B>",
    ]
    (tmp_path / "lines.txt").write_text("\n".join(ARTICLE_LINES))
    command.main(["index", str(tmp_path / "lines.txt"), str(tmp_path / "ix")])
    command.main(["search", "dog and not cat", str(tmp_path / "ix")])
    assert "docID:6,URL:http://x/6,Title:Dogs,Content:<B>dog</B>" in capsys.readouterr().out
    command.main(["search", "zzzz", str(tmp_path / "ix")])
    assert "nothing is found" in capsys.readouterr().out
    command.main(["search", "dog", str(tmp_path / "ix"), "--output", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    bad = spark.read.text(str(tmp_path / "ix" / "bad_lines"))
    assert bad.count() == 2


def test_index_lines_give_the_same_search(spark, articles):
    postings = parse_postings(spark.createDataFrame([(line,) for line in INDEX_LINES], LINES))
    assert [r[0] for r in rows(search(articles, postings, "cat and dog"))] == [2, 3]


def test_ordering_reads_the_articles_once(spark, articles, postings):
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    counting = F.udf(count, "string").asNondeterministic()
    counted = articles.withColumn("content", counting("content"))
    assert len(rows(search(counted, postings, "cat or dog"))) == 5
    assert read.value == articles.count()  # a filter cannot move below the counting
