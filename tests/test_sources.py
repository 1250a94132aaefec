import pytest
from data import ARTICLE_LINES, INDEX, INDEX_LINES, RANGES

from termsift.schemas import ARTICLES, LINES, POSTINGS
from termsift.sources.index import (
    build_file_ranges,
    build_postings,
    read_article_files,
    read_postings,
    write_articles,
    write_postings,
)
from termsift.sources.lines import (
    article_lines,
    bad_article_lines,
    bad_index_lines,
    index_lines,
    parse_articles,
    parse_postings,
    read_articles,
    read_file_ranges,
    read_index_shards,
    read_lines,
    write_index_shards,
)

PAIRS = {(term, i, term[:2]) for term, ids in INDEX.items() for i in ids}


def lines_of(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], LINES)


def rows_of(table):
    return {tuple(r) for r in table.collect()}


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


def test_index_lines(spark):
    postings = parse_postings(lines_of(spark, *INDEX_LINES))
    assert rows_of(postings) == PAIRS
    again = index_lines(postings, ids_per_line=2)
    assert rows_of(parse_postings(again)) == PAIRS
    assert max(len(r["value"].split()) for r in again.collect()) <= 3
    assert again.where("value LIKE 'cat %'").count() == 3


def test_index_lines_merge_and_keep_blanks_out(spark):
    lines = lines_of(spark, "cat 1 2", "cat\t3  ", "dog", "cow 4 x5")
    assert {(r[0], r[1]) for r in rows_of(parse_postings(lines))} == {
        ("cat", 1),
        ("cat", 2),
        ("cat", 3),
        ("cow", 4),
    }
    assert rows_of(bad_index_lines(lines)) == {("cow 4 x5",)}


def test_index_shards(spark, tmp_path):
    for prefix in {term[:2] for term in INDEX}:
        shard = [line for line in INDEX_LINES if line.split()[0][:2] == prefix]
        (tmp_path / f"invertedindex_{prefix}").write_text("\n".join(shard) + "\n")
    found = read_index_shards(spark, str(tmp_path), ["cat", "a", "zzzz"])
    assert rows_of(found) == {row for row in PAIRS if row[0] in ("cat", "a")}
    assert rows_of(read_index_shards(spark, str(tmp_path), ["zzzz"])) == set()
    assert {f.rsplit("_")[-1] for f in found.inputFiles()} == {"ca", "a"}


def test_articles(spark):
    lines = lines_of(spark, *ARTICLE_LINES, "9,http://x/9", "10,u,t")
    found = {r["doc_id"]: tuple(r)[1:] for r in parse_articles(lines).collect()}
    assert found[2] == ("http://x/2", "Cat and dog", "The cat, the dog and a car")
    assert found[8] == ("http://x/8", "Empty", "")
    assert found[9] == ("http://x/9", None, None)
    assert found[10] == ("u", "t", None)
    assert found.keys() == {1, 2, 3, 4, 5, 6, 8, 9, 10}
    assert rows_of(bad_article_lines(lines)) == {("no-comma-line",), ("x7,http://x/7,Bad id,cat",)}


def test_article_lines(spark):
    articles = spark.createDataFrame([(1, "u", "t", "a,b\nc")], ARTICLES)
    assert rows_of(parse_articles(article_lines(articles))) == {(1, "u", "t", "a,b c")}


def test_read_articles_names_the_file(spark, tmp_path):
    (tmp_path / "w1").write_text("\n".join(ARTICLE_LINES[:3]))
    (tmp_path / "w2").write_text("\n".join(ARTICLE_LINES[4:]))
    ranges = build_file_ranges(read_articles(spark, str(tmp_path)))
    assert rows_of(ranges) == {("w1", 1, 3), ("w2", 5, 8)}


def test_file_ranges(spark, tmp_path):
    (tmp_path / "ranges.csv").write_text("".join(f"{f},{a},{b}\n" for f, a, b in RANGES))
    assert rows_of(read_file_ranges(spark, str(tmp_path / "ranges.csv"))) == set(RANGES)


def test_written_postings(spark, tmp_path):
    articles = parse_articles(lines_of(spark, *ARTICLE_LINES))
    postings = build_postings(articles)
    write_postings(postings, str(tmp_path / "p"))
    assert rows_of(read_postings(spark, str(tmp_path / "p"))) == rows_of(postings)
    assert ("the", 2, "th") in rows_of(postings) and ("a", 1, "a") in rows_of(postings)

    some = read_postings(spark, str(tmp_path / "p"), ["cat", "dog", "zzzz"])
    assert {r[0] for r in rows_of(some)} == {"cat", "dog"}
    plan = plan_of(some)
    assert "PartitionFilters: [prefix" in plan and "In(term, [cat,dog,zzzz])" in plan
    assert all("prefix=ca" in f or "prefix=do" in f for f in some.inputFiles())
    assert rows_of(read_postings(spark, str(tmp_path / "p"), ["zzzz"])) == set()


def test_common_term_is_spread_over_files(spark, tmp_path):
    common = spark.range(4000).selectExpr("'the' AS term", "id AS doc_id", "'th' AS prefix")
    rare = spark.range(2000).selectExpr("concat('r', id) AS term", "id AS doc_id", "'ra' AS prefix")
    write_postings(common.union(rare), str(tmp_path / "p"))
    found = read_postings(spark, str(tmp_path / "p"))
    assert found.count() == 6000
    assert len(list((tmp_path / "p" / "prefix=th").glob("*.parquet"))) > 3


def test_written_articles(spark, tmp_path):
    articles = spark.range(95).selectExpr(
        "id AS doc_id", "'u' AS url", "'t' AS title", "concat('c', id) AS content"
    )
    write_articles(articles, str(tmp_path / "a"), ids_per_file=10)
    found = read_article_files(spark, str(tmp_path / "a"))
    assert rows_of(found.drop("file")) == rows_of(articles)
    assert rows_of(build_file_ranges(found)) == {
        (f"part_{i}", i * 10, min(i * 10 + 9, 94)) for i in range(10)
    }


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x y\n\nz\n")
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["x y", "", "z"]


@pytest.mark.parametrize("path", ["p", "a"])
def test_existing_output_is_kept(spark, tmp_path, path):
    (tmp_path / path).mkdir()
    articles = parse_articles(lines_of(spark, *ARTICLE_LINES))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        if path == "p":
            write_postings(build_postings(articles), str(tmp_path / path))
        else:
            write_articles(articles, str(tmp_path / path))


def test_written_index_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [("common", k) for k in range(5000)] + [("cat", 3), ("cat", 4), ("c", 9), ("école", 2), ("dog", -1)]
    postings = spark.createDataFrame([(t, d, t[:2]) for t, d in rows], POSTINGS)
    write_index_shards(postings, path, ids_per_line=100)
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == [
        "invertedindex_c", "invertedindex_ca", "invertedindex_co", "invertedindex_do", "invertedindex_éc",
    ]
    found = read_index_shards(spark, path, ["cat", "common", "école", "dog", "c", "zzzz"])
    assert sorted((r.term, r.doc_id) for r in found.collect()) == sorted(rows)
    assert max(len(r.value.split()) for r in read_lines(spark, path + "/*").collect()) <= 101
    with pytest.raises(FileExistsError):
        write_index_shards(postings, path)


def test_shards_that_fail_leave_nothing(spark, tmp_path):
    postings = spark.range(3).selectExpr(
        "'ab' AS term", "cast(raise_error('broken') AS bigint) AS doc_id", "'ab' AS prefix"
    )
    with pytest.raises(Exception, match="broken"):
        write_index_shards(postings, str(tmp_path / "shards"))
    assert not [p for p in (tmp_path / "shards").glob("*")]
