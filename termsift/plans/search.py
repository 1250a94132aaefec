"""Search: from a search string to ``(doc_id, url, title, snippet)``."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.functions.queries import as_query
from termsift.functions.snippets import best_hits, highlight, title_or_plain
from termsift.functions.words import STOP_WORDS
from termsift.operators.boolean import boolean_search, reach
from termsift.operators.doc_sets import DocSet, in_runs, keep_documents, write_ids
from termsift.operators.fetch import fetch_articles, matched_files, placed_ids
from termsift.schemas import RESULTS
from termsift.sources.lines import read_articles, read_file_ranges, read_index_shards

#: File names that a predicate on names may have; beyond it, all files are opened.
MAX_LISTED_FILES = 1000


def snippet_words(query: str) -> list[str]:
    """The words a snippet is chosen by: positive search words that are no stop words."""
    return [w for w in dict.fromkeys(as_query(query).positive) if w not in STOP_WORDS]


def with_snippets(
    articles: DataFrame, words: list[str], drop_empty_snippet: bool = True, keep: tuple = ()
) -> DataFrame:
    """Result rows of articles, each made from its own row alone, and further columns to ``keep``.

    The best piece is exploded from an array of one element or none, so it is computed once and
    rows without a hit fall away in the same step.
    """
    expand = F.explode if drop_empty_snippet else F.explode_outer
    if words:
        hits = best_hits(F.col("content"), words)
    else:
        hits = F.expr("CAST(array() AS array<struct<score:int,place:int,fragment:string>>)")
    best = articles.select("doc_id", "url", "title", *keep, expand(hits).alias("_best"))
    text = F.coalesce(highlight(F.col("_best.fragment"), words), F.lit(""))
    return best.select(
        "doc_id",
        "url",
        title_or_plain(F.col("title"), words).alias("title"),
        text.alias("snippet"),
        *keep,
    )


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, as words or inside others: a first, cheap test."""
    lower = F.lower(text)
    return F.coalesce(reduce(or_, [lower.contains(word) for word in words]), F.lit(False))


def _no_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULTS)


def find_matches(postings: DataFrame, query: str) -> DocSet:
    """The documents of a query, computed once and written."""
    bounds = reach(postings, query)
    return write_ids(boolean_search(postings, query, bounds) if bounds.n else postings.limit(0))


def search(
    articles: DataFrame,
    postings: DataFrame,
    query: str,
    drop_empty_snippet: bool = True,
    ordered: bool = True,
    ranges: DataFrame | None = None,
    matches: DocSet | None = None,
) -> DataFrame:
    """Articles that satisfy a query, with highlighted title and snippet.

    Article text is never shuffled. The matches are computed once and written. As ids or as a bitmap
    they are broadcast to the articles, and only those of matches are cut into pieces. A set beyond
    that is joined by a shuffle after every text has been cut down to its snippet, which needs no
    other row; texts without any of the words are not cut.

    A document is dropped when its content has none of the positive words, unless
    ``drop_empty_snippet`` is false. ``ordered`` sorts by document id; leave it out when writing a
    large result. With ``ranges``, articles have a ``file``, and an article is found only in the
    file of the range its id lies in, see ``fetch_articles``. ``matches`` are the documents of
    the query where they are known already.
    """
    words = snippet_words(query)
    if drop_empty_snippet and not words:
        return _no_results(articles.sparkSession)
    docs = matches or find_matches(postings, query)
    if not docs.n:
        return _no_results(articles.sparkSession)
    if ranges is None:
        found, stays = keep_documents(articles, docs)
        placed, keys = docs.ids, ["doc_id"]
    else:
        placed, stays = placed_ids(docs.ids, ranges)
        keys = ["doc_id", "file"]
        found = fetch_articles(articles, docs, ranges) if stays else articles
    if stays:
        results = with_snippets(found, words, drop_empty_snippet)
        # A sort samples its input first. Sampling rows that are already shuffled is cheap;
        # sampling here would read the articles twice.
        return results.repartition("doc_id").orderBy("doc_id") if ordered else results
    texts = articles.where(in_runs(F.col("doc_id"), docs.runs))
    if drop_empty_snippet:
        texts = texts.where(has_any(F.col("content"), words))
    results = with_snippets(texts, words, drop_empty_snippet, tuple(keys[1:]))
    results = results.join(placed, keys, "left_semi").select(*RESULTS.names)
    return results.orderBy("doc_id") if ordered else results


def search_files(
    spark: SparkSession,
    index_dir: str,
    ranges_path: str,
    articles_dir: str,
    query: str,
    **options,
) -> DataFrame:
    """Search over text files: index shards, a range file and a folder of article files.

    Only the shards of the search words are opened. Article files without matches are skipped by a
    predicate on their names, where these are few enough for one; the ranges decide in any case.
    A file that the ranges name and the folder does not have holds no articles.
    """
    compiled = as_query(query)
    postings = read_index_shards(spark, index_dir, sorted(set(compiled.words)))
    ranges = read_file_ranges(spark, ranges_path)
    matches = find_matches(postings, query)
    files = matched_files(matches.ids, ranges) if matches.n else ranges.select("file").limit(0)
    names = [row["file"] for row in files.limit(MAX_LISTED_FILES + 1).collect()]
    if not names:
        return _no_results(spark)
    articles = read_articles(spark, articles_dir)
    if len(names) <= MAX_LISTED_FILES:
        articles = articles.where(F.col("file").isin(sorted(names)))
    return search(articles, postings, query, ranges=ranges, matches=matches, **options)
