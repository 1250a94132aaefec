"""

The given tables play these parts: ``documents`` and ``pages`` are the articles, the inverted
index and the file ranges are built from them, and search strings are made from ``documents`` and
``benchmark``. Written inputs (index, article files, text lines) go to the scratch folder of the
session, once per application and data folder.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.cluster import scratch_dir, spread
from termsift.functions.queries import compile_queries, query_tokens, search_words
from termsift.functions.snippets import (
    best_fragment,
    highlight,
    snippet,
    title_or_plain,
)
from termsift.functions.words import STOP_WORDS, drop_stop_words, letter_runs
from termsift.operators.boolean import (
    boolean_search,
    boolean_search_batch,
    boolean_search_blocks,
    matched_terms,
)
from termsift.operators.counts import (
    split_lines,
    split_words,
    term_chunks,
    terms_by_prefix,
    word_count,
)
from termsift.operators.fetch import doc_file_ranges, fetch_articles, matched_files
from termsift.operators.sets import (
    bool_and,
    bool_and_not,
    bool_or,
    cast_doc_id,
    no_match,
    sort_doc_ids,
)
from termsift.plans.search import search, search_files, with_snippets
from termsift.plans.word_count import word_count_job
from termsift.sources.blocks import block_postings, build_blocks, read_blocks, write_blocks
from termsift.sources.index import (
    build_file_ranges,
    build_postings,
    filter_terms,
    read_article_files,
    read_postings,
    write_articles,
    write_postings,
)
from termsift.sources.lines import (
    article_lines,
    index_lines,
    parse_articles,
    parse_postings,
    read_articles,
    read_file_ranges,
    read_index_shards,
    read_lines,
    write_index_shards,
)
from termsift.sources.sinks import result_line, write_results, write_word_count

IDS_PER_FILE = 100

# Search strings and the words they use. Snippet words avoid stop words.
AND_NOT_QUERY = "from and not than"
GROUPED_QUERY = "from and (than or tion) and not erin"
WORDS = ["erin", "from", "nicht", "than", "tion"]
SNIPPET_WORDS = ["from", "nicht", "than"]


# -- the given tables as articles -------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles; the title is the first line."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as articles: markup becomes blanks."""
    bare = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return spread(_table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("doc_id"),
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_replace(bare, "<[^>]*>", " ").alias("content"),
    )


_written: dict[tuple, str] = {}


def _once(
    spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]
) -> str:
    """Path of a table written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def _index(spark: SparkSession, sf_dir: str, articles: Callable = documents) -> str:
    return _once(
        spark,
        sf_dir,
        f"postings_{articles.__name__}",
        lambda path: write_postings(build_postings(articles(spark, sf_dir)), path),
    )


def _postings(
    spark: SparkSession, sf_dir: str, words: list[str], articles: Callable = documents
) -> DataFrame:
    return read_postings(spark, _index(spark, sf_dir, articles), words)


def _blocks(spark: SparkSession, sf_dir: str, words: list[str] | None = None) -> DataFrame:
    path = _once(
        spark,
        sf_dir,
        "blocks",
        lambda path: write_blocks(build_blocks(build_postings(documents(spark, sf_dir))), path),
    )
    return read_blocks(spark, path, words)


def _shards(spark: SparkSession, sf_dir: str) -> str:
    return _once(
        spark,
        sf_dir,
        "shards",
        lambda path: write_index_shards(build_postings(documents(spark, sf_dir)), path),
    )


_listed: dict[tuple, DataFrame] = {}


def _article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written article files; their many folders are listed once, too."""
    path = _once(
        spark,
        sf_dir,
        "articles",
        lambda path: write_articles(documents(spark, sf_dir), path, IDS_PER_FILE),
    )
    if (spark, path) not in _listed:
        _listed[spark, path] = read_article_files(spark, path)
    return _listed[spark, path]


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        build_file_ranges(_article_files(spark, sf_dir)).write.csv(path)

    return read_file_ranges(spark, _once(spark, sf_dir, "ranges", write))


def _gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file ranges without the first ten ids of each file: these lie in no range."""
    return _ranges(spark, sf_dir).withColumn("begin_id", F.col("begin_id") + 10)


def _text_lines(spark: SparkSession, sf_dir: str) -> str:
    lines = split_lines(spread(_table(spark, sf_dir, "documents").select("text")))
    return _once(spark, sf_dir, "lines", lambda path: lines.write.text(path))


def _query_of(w: list[Column], number: Column) -> Column:
    """A search string of four words, in one of four shapes."""
    w = [F.coalesce(word, F.lit("zzzz")) for word in w]
    shapes = [
        F.format_string("%s and (%s or %s) and not %s", *w),
        F.format_string("%s AND NOT (%s or %s) and %s", *w),
        F.format_string("(%s or %s) not (%s and (%s or %s))", *w, w[0]),
        F.format_string("((%s)) and %s or %s and not ((%s or %s) or %s)", *w[:3], w[1], w[3], w[0]),
    ]
    kind = F.pmod(number, F.lit(4))
    return F.coalesce(*[F.when(kind == i, shape) for i, shape in enumerate(shapes)])


def _queries(table: DataFrame, number: str) -> DataFrame:
    """Search strings of every four distinct words of a text; all of its words are in one."""
    reserved = F.array(F.lit("and"), F.lit("or"), F.lit("not"))
    words = table.select(number, F.array_except(letter_runs(F.col("text")), reserved).alias("words"))
    last = F.greatest(F.size("words") - 1, F.lit(0))
    # Only the four words of a query are repeated into its row: with all words of the text in each of
    # its rows, the work grows with the square of a text.
    four = lambda at: F.struct(
        at.alias("at"), *[F.get(F.col("words"), at + i).alias(f"w{i}") for i in range(4)]
    )
    starts = F.sequence(F.lit(0), last, F.lit(4))
    grouped = words.select(number, F.explode(F.transform(starts, four)).alias("own"))
    own = [F.col(f"own.w{i}") for i in range(4)]
    query_id = F.col(number) * 100_000 + (F.col("own.at") / 4).cast("long")
    return grouped.select(query_id.alias("query_id"), _query_of(own, F.col(number)).alias("query"))


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(_table(spark, sf_dir, "benchmark"), "item_id")


# -- queries ----------------------------------------------------------------------------------


def _hits(query: str, words: list[str], articles: Callable = documents) -> Callable:
    return lambda spark, sf: boolean_search(_postings(spark, sf, words, articles), query)


def _ids(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    return boolean_search(_postings(spark, sf_dir, [word]), word)


def _search(query: str, words: list[str], articles: Callable = documents) -> Callable:
    return lambda spark, sf: search(
        articles(spark, sf), _postings(spark, sf, words, articles), query
    )


_and_not_hits = _hits(AND_NOT_QUERY, ["from", "than"])
_grouped_hits = _hits(GROUPED_QUERY, ["from", "than", "tion", "erin"])
_flagship = _search(AND_NOT_QUERY, ["from", "than"])


def _read_lines(spark, sf):
    return read_lines(spark, _text_lines(spark, sf))


def _parse_postings(spark, sf):
    path = _once(
        spark,
        sf,
        "index_lines",
        lambda path: index_lines(build_postings(documents(spark, sf))).select("value").write.text(path),
    )
    return parse_postings(read_lines(spark, path))


def _read_articles(spark, sf):
    path = _once(
        spark,
        sf,
        "article_lines",
        lambda path: article_lines(documents(spark, sf)).write.text(path),
    )
    return read_articles(spark, path).drop("file")


def _search_files(spark, sf):
    """Search over text alone: shards, a range file, and files of article lines in order of id."""

    def write_lines(path: str) -> None:
        own = documents(spark, sf)
        files = max(8, own.rdd.getNumPartitions())  # as many as the texts have pieces, so none grows
        own = own.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
        article_lines(own).write.text(path)

    texts = _once(spark, sf, "sorted_lines", write_lines)
    ranges = _once(
        spark,
        sf,
        "line_ranges",
        lambda path: build_file_ranges(read_articles(spark, texts)).write.csv(path),
    )
    return search_files(spark, _shards(spark, sf), ranges, texts, AND_NOT_QUERY)


def _articles_pruned(spark, sf):
    found = fetch_articles(_article_files(spark, sf), _grouped_hits(spark, sf), _ranges(spark, sf))
    return found.select("doc_id", "url", "title", "content", "file")


def _word_counts(spark, sf):
    texts = spread(_table(spark, sf, "documents").select("text"))
    return word_count(split_words(split_lines(texts)))


def _write_word_count(spark, sf):
    path = scratch_dir(spark, "word_count")
    write_word_count(_word_counts(spark, sf), path)
    return read_lines(spark, path)


def _word_count_job(spark, sf):
    path = scratch_dir(spark, "word_count_job")
    word_count_job(spark, _text_lines(spark, sf), path)
    fields = [F.regexp_extract("value", r"^\((.*),(\d+)\)$", i) for i in (1, 2)]
    return read_lines(spark, path).select(
        fields[0].alias("word"), fields[1].cast("bigint").alias("n")
    )


def _write_results(spark, sf):
    path = scratch_dir(spark, "results")
    words = ["from", "than"]
    found = search(
        documents(spark, sf), _postings(spark, sf, words), AND_NOT_QUERY, ordered=False
    )
    write_results(found, path)
    return spark.read.parquet(path)


def _cast_doc_id(spark, sf):
    return _table(spark, sf, "documents").select(
        cast_doc_id(F.col("doc_id").cast("string")).alias("doc_id"),
        cast_doc_id(F.col("source")).isNull().alias("source_is_no_number"),
    )


def _positive_words(spark, sf):
    return compile_queries(document_queries(spark, sf)).select(
        "query_id", F.array_join("positive", " ").alias("words")
    )


def _terms_by_prefix(spark, sf):
    terms = document_queries(spark, sf).select(
        "query_id", F.explode(search_words(F.col("query"))).alias("term")
    )
    return terms_by_prefix(terms, "query_id").withColumn("terms", F.array_join("terms", " "))


def _matched_terms(spark, sf):
    found = matched_terms(_postings(spark, sf, WORDS), WORDS)
    return found.withColumn("terms", F.array_join("terms", " "))


def _best_fragment(spark, sf):
    best = best_fragment(F.col("content"), SNIPPET_WORDS)
    return documents(spark, sf).select("doc_id", F.explode(F.array(best)).alias("b")).select(
        "doc_id", F.col("b.score").cast("bigint").alias("score"), F.col("b.fragment").alias("fragment")
    )


def _article_column(name: str, source: str, make: Callable[[Column], Column]) -> Callable:
    return lambda spark, sf: documents(spark, sf).select(
        "doc_id", make(F.col(source)).alias(name)
    )


def _joined(name: str, words: Column) -> Column:
    return F.array_join(words, " ").alias(name)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: documents with ``from`` but not ``than``, with highlighted snippets."""
    return _flagship(spark, "/root/testdata/sf0.001")


try:
    import corpus_pipeline
    from termsift.llm import queries as llm_queries
except ImportError as missing:  # the folders, or one of the libraries they need, are not there
    warnings.warn(f"no operators for training data: {missing}", stacklevel=1)
    corpus_pipeline = llm_queries = None


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Operators for training data, when their subpackage is there."""
    return llm_queries.queries() | {"pipeline": corpus_pipeline.run} if llm_queries else {}


def _llm_oracle_sql() -> dict[str, str]:
    if not llm_queries:
        return {}
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return llm_queries.oracle_sql() | own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _llm_queries() | {
        # Sources and sinks
        "read_lines": _read_lines,
        "parse_postings": _parse_postings,
        "postings_pruned": lambda spark, sf: _postings(spark, sf, WORDS),
        "read_articles": _read_articles,
        "read_file_ranges": _ranges,
        "articles_pruned": _articles_pruned,
        "write_word_count": _write_word_count,
        "write_results": _write_results,
        "build_postings": lambda spark, sf: build_postings(documents(spark, sf)),
        "build_blocks": lambda spark, sf: block_postings(_blocks(spark, sf)),
        "blocks_pruned": lambda spark, sf: block_postings(_blocks(spark, sf, WORDS)),
        "write_index_shards": lambda spark, sf: parse_postings(
            read_lines(spark, f"{_shards(spark, sf)}/*")
        ),
        "index_shards_pruned": lambda spark, sf: read_index_shards(spark, _shards(spark, sf), WORDS),
        "build_postings_pages": lambda spark, sf: build_postings(pages(spark, sf)),
        "build_file_ranges": lambda spark, sf: build_file_ranges(_article_files(spark, sf)),
        # Projections and filters
        "split_words": lambda spark, sf: split_words(_read_lines(spark, sf)),
        "filter_terms": lambda spark, sf: filter_terms(build_postings(documents(spark, sf)), WORDS),
        "cast_doc_id": _cast_doc_id,
        "article_fields": lambda spark, sf: parse_articles(article_lines(documents(spark, sf))),
        "drop_empty_snippet": lambda spark, sf: with_snippets(documents(spark, sf), SNIPPET_WORDS),
        "query_tokens": lambda spark, sf: document_queries(spark, sf).select(
            "query_id", F.array_join(query_tokens(F.col("query")), "|").alias("tokens")
        ),
        "query_tokens_text": lambda spark, sf: spread(
            _table(spark, sf, "documents").select("doc_id", "text")
        ).select("doc_id", F.array_join(query_tokens(F.col("text")), "|").alias("tokens")),
        "search_words": lambda spark, sf: document_queries(spark, sf).select(
            "query_id", _joined("words", search_words(F.col("query")))
        ),
        "positive_words": _positive_words,
        "result_line": lambda spark, sf: result_line(_flagship(spark, sf)),
        # Set operations and boolean search
        "bool_and": lambda spark, sf: bool_and(_ids(spark, sf, "from"), _ids(spark, sf, "than")),
        "bool_or": lambda spark, sf: bool_or(_ids(spark, sf, "from"), _ids(spark, sf, "nicht")),
        "bool_and_not": lambda spark, sf: bool_and_not(
            _ids(spark, sf, "from"), _ids(spark, sf, "than")
        ),
        "boolean_search": _grouped_hits,
        "boolean_search_and": _hits("from and than", ["from", "than"]),
        "boolean_search_or": _hits("from or nicht", ["from", "nicht"]),
        "boolean_search_and_not": _and_not_hits,
        "boolean_search_left_to_right": _hits(
            "from or than and nicht", ["from", "than", "nicht"]
        ),
        "boolean_search_long": _hits(
            "from or than and erin or nicht", ["from", "than", "erin", "nicht"]
        ),
        "boolean_search_unknown": _hits("zzzz or from", ["zzzz", "from"]),
        "boolean_search_none": _hits("from and zzzz", ["zzzz", "from"]),
        "boolean_search_pages": _hits(GROUPED_QUERY, ["from", "than", "tion", "erin"], pages),
        "boolean_search_blocks": lambda spark, sf: boolean_search_blocks(
            _blocks(spark, sf, ["from", "than", "tion", "erin"]), GROUPED_QUERY
        ),
        "boolean_search_blocks_rare": lambda spark, sf: boolean_search_blocks(
            _blocks(spark, sf, ["erin", "from"]), "erin and from"
        ),
        "boolean_search_batch": lambda spark, sf: boolean_search_batch(
            read_postings(spark, _index(spark, sf)), benchmark_queries(spark, sf)
        ),
        # Joins
        "doc_file_ranges": lambda spark, sf: doc_file_ranges(
            _grouped_hits(spark, sf), _ranges(spark, sf)
        ),
        "fetch_articles": lambda spark, sf: fetch_articles(
            documents(spark, sf), _grouped_hits(spark, sf)
        ),
        # Aggregations
        "word_count": _word_counts,
        "terms_by_prefix": _terms_by_prefix,
        "term_chunks": lambda spark, sf: term_chunks(build_postings(documents(spark, sf))).select(
            "prefix", F.explode("terms").alias("term")
        ),
        "matched_terms": _matched_terms,
        "matched_files": lambda spark, sf: matched_files(
            _grouped_hits(spark, sf), _ranges(spark, sf)
        ),
        "no_match": lambda spark, sf: no_match(
            boolean_search(_postings(spark, sf, ["from", "zzzz"]), "from and zzzz")
        ),
        # Order and text
        "sort_doc_ids": lambda spark, sf: sort_doc_ids(_grouped_hits(spark, sf)),
        "best_fragment": _best_fragment,
        "snippet": _article_column("snippet", "content", lambda c: snippet(c, SNIPPET_WORDS)),
        "highlight": _article_column("text", "content", lambda c: highlight(c, SNIPPET_WORDS)),
        "title_or_plain": _article_column(
            "title", "title", lambda c: title_or_plain(c, SNIPPET_WORDS)
        ),
        "drop_stop_words": _article_column(
            "words",
            "content",
            lambda c: F.array_join(F.sort_array(drop_stop_words(letter_runs(c))), " "),
        ),
        # End to end
        "search": _flagship,
        "search_grouped": _search(GROUPED_QUERY, ["from", "than", "tion", "erin"]),
        "search_stop_word": lambda spark, sf: search(
            documents(spark, sf), _postings(spark, sf, ["that"]), "that", drop_empty_snippet=False
        ),
        "search_ranges": lambda spark, sf: search(
            _article_files(spark, sf), _postings(spark, sf, ["from", "than"]), AND_NOT_QUERY,
            ranges=_gap_ranges(spark, sf),
        ),
        "fetch_articles_ranges": lambda spark, sf: fetch_articles(
            _article_files(spark, sf), _grouped_hits(spark, sf), _gap_ranges(spark, sf)
        ),
        "search_files": _search_files,
        "search_pages": _search(AND_NOT_QUERY, ["from", "than"], pages),
        "word_count_job": _word_count_job,
    }


# -- the same in SQL --------------------------------------------------------------------------

_DOCUMENTS = """documents_articles AS (
  SELECT doc_id, 'doc://' || source || '/' || doc_id AS url, split_part(text, chr(10), 1) AS title,
         text AS content
  FROM documents)"""

_PAGES = r"""pages_articles AS (
  SELECT page_id AS doc_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_replace(
           regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
           '<[^>]*>', ' ', 'g') AS content
  FROM pages)"""

_RUNS = r"regexp_extract_all(lower({}), '\p{{L}}+')"


def _with(articles: str = "documents") -> str:
    source = _DOCUMENTS if articles == "documents" else _PAGES
    return f"""WITH {source},
postings AS (
  SELECT DISTINCT term, doc_id, substring(term, 1, 2) AS prefix
  FROM (SELECT doc_id, unnest({_RUNS.format("content")}) AS term FROM {articles}_articles))"""


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _set(word: str) -> str:
    return f"(SELECT doc_id FROM postings WHERE term = '{word}')"


#: Each search string as set operations, so that the SQL does not share the method of the search.
_SETS = {
    "from and than": f"{_set('from')} INTERSECT {_set('than')}",
    "from or nicht": f"{_set('from')} UNION {_set('nicht')}",
    AND_NOT_QUERY: f"{_set('from')} EXCEPT {_set('than')}",
    GROUPED_QUERY: f"({_set('from')} INTERSECT ({_set('than')} UNION {_set('tion')}))"
    f" EXCEPT {_set('erin')}",
    "from or than and nicht": f"({_set('from')} UNION {_set('than')}) INTERSECT {_set('nicht')}",
    "from or than and erin or nicht": f"(({_set('from')} UNION {_set('than')}) INTERSECT"
    f" {_set('erin')}) UNION {_set('nicht')}",
    "zzzz or from": f"{_set('zzzz')} UNION {_set('from')}",
    "from and zzzz": f"{_set('from')} INTERSECT {_set('zzzz')}",
    "that": f"{_set('that')}",
    "erin and from": f"{_set('erin')} INTERSECT {_set('from')}",
}


def _sql_hits(query: str, articles: str = "documents") -> str:
    return f"{_with(articles)},\nhits AS (SELECT doc_id FROM ({_SETS[query]}))"


def _sql_boolean(query: str, articles: str = "documents") -> str:
    return f"{_sql_hits(query, articles)}\nSELECT doc_id FROM hits"


_PIECES = (
    r"regexp_extract_all({}, '(?s).{{1,100}}(?:[ \t\n\f\r]|\z)|.[^ \t\n\f\r]*(?:[ \t\n\f\r]|\z)')"
)


def _sql_best(name: str, source: str, column: str, words: list[str]) -> str:
    """Best piece of a column as common table expressions; one row per document with text."""
    runs = _RUNS.format("piece")
    return f"""{name}_pieces AS (
  SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, {_PIECES.format(column)} AS l FROM {source})),
{name}_scored AS (
  SELECT *, len(list_intersect({runs}, [{_list(words)}]::VARCHAR[])) AS score FROM {name}_pieces),
{name} AS (
  SELECT doc_id, piece, score FROM {name}_scored
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1)"""


def _sql_marked(column: str, words: list[str]) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({column}, '\p{{L}}+|\P{{L}}+'), "
        f"lambda p: CASE WHEN list_contains([{_list(words)}], lower(p)) "
        "THEN '<B>' || p || '</B>' ELSE p END), '')"
    )


def _sql_snippets(ctes: str, source: str, words: list[str]) -> str:
    """Result rows of a table of articles, hits only."""
    return f"""{ctes},
{_sql_best("title_best", source, "title", words)},
{_sql_best("content_best", source, "content", words)},
results AS (
  SELECT a.doc_id, a.url,
         CASE WHEN t.score > 0 THEN {_sql_marked("t.piece", words)} ELSE a.title END AS title,
         {_sql_marked("c.piece", words)} AS snippet
  FROM {source} a JOIN content_best c USING (doc_id) LEFT JOIN title_best t USING (doc_id)
  WHERE c.score > 0)"""


def _sql_search(query: str, words: list[str], articles: str = "documents") -> str:
    found = f"found AS (SELECT a.* FROM {articles}_articles a JOIN hits USING (doc_id))"
    return _sql_snippets(f"{_sql_hits(query, articles)},\n{found}", "found", words)


_LINES = r"SELECT unnest(string_split(text, chr(10))) AS value FROM documents"

_LINE_WORDS = f"""SELECT unnest(CASE WHEN value = '' THEN ['']
    WHEN rtrim(value, ' ') = '' THEN []::VARCHAR[]
    ELSE string_split(rtrim(value, ' '), ' ') END) AS word FROM ({_LINES})"""

_FILES = f"file_of AS (SELECT doc_id, 'part_' || (doc_id // {IDS_PER_FILE}) AS file FROM documents)"

_ARTICLE_LINES = r"""article_lines AS (
  SELECT regexp_replace(doc_id || ',' || url || ',' || title || ',' || content,
                        '[\r\n]', ' ', 'g') AS line
  FROM documents_articles)"""

_ARTICLE_FIELDS = r"""SELECT
  CAST(regexp_extract(line, '^([^,]*),', 1) AS BIGINT) AS doc_id,
  nullif(regexp_extract(line, '^[^,]*,([^,]*)', 1), '') AS url,
  CASE WHEN line LIKE '%,%,%' THEN regexp_extract(line, '^[^,]*,[^,]*,([^,]*)', 1) END AS title,
  CASE WHEN line LIKE '%,%,%,%'
       THEN regexp_extract(line, '^[^,]*,[^,]*,[^,]*,(.*)$', 1) END AS content
FROM article_lines"""


def _sql_query_words(table: str, number: str) -> str:
    """Every four distinct words of each text, operators left out."""
    words = ",\n".join(
        f"         coalesce(max(r.term) FILTER ((r.r - 1) % 4 = {i}), 'zzzz') AS w{i + 1}" for i in range(4)
    )
    return f"""tokens AS (
  SELECT {number} AS query_id, unnest(l) AS term, generate_subscripts(l, 1) AS i
  FROM (SELECT {number}, {_RUNS.format("text")} AS l FROM {table})),
firsts AS (
  SELECT query_id, term, min(i) AS i FROM tokens
  WHERE term NOT IN ('and', 'or', 'not') GROUP BY query_id, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM firsts),
shaped AS (
  SELECT t.{number} * 100000 + coalesce((r.r - 1) // 4, 0) AS query_id, t.{number} % 4 AS shape,
{words}
  FROM {table} t LEFT JOIN ranked r ON r.query_id = t.{number}
  GROUP BY t.{number}, coalesce((r.r - 1) // 4, 0))"""


def _sql_shapes(name: str, shapes: list[str], join: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN concat_ws('{join}', {shape})" for i, shape in enumerate(shapes)
    )
    return f"""WITH {_sql_query_words("documents", "doc_id")}
SELECT query_id, CASE shape {cases} END AS {name} FROM shaped"""


def oracle_sql() -> dict[str, str]:
    grouped = f"{_sql_hits(GROUPED_QUERY)},\n{_FILES}"
    flagship = _sql_search(AND_NOT_QUERY, ["from"])
    all_best = f"WITH {_DOCUMENTS},\n" + _sql_best(
        "best", "documents_articles", "content", SNIPPET_WORDS
    )
    title_best = f"WITH {_DOCUMENTS},\n" + _sql_best(
        "best", "documents_articles", "title", SNIPPET_WORDS
    )
    return _llm_oracle_sql() | {
        "read_lines": _LINES,
        "parse_postings": f"{_with()}\nSELECT term, doc_id, prefix FROM postings",
        "postings_pruned": f"{_with()}\nSELECT term, doc_id, prefix FROM postings"
        f" WHERE term IN ({_list(WORDS)})",
        "read_articles": f"WITH {_DOCUMENTS},\n{_ARTICLE_LINES}\n{_ARTICLE_FIELDS}",
        "read_file_ranges": f"WITH {_FILES}\nSELECT file, min(doc_id) AS begin_id,"
        " max(doc_id) AS end_id FROM file_of GROUP BY file",
        "articles_pruned": f"{grouped}\nSELECT a.*, file FROM documents_articles a"
        " JOIN hits USING (doc_id) JOIN file_of USING (doc_id)",
        "write_word_count": "SELECT '(' || word || ',' || count(*) || ')' AS value"
        f" FROM ({_LINE_WORDS}) GROUP BY word",
        "write_results": f"{flagship}\nSELECT * FROM results",
        "build_postings": f"{_with()}\nSELECT term, doc_id, prefix FROM postings",
        "build_blocks": f"{_with()}\nSELECT term, doc_id, prefix FROM postings",
        "blocks_pruned": f"{_with()}\nSELECT term, doc_id, prefix FROM postings"
        f" WHERE term IN ({_list(WORDS)})",
        "write_index_shards": f"{_with()}\nSELECT term, doc_id, prefix FROM postings",
        "index_shards_pruned": f"{_with()}\nSELECT term, doc_id, prefix FROM postings"
        f" WHERE term IN ({_list(WORDS)})",
        "build_postings_pages": f"{_with('pages')}\nSELECT term, doc_id, prefix FROM postings",
        "build_file_ranges": f"WITH {_FILES}\nSELECT file, min(doc_id) AS begin_id,"
        " max(doc_id) AS end_id FROM file_of GROUP BY file",
        "split_words": _LINE_WORDS,
        "filter_terms": f"{_with()}\nSELECT term, doc_id, prefix FROM postings"
        f" WHERE term IN ({_list(WORDS)})",
        "cast_doc_id": "SELECT TRY_CAST(CAST(doc_id AS VARCHAR) AS BIGINT) AS doc_id,"
        " TRY_CAST(source AS BIGINT) IS NULL AS source_is_no_number FROM documents",
        "article_fields": f"WITH {_DOCUMENTS},\n{_ARTICLE_LINES}\n{_ARTICLE_FIELDS}",
        "drop_empty_snippet": _sql_snippets(
            f"WITH {_DOCUMENTS}", "documents_articles", SNIPPET_WORDS
        )
        + "\nSELECT * FROM results",
        "query_tokens": _sql_shapes(
            "tokens",
            [
                "w1, 'and', '(', w2, 'or', w3, ')', 'and not', w4",
                "w1, 'and not', '(', w2, 'or', w3, ')', 'and', w4",
                "'(', w1, 'or', w2, ')', 'and not', '(', w3, 'and', '(', w4, 'or', w1, ')', ')'",
                "'(', '(', w1, ')', ')', 'and', w2, 'or', w3, 'and not',"
                " '(', '(', w2, 'or', w4, ')', 'or', w1, ')'",
            ],
            "|",
        ),
        "query_tokens_text": r"""WITH tokens AS (
  SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|[()]') AS l FROM documents)),
paired AS (
  SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM tokens)
SELECT d.doc_id, coalesce(
  string_agg(CASE token WHEN 'not' THEN 'and not' ELSE token END, '|' ORDER BY i), '') AS tokens
FROM documents d LEFT JOIN paired p
  ON p.doc_id = d.doc_id AND NOT (token = 'and' AND coalesce(following, '') = 'not')
GROUP BY d.doc_id""",
        "search_words": _sql_shapes(
            "words",
            ["w1, w2, w3, w4", "w1, w2, w3, w4", "w1, w2, w3, w4, w1", "w1, w2, w3, w2, w4, w1"],
            " ",
        ),
        "positive_words": _sql_shapes(
            "words", ["w1, w2, w3", "w1, w4", "w1, w2", "w1, w2, w3"], " "
        ),
        "result_line": f"{flagship}\nSELECT 'docID:' || doc_id || ',URL:' || url || ',Title:'"
        " || title || ',Content:' || snippet AS value FROM results",
        "bool_and": _sql_boolean("from and than"),
        "bool_or": _sql_boolean("from or nicht"),
        "bool_and_not": _sql_boolean(AND_NOT_QUERY),
        "boolean_search": _sql_boolean(GROUPED_QUERY),
        "boolean_search_and": _sql_boolean("from and than"),
        "boolean_search_or": _sql_boolean("from or nicht"),
        "boolean_search_and_not": _sql_boolean(AND_NOT_QUERY),
        "boolean_search_left_to_right": _sql_boolean("from or than and nicht"),
        "boolean_search_long": _sql_boolean("from or than and erin or nicht"),
        "boolean_search_unknown": _sql_boolean("zzzz or from"),
        "boolean_search_none": _sql_boolean("from and zzzz"),
        "boolean_search_pages": _sql_boolean(GROUPED_QUERY, "pages"),
        "boolean_search_blocks": _sql_boolean(GROUPED_QUERY),
        "boolean_search_blocks_rare": _sql_boolean("erin and from"),
        "boolean_search_batch": f"""{_with()},
{_sql_query_words("benchmark", "item_id")},
seen AS (
  SELECT s.query_id, s.shape, p.doc_id, bool_or(p.term = w1) AS m1, bool_or(p.term = w2) AS m2,
         bool_or(p.term = w3) AS m3, bool_or(p.term = w4) AS m4
  FROM (SELECT *, unnest(list_distinct([w1, w2, w3, w4])) AS term FROM shaped) s
  JOIN postings p USING (term) GROUP BY ALL)
SELECT query_id, doc_id FROM seen WHERE CASE shape
  WHEN 0 THEN m1 AND (m2 OR m3) AND NOT m4
  WHEN 1 THEN (m1 AND NOT (m2 OR m3)) AND m4
  WHEN 2 THEN (m1 OR m2) AND NOT (m3 AND (m4 OR m1))
  ELSE ((m1 AND m2) OR m3) AND NOT (m2 OR m4 OR m1) END""",
        "doc_file_ranges": f"{grouped}\nSELECT doc_id, file FROM hits JOIN file_of USING (doc_id)",
        "fetch_articles": f"{_sql_hits(GROUPED_QUERY)}\nSELECT a.* FROM documents_articles a"
        " JOIN hits USING (doc_id)",
        "word_count": f"SELECT word, count(*) AS n FROM ({_LINE_WORDS}) GROUP BY word",
        "terms_by_prefix": f"""WITH {_sql_query_words("documents", "doc_id")}
SELECT query_id, substring(term, 1, 2) AS prefix, string_agg(term, ' ' ORDER BY term) AS terms
FROM (SELECT query_id, unnest(list_distinct([w1, w2, w3, w4])) AS term FROM shaped)
GROUP BY ALL""",
        "term_chunks": f"{_with()}\nSELECT DISTINCT prefix, term FROM postings",
        "matched_terms": f"{_with()}\nSELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms"
        f" FROM postings WHERE term IN ({_list(WORDS)}) GROUP BY doc_id",
        "matched_files": f"{grouped}\nSELECT DISTINCT file FROM hits JOIN file_of USING (doc_id)",
        "no_match": f"{_sql_hits('from and zzzz')}\nSELECT count(*) = 0 AS no_match FROM hits",
        "sort_doc_ids": _sql_boolean(GROUPED_QUERY) + " ORDER BY doc_id",
        "best_fragment": f"{all_best}\nSELECT doc_id, score, piece AS fragment FROM best",
        "snippet": f"{all_best}\nSELECT doc_id, CASE WHEN score > 0"
        f" THEN {_sql_marked('piece', SNIPPET_WORDS)} ELSE '' END AS snippet"
        " FROM documents_articles LEFT JOIN best USING (doc_id)",
        "highlight": f"SELECT doc_id, {_sql_marked('text', SNIPPET_WORDS)} AS text FROM documents",
        "title_or_plain": f"{title_best}\nSELECT doc_id, CASE WHEN score > 0"
        f" THEN {_sql_marked('piece', SNIPPET_WORDS)} ELSE title END AS title"
        " FROM documents_articles LEFT JOIN best USING (doc_id)",
        "drop_stop_words": f"""{_with()}
SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY term), '') AS words
FROM documents d LEFT JOIN postings p
  ON p.doc_id = d.doc_id AND term NOT IN ({_list(STOP_WORDS)})
GROUP BY d.doc_id""",
        "search": f"{flagship}\nSELECT * FROM results",
        "search_grouped": _sql_search(GROUPED_QUERY, ["from", "than", "tion"])
        + "\nSELECT * FROM results",
        "search_stop_word": f"{_sql_hits('that')}\nSELECT doc_id, url, title, '' AS snippet"
        " FROM documents_articles JOIN hits USING (doc_id)",
        "search_ranges": f"{flagship}\nSELECT * FROM results WHERE doc_id % {IDS_PER_FILE} >= 10",
        "fetch_articles_ranges": f"{_sql_hits(GROUPED_QUERY)}\nSELECT a.*,"
        f" 'part_' || (doc_id // {IDS_PER_FILE}) AS file FROM documents_articles a"
        f" JOIN hits USING (doc_id) WHERE doc_id % {IDS_PER_FILE} >= 10",
        "search_files": _sql_snippets(
            f"{_sql_hits(AND_NOT_QUERY)},\n{_ARTICLE_LINES},\nfields AS ({_ARTICLE_FIELDS}),\n"
            "found AS (SELECT f.* FROM fields f JOIN hits USING (doc_id))",
            "found",
            ["from"],
        )
        + "\nSELECT * FROM results",
        "search_pages": _sql_search(AND_NOT_QUERY, ["from"], "pages") + "\nSELECT * FROM results",
        "word_count_job": f"SELECT word, count(*) AS n FROM ({_LINE_WORDS}) GROUP BY word",
    }
