"""Boolean keyword search over document collections, and word count, on Spark."""

from termsift.functions.queries import compile_queries, compile_query
from termsift.operators.boolean import (
    boolean_search,
    boolean_search_batch,
    boolean_search_blocks,
    matched_terms,
)
from termsift.operators.counts import split_words, term_chunks, terms_by_prefix, word_count
from termsift.operators.fetch import doc_file_ranges, fetch_articles, matched_files
from termsift.operators.sets import bool_and, bool_and_not, bool_or, no_match, sort_doc_ids
from termsift.plans.search import search, search_files
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
from termsift.sources.lines import read_index_shards, write_index_shards

__all__ = [
    "block_postings",
    "bool_and",
    "bool_and_not",
    "bool_or",
    "boolean_search",
    "boolean_search_batch",
    "boolean_search_blocks",
    "build_blocks",
    "build_file_ranges",
    "build_postings",
    "compile_queries",
    "compile_query",
    "doc_file_ranges",
    "fetch_articles",
    "filter_terms",
    "matched_files",
    "matched_terms",
    "no_match",
    "read_article_files",
    "read_blocks",
    "read_index_shards",
    "read_postings",
    "search",
    "search_files",
    "sort_doc_ids",
    "split_words",
    "term_chunks",
    "terms_by_prefix",
    "word_count",
    "word_count_job",
    "write_articles",
    "write_blocks",
    "write_index_shards",
    "write_postings",
]
