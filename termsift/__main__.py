"""Command line, for ``spark-submit`` or ``python -m termsift``.

    index         article lines -> postings, article files, range file, bad lines
    search        search written postings and article files
    search-files  search text files: index shards, range file, article files
    word-count    count the words of text files
"""

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from termsift.functions.queries import compile_query
from termsift.plans.search import search, search_files
from termsift.plans.word_count import word_count_job
from termsift.sources.index import (
    build_file_ranges,
    build_postings,
    read_article_files,
    read_postings,
    write_articles,
    write_postings,
)
from termsift.sources.lines import bad_article_lines, parse_articles, read_file_ranges, read_lines
from termsift.sources.sinks import result_line, write_results

NOTHING_FOUND = "nothing is found"


def index(spark: SparkSession, lines_path: str, output: str) -> None:
    """Build all a search needs below one folder."""
    lines = read_lines(spark, lines_path)
    write_articles(parse_articles(lines), f"{output}/articles")
    bad_article_lines(lines).write.text(f"{output}/bad_lines")
    articles = read_article_files(spark, f"{output}/articles")
    build_file_ranges(articles).write.csv(f"{output}/ranges")
    write_postings(build_postings(articles), f"{output}/postings")


def search_index(spark: SparkSession, output: str, query: str, **options) -> DataFrame:
    """Search what ``index`` built."""
    words = sorted(set(compile_query(query).words))
    return search(
        read_article_files(spark, f"{output}/articles"),
        read_postings(spark, f"{output}/postings", words),
        query,
        ranges=read_file_ranges(spark, f"{output}/ranges"),
        **options,
    )


def _emit(results: DataFrame, output: str | None) -> None:
    if output:
        write_results(results, output)
        return
    found = False
    for row in result_line(results).toLocalIterator():
        print(row["value"])
        found = True
    if not found:
        print(NOTHING_FOUND)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="termsift")
    commands = parser.add_subparsers(dest="command", required=True)

    command = commands.add_parser("index")
    command.add_argument("lines", help="text files of docID,URL,title,content")
    command.add_argument("folder", help="new folder for the index")

    command = commands.add_parser("search")
    command.add_argument("query")
    command.add_argument("folder", help="folder made by index")

    files = commands.add_parser("search-files")
    files.add_argument("query")
    files.add_argument("index", help="folder of index shards")
    files.add_argument("ranges", help="file of fileName,begin,end")
    files.add_argument("articles", help="folder of article files")
    for one in (command, files):
        one.add_argument("--output", help="write Parquet here instead of printing")
        one.add_argument("--keep-empty-snippet", action="store_true")

    command = commands.add_parser("word-count")
    command.add_argument("input")
    command.add_argument("output", help="new folder")
    return parser


def main(argv: list[str]) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("termsift").getOrCreate()
    if args.command == "index":
        index(spark, args.lines, args.folder)
    elif args.command == "word-count":
        word_count_job(spark, args.input, args.output)
    else:
        options = {
            "drop_empty_snippet": not args.keep_empty_snippet,
            "ordered": args.output is None,
        }
        if args.command == "search":
            results = search_index(spark, args.folder, args.query, **options)
        else:
            results = search_files(
                spark, args.index, args.ranges, args.articles, args.query, **options
            )
        _emit(results, args.output)


if __name__ == "__main__":
    main(sys.argv[1:])
