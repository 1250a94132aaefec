"""The operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.cluster import scratch_dir
from termsift.llm import collocations, fixity, licenses, sql
from termsift.llm.common import crc_split, read
from termsift.llm.decontamination import find_spans
from termsift.llm.embedding_dedup import near_duplicates
from termsift.llm.language import fit_languages, with_language
from termsift.llm.multi_index import nearest_neighbours
from termsift.llm.ngram_join import near_duplicates as near_duplicate_texts
from termsift.llm.packing import pack_documents
from termsift.llm.quality import fit_quality, with_quality
from termsift.llm.token_files import read_token_files, write_token_files
from termsift.llm.toxicity import fit_toxicity, with_toxicity
from termsift.llm.whitening import whitened_components


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(spark, read(spark, sf_dir, "documents"), path)


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token_files")
    write_token_files(
        read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")
    )
    return read_token_files(spark, folder)


def _verdicts(scored: DataFrame, parts: int, held_out: int) -> DataFrame:
    return scored.select(
        "doc_id",
        crc_split(F.col("doc_id"), parts, held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fit_toxicity(documents, read(spark, sf_dir, "labels"))
    return _verdicts(with_toxicity(documents.select("doc_id", "text"), model, "score"), 5, 0)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fit_quality(documents, read(spark, sf_dir, "labels"))
    return _verdicts(with_quality(documents.select("doc_id", "text"), model, "score"), 3, 1)


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read(spark, sf_dir, "documents")).drop("places")


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = with_language(documents.select("doc_id", "text"), fit_languages(documents))
    held_out = crc_split(F.col("doc_id"), 3, 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def _embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


def _ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_texts(read(spark, sf_dir, "documents"))


def _fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(read(spark, sf_dir, "pages"))


def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(read(spark, sf_dir, "embeddings"))


def _multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": _embedding_dedup,
        "op2_warc_fixity": _fixity,
        "op3_best_fit_packing": _packing,
        "op4_ngram_join": _ngram_join,
        "op5_benchmark_decontamination": _decontamination,
        "op6_token_files": _token_files,
        "op7_toxicity": _toxicity,
        "op8_quality": _quality,
        "op9_license_scan": _licenses,
        "op10_language": _language,
        "op11_collocations": _collocations,
        "op12_whitening": _whitening,
        "op13_multi_index": _multi_index,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": sql.EMBEDDING_DEDUP,
        "op2_warc_fixity": fixity.ORACLE,
        "op4_ngram_join": sql.NGRAM_JOIN,
        "op5_benchmark_decontamination": sql.DECONTAMINATION,
        "op9_license_scan": licenses.oracle(),
        "op11_collocations": collocations.ORACLE,
    }
