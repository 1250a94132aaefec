"""A cleaning and packing pipeline over ``documents``.

STAGES are (name, function) pairs; a function takes ``(spark, docs, sf_dir)``, and its result is
written as Parquet and read again as the next one's ``docs``. All stages but the last return the
columns of ``docs``.

Nulls, ties, repeats: rows without text or id pass the filters as their scores say and are no
duplicates of anything; of equal texts the smallest id stays; very long texts go through all stages
whole and are cut only when they are packed; an empty table gives an empty result. The operators in
``termsift.llm`` tell the rest. Extra columns pass through, also under the names of scores.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.llm.common import free_name, read, small_batches, stored
from termsift.llm.decontamination import remove_spans
from termsift.llm.ngram_join import keep_one
from termsift.llm.packing import pack_documents
from termsift.llm.quality import fit_quality, with_quality
from termsift.llm.toxicity import Network, fit_toxicity, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; all of them where nothing was learned.

    Without examples of both labels there is no network but a constant, which tells no document
    from another: it rejects none.
    """
    small_batches(spark)  # whole rows pass through the tasks, their texts included
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    if not isinstance(model, Network):
        return docs
    name = free_name(docs, "toxicity")
    scored = with_toxicity(docs, model, name)
    return scored.where(F.col(name) < 0.5).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    name = free_name(docs, "quality")
    scored = with_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by word 5-grams, at a Jaccard similarity of 0.8."""
    small_batches(spark)
    return keep_one(docs, ngram=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of benchmark items."""
    small_batches(spark)
    return remove_spans(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts packed into sequences; one row per piece, with its ids."""
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(spark, docs, path, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("deduplication", deduplication),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Token ids, learned scores and near-duplicates are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
