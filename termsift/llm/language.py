"""Language identification by rank-order profiles of n-grams.

A profile ranks the most frequent n-grams of one to three letters, with blanks at the ends of
words. A document's profile is compared with each language's by the out-of-place distance: how far
each of its n-grams is from its rank in the language, or a full profile length where the language
does not have it. The nearest language wins, on a tie the first in the alphabet.

Letters are bytes of UTF-8 with ASCII in lower case; everything else in ASCII is a blank. N-grams
are counted in fixed tables (three letters by a hash), so a text of any length takes the same
memory. Profiles are learned from a bounded sample of labelled documents, the same number for each
language, which are counted on Spark; the driver sees one table of counts per language.

Nulls, ties, repeats: a null text, or one without a letter, is ``und`` with score 0; documents
without a language or id teach nothing; rows with the same doc_id are judged each for itself;
extra columns pass through; without any profile everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termsift.llm.common import crc_split

PROFILE = 400

#: Bound of the sample: documents per language.
SAMPLE_PER_LANGUAGE = 1500

UNKNOWN = "und"

#: Tables of one, two and three letters in one row of counts.
_ONE, _TWO, _THREE = 1 << 8, 1 << 16, 1 << 15
SIZE = _ONE + _TWO + _THREE

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_LETTER = regex.compile(r"\p{L}")

#: Bytes of text that are counted at once.
_STEP = 1 << 20


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of all n-grams of a whole text."""
    raw = b" " + b" ".join((text or "").encode().translate(_FOLD).split()) + b" "
    counts = np.zeros(SIZE, np.int64)
    letters = np.frombuffer(raw, np.uint8).astype(np.int32)
    for at in range(0, max(1, len(letters) - 2), _STEP):
        a = letters[at : at + _STEP + 2]
        own = a[: _STEP if at + _STEP + 2 < len(letters) else len(a)]
        two = (a[:-1] << 8) + a[1:]
        own_two = two[: len(own)]
        three = ((two[:-1] * 31 + a[2:]) * 0x9E3B1 >> 7) & (_THREE - 1)
        counts += np.bincount(
            np.concatenate([own, own_two + _ONE, three + (_ONE + _TWO)]), minlength=SIZE
        )
    counts[32] = 0
    counts[_ONE + (32 << 8) + 32] = 0
    return counts


def ranked(counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; equally frequent ones by number."""
    there = np.flatnonzero(counts != 0)
    own = counts[there]
    if len(there) > size:
        least = np.partition(own, len(own) - size)[len(own) - size]
        there, own = there[own >= least], own[own >= least]
    return there[np.argsort(-own, kind="stable")][:size]


class Profiles(NamedTuple):
    """Languages in order, and the rank of every n-gram in each (``PROFILE`` where it has none)."""

    languages: list[str]
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and by how much it is nearer than the next, from 0 to 1."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        own = ranked(gram_counts(text))
        distance = np.abs(self.ranks[:, own] - np.arange(len(own))).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0
        nearest, following = distance[order[:2]]
        return self.languages[order[0]], float(1 - nearest / following) if following else 0.0


def profiles(counts: dict[str, np.ndarray]) -> Profiles:
    languages = sorted(counts)
    ranks = np.full((len(languages), SIZE), PROFILE, np.int32)
    for k, language in enumerate(languages):
        top = ranked(counts[language])
        ranks[k, top] = np.arange(len(top))
    return Profiles(languages, ranks)


def fit_languages(documents: DataFrame) -> Profiles:
    """Profiles of the languages of documents that are not held out."""
    train = documents.select("doc_id", "lang", "text").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
        & ~crc_split(F.col("doc_id"), 3, 1)
    )
    # the sample: a share of each language by hash, so that no language is sorted in one task
    sizes = train.groupBy("lang").count()
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.lit(float(SAMPLE_PER_LANGUAGE << 30))
    sampled = train.join(F.broadcast(sizes), "lang").where(mark * F.col("count") < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for language, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                total[language] = total.get(language, 0) + gram_counts(text)
        for language, counts in total.items():
            gram = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(gram)), pa.array(gram), pa.array(counts[gram])],
                names=["lang", "gram", "n"],
            )

    counted = sampled.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most a profile per language leaves the cluster, with the same order on ties
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    found: dict[str, np.ndarray] = {}
    for row in top.collect():
        found.setdefault(row["lang"], np.zeros(SIZE, np.int64))[row["gram"]] = row["n"]
    return profiles(found)


def with_language(
    documents: DataFrame, known: Profiles, column: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Documents with the predicted language of each whole text and the score of it."""
    shared = documents.sparkSession.sparkContext.broadcast(known)
    where = documents.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                found = [shared.value.predict(text) for text in rows.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                    ],
                    names=[*rows.schema.names, column, score],
                )

    schema = documents.select("*", F.lit("").alias(column), F.lit(0.0).alias(score)).schema
    return documents.mapInArrow(predict, schema)
