"""Quality by regularised quadratic discriminant analysis of document statistics.

A text becomes a dozen smoothed, transformed statistics. Each class of the labelled documents is a
normal distribution whose covariance is shrunk towards the pooled one and towards its diagonal.
Count, sum and products of the statistics are summed over all labelled training documents, in the
tasks that made them and then by Spark; the driver sees one matrix per class. The score is the posterior
probability from the difference of the Mahalanobis log densities, by Cholesky factors that are
computed once and sent along.

Nulls, ties, repeats: null and empty texts have the statistics of no words and get a score; null
labels and null ids are no examples, a document with several labels counts by its lowest; rows
with the same doc_id are scored each for itself; extra columns pass through; an empty table gives
an empty table. A very long text is read whole, by itself. Without examples of both labels, as with
an empty table of labels, the score is a constant; texts with equal statistics have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsift.cluster import may_broadcast
from termsift.llm.common import crc_split, tidy

#: Words of ordinary text that every document is mixed with, so that short ones stay near it.
SMOOTHING = 20

#: Shares of the pooled covariance, and of the diagonal, in the covariance of a class.
POOLED, DIAGONAL = 0.05, 0.05

_STATISTICS = 11


def _bytes(of: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of.encode())] = True
    return table


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _bytes("0123456789")
_STOP = _bytes(".,;:'\"-()")
_SHOUT = _bytes("!?")
_SYMBOL = _bytes("#$%&*+/<=>@[\\]^_`{|}~")
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _STOP, _SHOUT, _SYMBOL]).astype(float)


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; finite for every text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    upper, lower, digit, stop, shout, symbol = _CLASSES @ np.bincount(
        np.frombuffer(raw, np.uint8), minlength=256
    )
    distinct = len(set(words))
    repeated = sum(map(eq, words[1:], words))
    lines = raw.count(b"\n")
    bare = sum(not w.isalnum() and w.isascii() and not w.strip(b"|#$%&*+-=~<>") for w in set(words))
    m = n + SMOOTHING
    size = len(raw) + 6 * SMOOTHING
    share = lambda count, usual, of: np.log((count + usual * SMOOTHING + 0.1) / of)
    return np.array([
        share(upper, 0.15, upper + lower + SMOOTHING * 5),
        share(digit, 0.02, size),
        share(stop, 0.15, size),
        share(shout, 0.02, size),
        share(symbol, 0.02, size),
        share(repeated, 0.02, m),
        share(n - distinct, 0.1, m),
        np.log(distinct + SMOOTHING) / np.log(m + 1),
        share(lines, 0.1, m),
        share(bare, 0.02, distinct + SMOOTHING),
        np.log(size / m),
    ])


class Discriminant(NamedTuple):
    """Per class: prior log probability, mean, and Cholesky factor of the covariance."""

    log_prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        log_density = []
        for k in (0, 1):
            scaled = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            spread = np.log(np.diag(self.factor[k])).sum()
            log_density.append(self.log_prior[k] - spread - 0.5 * (scaled**2).sum(axis=0))
        return 0.5 * (1 + np.tanh(0.5 * (log_density[1] - log_density[0])))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant | float:
    """From count, sum and sum of products of each class; a constant where a class is missing."""
    counts = np.array([moments[k][0] if k in moments else 0 for k in (0, 1)])
    if not counts.all():
        return float((counts[1] + 1) / (counts.sum() + 2))
    mean = np.array([moments[k][1] / moments[k][0] for k in (0, 1)])
    scatter = [moments[k][2] - moments[k][0] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / counts.sum()
    factor = []
    for k in (0, 1):
        # a class of few documents leans on the pooled covariance
        lean = POOLED + (1 - POOLED) * _STATISTICS / (_STATISTICS + counts[k])
        own = (1 - lean) * scatter[k] / counts[k] + lean * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own))
        factor.append(np.linalg.cholesky(own + 1e-6 * np.eye(len(own))))
    return Discriminant(np.log(counts / counts.sum()), mean, np.array(factor))


def fit_quality(documents: DataFrame, labels: DataFrame) -> Discriminant | float:
    """Fit to all labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))

    few = may_broadcast(known.count())
    train = documents.select("doc_id", "text").where(~crc_split(F.col("doc_id"), 3, 1))
    train = train.join(F.broadcast(known) if few else known, "doc_id").select("text", "_label")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + _STATISTICS + _STATISTICS**2))
        for batch in batches:
            labels = batch.column("_label").to_pylist()
            for text, label in zip(batch.column("text").to_pylist(), labels, strict=True):
                x = statistics(text)
                total[label] += np.concatenate(([1.0], x, np.outer(x, x).ravel()))
        label, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(place), pa.array(total[label, place])],
            names=["label", "place", "value"],
        )

    parts = train.mapInArrow(tidy(sums), "label bigint, place bigint, value double")
    table = np.zeros((2, 1 + _STATISTICS + _STATISTICS**2))
    for row in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        table[row.label, row.place] = row.value
    moments = {
        k: (own[0], own[1 : 1 + _STATISTICS], own[1 + _STATISTICS :].reshape(_STATISTICS, -1))
        for k, own in enumerate(table)
        if own[0]
    }
    return discriminant(moments)


def with_quality(
    documents: DataFrame, model: Discriminant | float, column: str = "quality_score"
) -> DataFrame:
    """Documents with the score of each whole text, from 0 to 1."""
    where = documents.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                texts = rows.column(where).to_pylist()
                if isinstance(model, Discriminant):
                    found = model.score(np.array([statistics(text) for text in texts]))
                else:
                    found = np.full(len(texts), model)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(found)], names=[*rows.schema.names, column]
                )

    schema = documents.select("*", F.lit(0.0).alias(column)).schema
    return documents.mapInArrow(tidy(score), schema)
