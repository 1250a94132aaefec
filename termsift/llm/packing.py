"""Best-fit packing by patterns of document lengths.

Texts become token ids, documents longer than a sequence are cut, and the pieces are packed. Only
the histogram of lengths decides how: patterns of a few lengths that fill a sequence exactly are
fitted to the histogram by non-negative least squares, rounded, and what they leave is packed by
best fit, all of it on counts by length. The histogram has one bin per possible length, so this
costs the same for any number of documents. Every piece is then dealt to its place: pieces of one
length are numbered, and the plan says which numbers go to which pattern. The task that cuts a piece
numbers it among its own of that length; the numbers of the tasks follow each other by the counts of
(task, length), so that no piece moves, however common its length.

Nulls, ties, repeats: a null text is empty and holds the end id only; rows with the same doc_id
are packed each for itself; extra columns are ignored; an empty table gives an empty table. A very
long text becomes many whole pieces, made in one task; pieces of equal length are placed in the
order in which they were read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termsift.cluster import join_lookup, may_broadcast
from termsift.llm.common import stored
from termsift.llm.tokens import encoder

SEQUENCE = 4096
END_ID = 1

_PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary,"
    " task int, number bigint"
)


def token_pieces(
    documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece of at most ``sequence`` ids: its place in the document, crc32 and ids.

    ``ids`` holds little-endian unsigned 16-bit ids, or null with ``keep_ids=False``; the crc32 is
    that of the ids as little-endian unsigned 32-bit integers. ``number`` counts the pieces of a
    length within a ``task``.
    """
    end = np.array([end_id], "<u2").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer, "bare")
        task, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                texts = part.column("text").to_pylist()
                for doc, ids in zip(part.column("doc_id").to_pylist(), work.encode(texts), strict=True):
                    ids += end
                    for number, start in enumerate(range(0, len(ids) // 2, sequence)):
                        own = ids[2 * start : 2 * (start + sequence)]
                        crc = zlib.crc32(np.frombuffer(own, "<u2").astype("<u4"))
                        n = len(own) // 2
                        kept = own if keep_ids else None
                        rows.append((doc, number, start, n, crc, kept, task, int(seen[n])))
                        seen[n] += 1
                kinds = (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(),
                    pa.int32(), pa.int64(),
                )
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "number")
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                )

    return documents.select("doc_id", "text").mapInArrow(cut, _PIECES)


# -- the plan: on counts by length --------------------------------------------------------------


class Plan(NamedTuple):
    """Intervals of pieces, sorted by ``key``: length and first number of the pieces.

    The pieces of an interval go to sequences counted up from ``sequence``, each at ``offset``.
    """

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


_KEY_BITS = 44  # of the numbers within a length


def _quantiles(hist: np.ndarray, n: int) -> np.ndarray:
    """Lengths that cut the pieces into equal parts."""
    total = np.cumsum(hist)
    return np.unique(np.searchsorted(total, (np.arange(n) + 0.5) / n * total[-1], side="right"))


def patterns(hist: np.ndarray, thirds: int = 24, quarters: int = 8) -> np.ndarray:
    """Rows of two to four lengths that fill a sequence exactly, zero-padded and sorted.

    ``hist[n]`` is the number of pieces of length n. All pairs; triples and quadruples in which
    all but two lengths are quantiles of the pieces.
    """
    size = len(hist) - 1
    there = np.flatnonzero(hist[:size])
    if not len(there):
        return np.zeros((0, 4), np.int64)
    inner = [()]
    inner += [(b,) for b in _quantiles(hist[:size], thirds)]
    inner += list(combinations_with_replacement(_quantiles(hist[:size], quarters), 2))
    rows = []
    for fixed in inner:
        last = size - sum(fixed) - there
        fits = (last >= there) & (last < size)
        fits[fits] = hist[last[fits]] > 0
        row = np.zeros((fits.sum(), 4), np.int64)
        row[:, 0], row[:, 1] = there[fits], last[fits]
        for k, b in enumerate(fixed):
            row[:, 2 + k] = b
        rows.append(row)
    return np.unique(np.sort(np.concatenate(rows), axis=1), axis=0)


def repeat_counts(rows: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often to use each pattern: non-negative least squares by accelerated projected gradient."""
    target = hist.astype(float).copy()
    target[0] = 0
    width = len(target)
    used = rows > 0

    def lengths(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(x, 4) * used.ravel(), width)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return (r[rows] * used).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(lengths(v))
        steepest = np.linalg.norm(v)
        v /= steepest
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        following = np.maximum(0, y - back(lengths(y) - target) / (1.05 * steepest))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = following + (t - 1) / t_next * (following - x)
        x, t = following, t_next
    return x


def plan_sequences(hist: np.ndarray) -> Plan:
    """Where the pieces of each length go; ``hist[n]`` is their number, ``len(hist) - 1`` the size."""
    hist = np.asarray(hist, np.int64)
    size = len(hist) - 1
    left = hist.copy()
    left[0] = 0
    chosen: list[tuple[list[int], int]] = []
    if left[size]:
        chosen.append(([size], int(left[size])))
        left[size] = 0
    rows = patterns(hist)
    if len(rows):
        x = repeat_counts(rows, hist)
        order = np.argsort(-x, kind="stable")
        # cumulative rounding keeps the number of sequences that many small counts add up to
        whole = np.diff(np.floor(np.cumsum(x[order]) + 1e-9), prepend=0).astype(np.int64)
        for k in np.flatnonzero(whole):
            row = [int(n) for n in rows[order[k]] if n]
            need = {n: row.count(n) for n in row}
            count = min(int(whole[k]), *(int(left[n]) // c for n, c in need.items()))
            if count:
                chosen.append((row, count))
                for n, c in need.items():
                    left[n] -= count * c
    chosen += _best_fit(left)
    # intervals
    next_number = np.zeros(size + 1, np.int64)
    keys, sequences, offsets = [], [], []
    first = 0
    for row, count in chosen:
        offset = 0
        for n in row:
            keys.append((n << _KEY_BITS) + int(next_number[n]))
            sequences.append(first)
            offsets.append(offset)
            next_number[n] += count
            offset += n
        first += count
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    take = lambda values: np.array(values, np.int64)[order]
    return Plan(take(keys), take(sequences), take(offsets), first)


def _best_fit(left: np.ndarray) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: the longest first, each into the fullest place it fits."""
    size = len(left) - 1
    closed: list[tuple[list[int], int]] = []
    open_by_room: dict[int, list[tuple[list[int], int]]] = {}
    rooms = np.zeros(size + 1, bool)
    for n in np.flatnonzero(left)[::-1].tolist():
        count = int(left[n])
        while count:
            fits = np.flatnonzero(rooms[n:])
            if not len(fits):
                fresh = size // n
                if count >= fresh:
                    made = ([n] * fresh, count // fresh)
                    count -= fresh * made[1]
                else:
                    made, count = ([n] * count, 1), 0
                room = size - n * len(made[0])
            else:
                at = n + int(fits[0])
                row, there = open_by_room[at].pop()
                if not open_by_room[at]:
                    rooms[at] = False
                each = min(at // n, count)
                repeat = min(there, count // each)
                if there > repeat:
                    open_by_room[at].append((row, there - repeat))
                    rooms[at] = True
                made = (row + [n] * each, repeat)
                count -= each * repeat
                room = at - n * each
            if room:
                open_by_room.setdefault(room, []).append(made)
                rooms[room] = True
            else:
                closed.append(made)
    return closed + [made for rows in open_by_room.values() for made in rows]


# -- dealing the pieces -------------------------------------------------------------------------


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` added. ``pieces`` must be a written table.

    The driver sees the counts of lengths only: at most ``sequence`` numbers. Those of (task, length)
    stay in Spark and go to the pieces by broadcast, where their counted rows allow it.
    """
    counts = stored(pieces.groupBy("task", "length").count(), "lengths")
    by_length = counts.groupBy("length").agg(F.sum("count").alias("n")).toPandas()
    histogram = np.zeros(sequence + 1, np.int64)
    histogram[by_length["length"]] = by_length["n"]
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(plan_sequences(histogram))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    before = counts.select("task", "length", before)
    numbered = join_lookup(
        pieces, before, ["task", "length"], may_broadcast(counts.count()), salt_by="number"
    )
    names = [name for name in pieces.columns if name not in ("task", "number")]
    numbered = numbered.select(*names, (F.col("number") + F.col("_before")).alias("_number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << _KEY_BITS) + batch.column("_number").to_numpy()
            at = np.searchsorted(plan.key, key, side="right") - 1
            sequence_id = plan.sequence[at] + key - plan.key[at]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence_id), pa.array(plan.offset[at])],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{name} {pieces.schema[name].dataType.simpleString()}" for name in names)
    return numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, doc_ids, ids`` (16-bit), from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
    )


def pack_documents(
    spark: SparkSession, documents: DataFrame, tokenizer: str, keep_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack: the written pieces with their places."""
    pieces = token_pieces(documents, tokenizer, keep_ids=keep_ids)
    if not keep_ids:
        pieces = pieces.drop("ids")
    return pack(stored(pieces, "pieces"))
