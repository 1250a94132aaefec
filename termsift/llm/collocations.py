"""Collocations: frequent phrases whose parts stand together more often than by chance.

Counts of n-grams are weighted acyclic automata (``transducers``). Each task builds its own from its
sorted n-grams, cut into ranges of prefixes; the automata of a range are united and their weights
summed; and the counts of the parts of every candidate are looked up by composing an automaton of the
wanted parts with the one of their range.

Most n-grams of a corpus are rare and no candidates, nor parts of one. They are sieved out first: their
64-bit hashes are counted exactly, length by length, and a bitmap of those that are frequent enough
goes to the next pass. A bitmap only lets through too much, never too little: whatever it lets
through is counted again, as words. It is at most 32 MB for any corpus; beyond some ten million
frequent n-grams it lets more through.

Ranges come from a bounded sample of documents, so that a common word or a common language is spread
over as many ranges as it has n-grams; the sample decides nothing but the cuts. A task sends one
count for an n-gram, however frequent it is.

Nulls, ties, repeats: a null text has no words, a null language is ``und``; an empty piece or text
adds nothing; rows with the same doc_id, or with none, count each for itself; phrases of equal score
are ordered by count, then by their bytes; extra columns are ignored; an empty table gives an empty
table. Texts are read in runs of about a megabyte; a longer one is a run of its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termsift.cluster import join_lookup, may_broadcast
from termsift.llm.common import slices, stored
from termsift.llm.transducers import Transducer, union

#: Words of a phrase at most, and how often a candidate occurs at least.
LONGEST, LEAST = 5, 100

#: Percent of a phrase's count that a longer one around it must have to stand for it.
COVERED = 100

#: Phrases of a language that are returned.
TOP = 2000

#: Distinct n-grams or hashes that a task holds before it writes them out.
HELD_PHRASES, HELD_HASHES = 300_000, 2_000_000

#: Entries of a range, about, and ranges at most.
RANGE_ENTRIES, MOST_RANGES = 100_000, 4096

#: The sample that the ranges are cut by: documents, and n-grams of each.
SAMPLE_DOCUMENTS, SAMPLE_PHRASES, BOUNDARY_BYTES = 1000, 200, 64

_U = np.uint64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Run:
    """The words of some texts of one language, and the hashes of their n-grams."""

    def __init__(self, texts: list[bytes], lang: str):
        self.raw = b"\n".join(texts).translate(_LOWER)
        data = np.frombuffer(self.raw, np.uint8)
        kind = _KIND[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], kind > 0, [True]))))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.n = len(self.starts)
        if not self.n:
            return
        sizes = self.ends - self.starts
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        inside = data[kind == 0]
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(inside)) - np.repeat(first, sizes)
        powers = np.full(int(sizes.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        words = np.add.reduceat(_BYTE_VALUES[inside] * powers[place], first)
        words = _mixed(words + sizes.astype(np.uint64) * _BASE)
        seed = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        self.hashes = {1: _mixed(words + _U(seed))}
        for size in range(2, LONGEST + 1):
            shorter = self.hashes[size - 1][: max(self.n - size + 1, 0)]
            self.hashes[size] = _mixed(shorter * _BASE + words[size - 1 :])

    def whole(self, size: int) -> np.ndarray:
        """Where an n-gram of this size lies within one piece."""
        return self.piece[: max(self.n - size + 1, 0)] == self.piece[size - 1 :]

    def words(self, at: int, size: int) -> tuple[bytes, ...]:
        starts, ends = self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist()
        return tuple(self.raw[a:b] for a, b in zip(starts, ends, strict=True))


class Sieve(NamedTuple):
    """A bitmap over the highest bits of hashes."""

    bits: int
    map: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> _U(64 - self.bits)).astype(np.int64)
        return (self.map[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def _open(run: Run, sieves: dict[int, Sieve]) -> dict[int, np.ndarray]:
    """Where n-grams may be frequent, by size: their parts are, as far as the sieves know."""
    out = {1: sieves[1](run.hashes[1]) if 1 in sieves else np.ones(run.n, bool)}
    for size in range(2, LONGEST + 1):
        shorter = out[size - 1]
        out[size] = shorter[:-1] & shorter[1:] & run.whole(size) if run.n >= size else np.zeros(0, bool)
        if size in sieves:
            out[size] &= sieves[size](run.hashes[size])
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Run]]:
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append((text or "").encode())
        for lang, own in texts.items():
            for part in slices(own):
                yield lang, Run(part, lang)


# -- sieving --------------------------------------------------------------------------------------


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their summed counts."""
    flat, weight = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, weight = flat[order], weight[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else order
    return flat[starts], np.add.reduceat(weight, starts) if len(flat) else weight


class Sizes(NamedTuple):
    """Bits of the sieve, and of the number of a part of the hashes."""

    bits: int
    part_bits: int


def sieve_sizes(text_bytes: int) -> Sizes:
    """Sixteen bits for every n-gram of one length that can be frequent, as far as 32 MB go."""
    part_bits = int(np.clip(np.ceil(np.log2(max(text_bytes, 1) / (4 << 20))), 3, 16))
    bits = int(np.clip(np.ceil(np.log2(max(text_bytes, 1) * 0.03)), part_bits + 3, 28))
    return Sizes(bits, part_bits)


def count_hashes(
    docs: DataFrame, lengths: tuple[int, ...], sieves: dict[int, Sieve], sizes: Sizes
) -> DataFrame:
    """Hash counts of the tasks by part, as packed numbers; and with part -1 the words by language."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)
    shift = _U(64 - sizes.part_bits)

    def flush(hashes: list, counts: list) -> pa.RecordBatch:
        flat, weight = _summed(hashes, counts)
        bounds = np.searchsorted((flat >> shift).astype(np.int64), np.arange((1 << sizes.part_bits) + 1))
        used = np.flatnonzero(np.diff(bounds))
        columns: tuple[list, ...] = ([], [], [])
        for part in used.tolist():
            own, n = flat[bounds[part] : bounds[part + 1]], weight[bounds[part] : bounds[part + 1]]
            columns[0].append(own[n == 1].tobytes())
            columns[1].append(own[n > 1].tobytes())
            columns[2].append(n[n > 1].astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()), pa.nulls(len(used), pa.string()),
                *(pa.array(c, pa.binary()) for c in columns), pa.nulls(len(used), pa.int64()),
            ],
            names=["part", "lang", "once", "more", "counts", "words"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, whole, words = [], [], 0, 0, Counter()
        for lang, run in _runs(batches):
            words[lang] += run.n
            if not run.n:
                continue
            places = _open(run, shared.value)
            found = [run.hashes[size][places[size]] for size in lengths]
            found, n = np.unique(np.concatenate(found), return_counts=True)
            hashes.append(found)
            counts.append(n)
            held += len(found)
            if held > max(HELD_HASHES, 2 * whole):
                flat, weight = _summed(hashes, counts)
                hashes, counts, held = [flat], [weight], len(flat)
                whole = held
                if held > HELD_HASHES:
                    yield flush(hashes, counts)
                    hashes, counts, held, whole = [], [], 0, 0
        if hashes:
            yield flush(hashes, counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1] * len(words), pa.int32()), pa.array(list(words), pa.string()),
                *(pa.nulls(len(words), pa.binary()) for _ in range(3)),
                pa.array(list(words.values()), pa.int64()),
            ],
            names=["part", "lang", "once", "more", "counts", "words"],
        )

    schema = "part int, lang string, once binary, more binary, counts binary, words bigint"
    return docs.mapInArrow(count, schema)


def frequent(counted: DataFrame, sizes: Sizes, least: int) -> tuple[Sieve, int]:
    """The sieve of the hashes that occur ``least`` times or more, and their number."""
    width = sizes.bits - sizes.part_bits

    def keep(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table["once"].to_pylist()), np.uint64)
        more = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<i8")
        flat, weight = _summed([once, more], [np.ones(len(once), np.int64), counts])
        flat = flat[weight >= least]
        marks = np.zeros(1 << width, np.uint8)
        marks[((flat >> _U(64 - sizes.bits)) & _U((1 << width) - 1)).astype(np.int64)] = 1
        return pa.table({
            "part": table["part"][:1], "map": pa.array([np.packbits(marks).tobytes()], pa.binary()),
            "n": pa.array([len(flat)], pa.int64()),
        })

    parts = counted.where("part >= 0").select("part", "once", "more", "counts")
    rows = parts.groupBy("part").applyInArrow(keep, "part int, map binary, n bigint").toArrow()
    out = np.zeros(1 << (sizes.bits - 3), np.uint8)
    each = 1 << (width - 3)
    for part, marks in zip(rows["part"].to_pylist(), rows["map"].to_pylist(), strict=True):
        out[part * each : (part + 1) * each] = np.frombuffer(marks, np.uint8)
    return Sieve(sizes.bits, out), sum(rows["n"].to_pylist())


# -- counting -------------------------------------------------------------------------------------


def _phrases(run: Run, sieves: dict[int, Sieve]) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """The n-grams that the sieves let through, with their counts in the run."""
    for size, open_ in _open(run, sieves).items():
        places = np.flatnonzero(open_)
        _, first, n = np.unique(run.hashes[size][places], return_index=True, return_counts=True)
        for at, count in zip(places[first].tolist(), n.tolist(), strict=True):
            yield run.words(at, size), count


def range_bounds(docs: DataFrame, sieves: dict[int, Sieve], ranges: int, documents: int) -> list[tuple]:
    """(language, words) that cut the n-grams into ranges of about the same size."""
    if ranges < 2:
        return []
    every = max(1, documents // SAMPLE_DOCUMENTS)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).limit(2 * SAMPLE_DOCUMENTS)
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(3)
        for batch in batches:
            for at in range(batch.num_rows):
                for lang, run in _runs([batch.slice(at, 1)]):
                    if not run.n:
                        continue
                    found = sorted({words for words, _ in _phrases(run, shared.value)})
                    chosen = rng.permutation(len(found))[:SAMPLE_PHRASES].tolist()
                    cut = [b" ".join(found[k])[:BOUNDARY_BYTES] for k in chosen]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(cut), pa.string()), pa.array(cut, pa.binary())],
                        names=["lang", "phrase"],
                    )

    rows = sample.mapInArrow(pick, "lang string, phrase binary").toArrow().to_pylist()
    found = sorted({(r["lang"].encode(), tuple(r["phrase"].split(b" "))) for r in rows})
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def range_counts(
    docs: DataFrame, sieves: dict[int, Sieve], bounds: list[tuple], least: int
) -> DataFrame:
    """Transducers of the frequent n-grams of all documents: (range, lang, counts, phrases)."""
    shared = docs.sparkSession.sparkContext.broadcast((sieves, bounds))
    schema = "range int, lang string, counts binary, phrases bigint"

    def shard(held: dict[str, Counter], bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            ordered = sorted(own.items())
            name, start = lang.encode(), 0
            while start < len(ordered):
                number = bisect_right(bounds, (name, ordered[start][0]))
                end = len(ordered)
                if number < len(bounds) and bounds[number][0] == name:
                    end = bisect_right(ordered, bounds[number][1], start, key=lambda p: p[0])
                    # the boundary itself belongs to the next range
                    end -= end > start and ordered[end - 1][0] == bounds[number][1]
                made = Transducer.build(ordered[start:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int32()), pa.array([lang]),
                        pa.array([made.dump()], pa.binary()), pa.array([end - start], pa.int64()),
                    ],
                    names=["range", "lang", "counts", "phrases"],
                )
                start = end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves, bounds = shared.value
        held: dict[str, Counter] = {}
        for lang, run in _runs(batches):
            if not run.n:
                continue
            own = held.setdefault(lang, Counter())
            for words, n in _phrases(run, sieves):
                own[words] += n
            if sum(map(len, held.values())) > HELD_PHRASES:
                yield from shard(held, bounds)
                held = {}
        yield from shard(held, bounds)

    def unite(table: pa.Table) -> pa.Table:
        made = union(map(Transducer.load, table["counts"].to_pylist()), least)
        return pa.table({
            "range": table["range"][:1], "lang": table["lang"][:1],
            "counts": pa.array([made.dump()], pa.binary()),
            "phrases": pa.array([sum(1 for _ in made.paths())], pa.int64()),
        })

    return docs.mapInArrow(count, schema).groupBy("range", "lang").applyInArrow(unite, schema)


def _listed(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more: (lang, phrase, a)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                rows = [(b" ".join(w).decode(), n) for w, n in Transducer.load(raw).paths() if len(w) > 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.int64()),
                    ],
                    names=["lang", "phrase", "a"],
                )

    return counts.select("lang", "counts").mapInArrow(spell, "lang string, phrase string, a bigint")


def part_counts(parts: DataFrame, counts: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Counts of distinct (lang, part), by composing automata of a range's parts and counts."""
    shared = parts.sparkSession.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column("lang").to_pylist(), batch.column("part").to_pylist()
            number = [
                bisect_right(shared.value, (lang.encode(), tuple(part.encode().split(b" "))))
                for lang, part in zip(langs, phrases, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), *batch.columns], names=["range", "lang", "part"]
            )

    def look_up(wanted: pa.Table, counts: pa.Table) -> pa.Table:
        found: list = []
        if wanted.num_rows and counts.num_rows:
            ordered = sorted(tuple(p.encode().split(b" ")) for p in wanted["part"].to_pylist())
            acceptor = Transducer.build((words, 0) for words in ordered)
            found = list(acceptor.compose(Transducer.load(counts["counts"][0].as_py())))
        lang = wanted["lang"][0].as_py() if found else None
        return pa.table({
            "lang": pa.array([lang] * len(found), pa.string()),
            "part": pa.array([b" ".join(words).decode() for words, _ in found], pa.string()),
            "f": pa.array([n for _, n in found], pa.int64()),
        })

    placed = parts.select("lang", "part").mapInArrow(place, "range int, lang string, part string")
    keys = ["range", "lang"]
    pairs = placed.groupBy(*keys).cogroup(counts.select(*keys, "counts").groupBy(*keys))
    return pairs.applyInArrow(look_up, "lang string, part string, f bigint")


# -- scoring --------------------------------------------------------------------------------------


def _join_counts(rows: DataFrame, counts: DataFrame, part: str, name: str, small: bool) -> DataFrame:
    lookup = counts.select("lang", F.col("part").alias(part), F.col("f").alias(name))
    return join_lookup(rows, lookup, ["lang", part], small, salt_by="phrase")


def scored(phrases: DataFrame, totals: DataFrame, counts: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Phrases (lang, phrase, a) with the cut of the lowest score: k, l, r, n, score."""
    words = F.split("phrase", " ")
    cuts = phrases.select("*", words.alias("_words"))
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("_words", F.col("k") + 1, F.size("_words") - F.col("k")), " ").alias("rest"),
    )
    parts = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    known = stored(part_counts(parts, counts, bounds), "part_counts")
    size = known.agg(F.count("*"), F.sum(F.octet_length("part") + F.octet_length("lang"))).first()
    small = may_broadcast(size[0], size[1] or 0)
    cuts = _join_counts(_join_counts(cuts, known, "first", "l", small), known, "rest", "r", small)
    few = may_broadcast(totals.count())
    cuts = join_lookup(cuts, totals, ["lang"], few, salt_by="phrase")
    # numbers of up to 63 bits: their products fit into 38 digits
    wide = {name: f"cast({name} as decimal(19,0))" for name in ("n", "l", "r")}
    score = F.expr(f"(cast(1000 * a as decimal(19,0)) * {wide['n']}) div ({wide['l']} * {wide['r']})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select(
        "lang", "phrase", "a", "n", "best.score", "best.k", "best.l", "best.r"
    )


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases that do not lie inside a longer one that is about as frequent."""
    words = F.split("phrase", " ")
    inner = F.expr(
        """flatten(transform(sequence(2, size(_words) - 1), m ->
            transform(sequence(1, size(_words) - m + 1), i -> array_join(slice(_words, i, m), ' '))))"""
    )
    longer = phrases.select("lang", "a", words.alias("_words")).where(F.size("_words") > 2)
    inside = longer.select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    joined = phrases.join(inside, ["lang", "phrase"], "left")
    stays = F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a"))
    return joined.where(stays).drop("_longer")


def collocations(
    documents: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    lang = F.coalesce(F.col("lang"), F.lit("und")).alias("lang")
    docs = documents.select(lang, "text")
    row = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    sizes = sieve_sizes(row[1] or 0)
    sieves: dict[int, Sieve] = {}
    kept = 0
    totals = None
    for lengths in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        counted = count_hashes(docs, lengths, sieves, sizes)
        if totals is None:
            counted = stored(counted, "words")
            totals = counted.where("part < 0").groupBy("lang").agg(F.sum("words").alias("n"))
        sieve, n = frequent(counted, sizes, least)
        sieves = sieves | dict.fromkeys(lengths, sieve)
        kept += n
    tasks = docs.rdd.getNumPartitions()
    ranges = int(np.clip(-(-kept * tasks // RANGE_ENTRIES), 1, MOST_RANGES))
    bounds = range_bounds(docs, sieves, ranges, row[0])
    counts = stored(range_counts(docs, sieves, bounds, least), "ngrams")
    phrases = stored(_listed(counts), "phrases")
    found = scored(phrases, stored(totals, "totals"), counts, bounds)
    found = uncovered(found, covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by plain counting. DuckDB's ``\\s`` and ``lower`` know more letters, hence the explicit ones.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM lists, (VALUES (1), (2), (3), (4), (5)) AS sizes(m) WHERE len(w) >= m)
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2
), cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), scores AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longest AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i
        FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))
  GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longest o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 100 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked WHERE rank <= 2000
"""
