"""Near-duplicate documents: self-join on the Jaccard similarity of word n-gram sets.

Sets lie in bands by size, so that a set can only link within its band and the next. In a band,
sets are cut into more segments than two linked sets may have elements of difference, by the
hashes of their elements. Two linked sets therefore have a segment in common, with everything in
it, and sets that share a segment are candidates. Passages that thousands of documents share make
no candidates: a segment mixes them with what else the document holds.

Hashed bitmaps bound the overlap of a pair from above, by the bits that one has and the other lacks;
only pairs that pass are intersected as sorted arrays. First every candidate is compared with one
other, which joins nearly all groups. Of what is still apart, sets meet where they share one of
their rarest elements: of so many that two linked sets cannot differ in all of them. A chance
segment in common, or a shared passage, thus brings no sets together; through those, nearly all
candidates hang together in one cluster. A rare element of few sets gives pairs, one of many sets
gives tiles, of blocks of sets in the order of their size. Only links that join two groups leave a
tile, never all pairs of one.

Equal sets are one set all along. Elements are 64-bit hashes of the n-grams.

Nulls, ties, repeats: a text without words, or null, has an empty set and links with nothing; with
fewer words than an n-gram has, all of them are one element; a row without an id has no component
and links with nothing; rows with the same doc_id are compared each for itself; extra columns are
ignored; an empty table gives an empty table. Of equal sets the document with the smallest id stands
for all. The set of a very long text is made whole, and such sets share tiles with few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsift.cluster import drop_scratch, join_lookup, may_broadcast
from termsift.llm.common import (
    components,
    release_shuffles,
    scratch_dropped,
    stored,
    tidy,
    written,
)

NGRAM = 4

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85

#: Candidates in a block, and bytes of their elements at most, about; a tile holds two blocks.
BLOCK, BLOCK_BYTES = 1024, 16 << 20

#: Parts of the keys for each of the usual shuffle partitions.
KEY_PARTS = 4

#: Sets of an element up to which they are paired one by one; more are compared in tiles.
PAIRED = 128

#: Slots in which elements are counted, slots that a task reports, and slots that are kept. They only
#: order elements by how common they are: any order finds every link, a good one compares less.
SLOTS, TASK_SLOTS, COMMON_SLOTS = 1 << 22, 1 << 16, 1 << 18

#: Sets that a task knows to have sent already.
_SEEN = 1_000_000

_U = np.uint64
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64 mixed bits of every value."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, as far as a text has needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 15)
            factor = np.full(size, _BASE, np.uint64)
            other = np.full(size, _INVERSE, np.uint64)
            factor[0] = other[0] = 1
            cls.up, cls.down = np.cumprod(factor), np.cumprod(other)
        return cls.up[:n], cls.down[:n]


def shingle_set(text: str | None, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _GAPS[raw], [True]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up[:-1], out=total[1:])
    words = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = min(ngram, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _U(_BASE) + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(h))


def fingerprint(own: np.ndarray) -> int:
    """64 bits of a set."""
    return int(_mixed(np.array([_mixed(own).sum() + _U(len(own))], np.uint64)).view(np.int64)[0])


# -- bands and segments ---------------------------------------------------------------------------


def band_starts(largest: int, percent: int = PERCENT) -> list[int]:
    """Smallest sizes of the bands: a set's smaller partner is in its band or the one before.

    Wide bands have more segments for their smaller sets, narrow ones have more sets that need
    keys for two bands; a factor of 1.6 makes the fewest keys.
    """
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent), starts[-1] * 8 // 5))
    return starts


class Bands:
    """Bands of set sizes, and the segment keys of a set."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.starts = percent, band_starts(1, percent)

    def _segments(self, band: int) -> tuple[int, int]:
        """Differences that a linked pair may have whose larger set is in the band, and spare ones."""
        largest = self.starts[band + 1] - 1
        apart = 100 - self.percent
        differences = 2 * apart * largest // (100 + self.percent)
        return differences, differences // 20 + 1

    def keys(self, own: np.ndarray) -> np.ndarray:
        """Keys of which every linked set has at least one, too."""
        n = len(own)
        if self.starts[-2] <= n:
            self.starts = band_starts(2 * n, self.percent)
        band = int(np.searchsorted(self.starts, n, side="right")) - 1
        out = []
        for level in (band, band + 1):
            if level > band and 100 * n < self.percent * self.starts[level]:
                continue
            differences, spare = self._segments(level)
            if not differences:
                continue  # only equal sets link
            count = differences + 1 + spare
            segment = ((own >> _U(32)) * _U(count)) >> _U(32)
            bounds = np.searchsorted(segment, np.arange(count + 1, dtype=np.uint64))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(own + _U(level)))))
            key = total[bounds[1:]] - total[bounds[:-1]]
            key = _mixed(key + (np.arange(count, dtype=np.uint64) << _U(20)) + _U(level + 1))
            held = bounds[1:] > bounds[:-1]
            # With more than the spare segments empty, empty ones count as well: two such sets
            # may have no other segment in common.
            out.append(key if count - held.sum() > spare else key[held])
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


# -- comparing --------------------------------------------------------------------------------------


def linked(a: int, b: int, both: np.ndarray | int, percent: int = PERCENT):
    """Whether sets of these sizes with that overlap link."""
    return 100 * both >= percent * (a + b - both)


def bitmap(own: np.ndarray) -> np.ndarray:
    """A set's bits as 64-bit words: a power of two, four times as many as elements at least."""
    bits = 1 << max(6, (4 * len(own) - 1).bit_length())
    place = np.unique(own & _U(bits - 1)).astype(np.int64)
    marks = np.zeros(bits, np.uint8)
    marks[place] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of the narrowest width among them."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


def overlap_bound(maps: np.ndarray, sizes: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of set ``k`` with others, by bit counts."""
    both = np.bitwise_count(maps[others] & maps[k]).sum(axis=1, dtype=np.int64)
    only_k = int(np.bitwise_count(maps[k]).sum()) - both
    only_other = np.bitwise_count(maps[others]).sum(axis=1, dtype=np.int64) - both
    return np.minimum(sizes[k] - only_k, sizes[others] - only_other)


def _near(
    maps: np.ndarray, sizes: np.ndarray, group: np.ndarray, second: np.ndarray, percent: int
) -> Iterator[tuple[int, np.ndarray]]:
    """Per set, those further on in another group that it may link with, by their bit counts.

    ``second`` marks the second block of a tile of two; if there is only one, all are compared.
    ``group`` may change on the way.
    """
    one = not second.any() or bool(second.all())
    order = np.arange(len(sizes))
    for k in order if one else order[~second]:
        others = order[k + 1 :] if one else order[second]
        others = others[group[others] != group[k]]
        others = others[linked(sizes[k], sizes[others], np.minimum(sizes[k], sizes[others]), percent)]
        if len(others):
            bound = overlap_bound(maps, sizes, k, others)
            yield k, others[linked(sizes[k], sizes[others], bound, percent)]


def may_link(
    maps: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, second: np.ndarray,
    percent: int = PERCENT,
) -> np.ndarray:
    """Which sets of a tile may link with one of another group there."""
    out = np.zeros(len(sizes), bool)
    for k, others in _near(folded(maps), sizes, group, second, percent):
        out[others] = True
        out[k] |= len(others) > 0
    return out


def compare_tile(
    sets: list[np.ndarray], group: np.ndarray, second: np.ndarray, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Links (by position) that join sets of different groups; one per joined pair of groups."""
    sizes = np.array([len(s) for s in sets])
    _, group = np.unique(group, return_inverse=True)
    out = []
    for k, others in _near(folded([bitmap(s) for s in sets]), sizes, group, second, percent):
        for other in others.tolist():
            if group[other] == group[k]:
                continue
            both = len(np.intersect1d(sets[k], sets[other], assume_unique=True))
            if linked(sizes[k], sizes[other], both, percent):
                out.append((k, other))
                group[group == group[other]] = group[k]
    return out


# -- the join ---------------------------------------------------------------------------------------


def signed(documents: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Per document: set size, fingerprint, and the keys unless its task has sent them already."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, prints, keys = [], [], []
                docs = part.column("doc_id").to_pylist()
                for doc, text in zip(docs, part.column("text").to_pylist(), strict=True):
                    own = shingle_set(text, ngram)
                    sizes.append(len(own))
                    prints.append(fingerprint(own) if len(own) else None)
                    if doc is None or prints[-1] in seen:
                        keys.append(np.zeros(0, np.int64))
                    else:
                        keys.append(bands.keys(own) if len(own) else np.zeros(0, np.int64))
                        seen.add(prints[-1])
                if len(seen) > _SEEN:
                    seen.clear()
                offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(sizes, pa.int64()),
                        pa.array(prints, pa.int64()),
                        pa.ListArray.from_arrays(offsets, np.concatenate(keys)),
                    ],
                    names=["doc_id", "n_shingles", "set", "keys"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        tidy(sign), "doc_id bigint, n_shingles bigint, set bigint, keys array<bigint>"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and set: those of keys that several sets have, with the first set."""
    last_key = last_set = head = None
    head_sent = False
    for batch in batches:
        key, own = batch.column("key").to_numpy(), batch.column("set").to_numpy()
        if not len(key):
            continue
        carried = last_key is not None and key[0] == last_key
        new_key = np.concatenate(([not carried], key[1:] != key[:-1]))
        new_set = new_key | np.concatenate(([own[0] != last_set], own[1:] != own[:-1]))
        key, own, new_key = key[new_set], own[new_set], new_key[new_set]
        if not len(key):
            continue
        run = np.cumsum(new_key)  # 0: the run that the batch before has begun
        firsts = np.flatnonzero(new_key)
        heads = np.concatenate(([own[0] if head is None else head], own[firsts]))[run]
        size = np.bincount(run, minlength=run[-1] + 1)
        several = size[run] > 1
        several[run == 0] = True
        out_key, out_set, out_head = key[several], own[several], heads[several]
        if run[0] == 0 and not head_sent:
            out_key, out_set = np.append(out_key, last_key), np.append(out_set, head)
            out_head = np.append(out_head, head)
            head_sent = True
        if len(firsts):
            head_sent = bool(size[-1] > 1)
        last_key, last_set, head = key[-1], own[-1], heads[-1]
        if len(out_key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_key), pa.array(out_set), pa.array(out_head)],
                names=["key", "set", "head"],
            )


def _sets(documents: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """The sets themselves: (set, size, bits, elements) of ``wanted`` (doc_id, set), a row per set.

    A set comes more than once only where rows repeat its document.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingle_set(text, ngram) for text in part.column("text").to_pylist()]
                found = [fingerprint(own) if len(own) else None for own in sets]
                keep = [a == b for a, b in zip(found, part.column("set").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f for f, k in zip(found, keep, strict=True) if k], pa.int64()),
                        pa.array([len(s) for s, k in zip(sets, keep, strict=True) if k], pa.int64()),
                        pa.array([bitmap(s).tobytes() for s, k in zip(sets, keep, strict=True) if k], pa.binary()),
                        pa.array([s.tobytes() for s, k in zip(sets, keep, strict=True) if k], pa.binary()),
                    ],
                    names=["set", "size", "bits", "elements"],
                )

    count = wanted.count()
    side = F.broadcast(wanted) if may_broadcast(count) else wanted
    texts = documents.select("doc_id", "text").join(side, "doc_id").select("set", "text")
    return texts.mapInArrow(tidy(make), "set bigint, size bigint, bits binary, elements binary")


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers per row, broadcast where its counted rows allow it."""
    return F.broadcast(table) if may_broadcast(table.count()) else table


def _compare_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of (set, head), a written table. Bitmaps first; sets only of the pairs that may link."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.array([False, True])
        for batch in batches:
            rows = batch.select(["bits", "head_bits", "size", "head_size"]).to_pylist()
            keep = [
                may_link(
                    [np.frombuffer(r["bits"], np.uint64), np.frombuffer(r["head_bits"], np.uint64)],
                    np.array([r["size"], r["head_size"]]), two, two, percent,
                ).any()
                for r in rows
            ]
            yield batch.select(["set", "head"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.array([False, True])
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                a, b = (
                    [np.frombuffer(b, np.uint64) for b in part.column(name).to_pylist()]
                    for name in ("elements", "head_elements")
                )
                keep = [bool(compare_tile([x, y], two, two, percent)) for x, y in zip(a, b, strict=True)]
                yield part.select(["set", "head"]).filter(pa.array(keep, pa.bool_()))

    def together(pairs: DataFrame, *columns: str) -> DataFrame:
        # of the sets, only what a pair needs is moved
        heads = stored(pairs.select("head").distinct(), "heads")
        named = [F.col("set").alias("head"), *[F.col(c).alias(f"head_{c}") for c in columns]]
        of_head = sets.select(*named).join(_small(heads), "head")
        return sets.select("set", *columns).join(_small(pairs), "set").join(of_head, "head")

    bits = together(pairs, "size", "bits")
    near = stored(bits.mapInArrow(tidy(select), "set bigint, head bigint"), "pairs")
    return together(near, "elements").mapInArrow(tidy(compare), "set bigint, head bigint")


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """Which blocks of a cluster to compare: (cluster, block, i, j), a row per block and tile.

    ``members`` (set, comp, cluster, size) get a column ``block``. The largest component of a
    cluster is not compared with itself, and blocks whose sizes are too far apart never meet.
    """
    comps = members.groupBy("cluster", "comp").count()
    largest = comps.groupBy("cluster").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
    band = F.floor(F.log("size") / F.log(F.lit(1.1))).cast("int")
    # a cluster may hold most of the members: what is known of it goes to them, measured or salted
    look_up = lambda rows, table, keys: join_lookup(
        rows, table, keys, may_broadcast(table.count()), salt_by="set"
    )
    placed = look_up(members, stored(largest, "largest"), ["cluster"])
    placed = placed.withColumn("main", F.col("comp") == F.col("main")).withColumn("band", band)
    counts = stored(placed.groupBy("cluster", "main", "band").count(), "bands")
    each = 8 * F.pow(F.lit(1.1), F.col("band") + 1)
    parts = F.ceil(F.col("count") * F.greatest(F.lit(1 / BLOCK), each / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("set"), parts)
    name = F.concat_ws("-", "main", "band", part.cast("string")).alias("block")
    placed = look_up(placed, counts, ["cluster", "main", "band"])
    placed = stored(placed.select("set", "comp", "cluster", "size", "main", name), "members")
    blocks = placed.groupBy("cluster", "block", "main").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    blocks = stored(blocks, "blocks")
    side = lambda k: blocks.select("cluster", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "main", "lo", "hi")])
    near = (100 * F.col("hi_i") >= percent * F.col("lo_j")) & (100 * F.col("hi_j") >= percent * F.col("lo_i"))
    once = ~F.col("main_i") & (F.col("main_j") | (F.col("block_i") <= F.col("block_j")))
    pairs = join_lookup(side("i"), side("j"), ["cluster"], may_broadcast(blocks.count()), salt_by="block_i")
    pairs = pairs.where(once & near)
    pairs = pairs.select("cluster", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return placed.join(ends, ["cluster", "block"]).select("set", "comp", "cluster", "block", "i", "j")


def _compare_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among ``members`` (set, comp, cluster, size), by cluster.

    Bitmaps alone go to the tiles first; the sets follow where a pair may link.
    """
    second = lambda table: np.array(table["block"].to_pylist()) != table["i"][0].as_py()

    def select(table: pa.Table) -> pa.Table:
        maps = [np.frombuffer(b, np.uint64) for b in table["bits"].to_pylist()]
        sizes, comp = table["size"].to_numpy(), table["comp"].to_numpy()
        keep = may_link(maps, sizes, comp, second(table), percent)
        return table.drop(["bits", "size"]).filter(pa.array(keep))

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(b, np.uint64) for b in table["elements"].to_pylist()]
        own = table["set"].to_numpy()
        found = compare_tile(sets, table["comp"].to_numpy(), second(table), percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays(
            [pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], names=["set", "head"]
        )

    tiles = stored(_tiles(members, percent), "tiles")
    schema = tiles.schema
    tiles = sets.select("set", "size", "bits").join(_small(tiles), "set").select(*schema.names, "size", "bits")
    near = stored(tiles.groupBy("cluster", "i", "j").applyInArrow(select, schema), "near")
    near = sets.select("set", "elements").join(_small(near), "set")
    return near.groupBy("cluster", "i", "j").applyInArrow(compare, "set bigint, head bigint")


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(own, np.uint64) for own in batch.column("elements").to_pylist()]


def _slot(own: np.ndarray) -> np.ndarray:
    return (own & _U(SLOTS - 1)).astype(np.int64)


def _common_slots(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the elements that most sets have, in order, and their counts; of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for own in _arrays(batch.slice(at, 1024)):
                    np.add.at(held, _slot(own), 1)
        chance = held.mean()  # what a slot holds of elements that few sets have
        slots = np.flatnonzero(held >= max(2, chance + 3 * chance**0.5))
        if len(slots) > TASK_SLOTS:
            slots = slots[np.argpartition(held[slots], -TASK_SLOTS)[-TASK_SLOTS:]]
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held[slots])], names=["slot", "n"])

    counted = sets.select("elements").mapInArrow(tidy(count), "slot bigint, n int")
    counted = stored(counted.groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    most = counted.orderBy(F.desc("n"), "slot").limit(COMMON_SLOTS).toArrow().sort_by("slot")
    return most["slot"].to_numpy(), most["n"].to_numpy()


def rare_elements(own: np.ndarray, slots: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """So many of the rarest elements of a set, rarest first, that every linked set has one of its own there.

    A set has at least ``percent`` of its elements in common with a linked one. Take the first of them
    in the order of all elements: in either set, at most all the others stand before it.
    """
    n = len(own)
    slot = _slot(own)
    at = np.minimum(np.searchsorted(slots, slot), max(len(slots) - 1, 0))
    common = np.where(slots[at] == slot, counts[at], 0) if len(slots) else np.zeros(n, np.int64)
    return own[np.lexsort((own, common))[: n - -(-percent * n // 100) + 1]]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those of keys that several rows have."""
    last, last_repeats = None, False  # the last row waits for the batch that follows
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        repeats = np.concatenate(([last_repeats], same))
        last, last_repeats = batch.slice(batch.num_rows - 1), bool(repeats[-1])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(repeats[:-1] | same))
    if last_repeats:
        yield last


def _rare_runs(sets: DataFrame, percent: int) -> DataFrame:
    """Rare elements that several sets have, as (key, set, size, place); the place is from 0."""
    slots, counts = _common_slots(sets)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rare = [rare_elements(own, slots, counts, percent) for own in _arrays(part)]
                lengths = [len(r) for r in rare]
                place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(rare).view(np.int64)),
                        pa.array(np.repeat(part.column("set").to_numpy(), lengths)),
                        pa.array(np.repeat(part.column("size").to_numpy(), lengths).astype(np.int32)),
                        pa.array(place),
                    ],
                    names=["key", "set", "size", "place"],
                )

    rows = sets.select("set", "size", "elements")
    rows = rows.mapInArrow(tidy(choose), "key bigint, set bigint, size int, place int")
    parts = KEY_PARTS * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "key").sortWithinPartitions("key")
    return stored(ordered.mapInArrow(tidy(_repeated), rows.schema), "rare")


def _labelled(rows: DataFrame, joined: DataFrame, of: str = "set", name: str = "comp") -> DataFrame:
    """Rows with the component of a set of theirs; a set that is joined to none is its own."""
    comp = joined.select(F.col("node").alias(of), F.col("root").alias(name))
    found = join_lookup(rows, comp, [of], may_broadcast(comp.count()), salt_by="key", how="left")
    return found.withColumn(name, F.coalesce(name, of))


def _all_joined(runs: DataFrame, joined: DataFrame) -> bool:
    """Whether the sets of each key are in one component: every set in that of its key's first set."""
    both = _labelled(_labelled(runs, joined), joined, "head", "head_comp")
    return both.where("comp != head_comp").isEmpty()


def _apart(runs: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of keys whose sets are in several components, with ``comp`` and the key's number of rows."""
    labelled = _labelled(runs, joined)
    keys = labelled.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")
    )
    keys = keys.where("low != high").drop("low", "high")
    return stored(labelled.join(keys, "key"), "apart")


def _rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (set, head) of sets of different components that share a rare element and may link.

    From the first rare element that they share, they have no more in common than the elements from
    there on in either of them.
    """
    # named by aliases only: both sides are one table to Spark, which moves it once
    own, head = rows.alias("own"), rows.alias("head")
    most = F.least(F.expr("own.size - own.place"), F.expr("head.size - head.place"))
    near = (100 + percent) * most >= percent * F.expr("own.size + head.size")
    apart = F.expr("own.set > head.set AND own.comp != head.comp")
    found = own.join(head, F.expr("own.key = head.key")).where(apart & near)
    return stored(found.select(F.col("own.set"), F.col("head.set").alias("head")).distinct(), "candidates")


def _joined_sets(
    documents: DataFrame, ngram: int, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sets, one document of each set, and the linked sets as (node, root)."""
    spark = documents.sparkSession
    path = written(signed(documents, ngram, percent), "signed")
    try:
        docs = spark.read.parquet(path)
        keys = docs.where(F.size("keys") > 0).select("set", F.explode("keys").alias("key"))
        # by far the most rows of all steps: sorted in smaller parts than the others
        parts = KEY_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = keys.repartition(parts, "key").sortWithinPartitions("key", "set")
        runs = stored(ordered.mapInArrow(tidy(_runs), "key bigint, set bigint, head bigint"), "runs")
        docs = stored(docs.select("doc_id", "n_shingles", "set"), "sizes", keep=True)
    finally:
        drop_scratch(spark, path)
    release_shuffles(spark)
    # sets of candidates, from one document each
    candidates = stored(runs.select("set").distinct(), "chosen")
    classes = docs.where("set is not null and doc_id is not null").groupBy("set")
    classes = stored(classes.agg(F.min("doc_id").alias("doc_id")), "classes", keep=True)
    sets = stored(_sets(documents, classes.join(candidates, "set"), ngram), "sets")
    # every candidate with one other
    pairs = stored(runs.where("set != head").groupBy("set").agg(F.min("head").alias("head")), "firsts")
    links = stored(_compare_pairs(pairs, sets, percent), "links")
    release_shuffles(spark)
    joined = components(links, "set", "head")
    # what shares a key and is not joined yet, by rare elements
    if not _all_joined(runs, joined):
        rest = _apart(_rare_runs(sets, percent), joined)
        release_shuffles(spark)
        pairs = _rare_pairs(rest.where(F.col("n") <= PAIRED), percent)
        more = stored(_compare_pairs(pairs, sets, percent), "links")
        many = rest.where(F.col("n") > PAIRED)
        members = many.select("set", "comp", F.col("key").alias("cluster"), F.col("size").cast("bigint"))
        if not many.isEmpty():
            more = more.unionByName(stored(_compare_groups(members.distinct(), sets, percent), "links"))
        joined = components(links.unionByName(more), "set", "head")
    return docs, classes, joined


def near_duplicates(documents: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id``."""
    documents = documents.select("doc_id", "text")
    with scratch_dropped(documents.sparkSession):
        docs, classes, joined = _joined_sets(documents, ngram, percent)
    # from sets back to documents; rows with one doc_id are one node
    comp = joined.select(F.col("node").alias("set"), F.col("root").alias("comp"))
    grouped = classes.join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    least = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = grouped.join(least, "comp").select("set", "component_id")
    return docs.join(of_set, "set", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(documents: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Documents without the near-duplicates: the one with the smallest id of each group stays.

    A document without an id stays; rows with the same id stay or go together.
    """
    found = near_duplicates(documents, ngram, percent)
    gone = stored(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    small = may_broadcast(gone.count())
    return documents.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(
        *documents.columns
    )
