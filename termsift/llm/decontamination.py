"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of the normalised benchmark items knows every run of words in them. A document's
words are streamed through it; at each word it holds the length of the longest run that ends there
and occurs in an item. Where that length reaches the window, the last words are a window of an
item. Words that no item has reset the automaton, so only stretches of item words are streamed.

A benchmark is cut into blocks of a bounded number of words, of which the driver and a worker hold
one at a time. With a single block, as usual, documents are read once. With several, the texts are
streamed past one block after the other; what each has hit is written by the digest of the text,
and the hits of a text are put together by a join.

Nulls, ties, repeats: a null or empty text has no words and no hits; null items and items without
words are ignored; an item without an id hits words, but has no name to be counted by; rows with the
same doc_id are handled each for itself; equal items all count; a very long text is streamed whole;
extra columns pass through ``remove_spans`` and are ignored by ``find_spans``; empty tables are
fine on either side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsift.cluster import join_lookup, may_broadcast
from termsift.llm.common import free_name, stored, tidy

WINDOW = 10

#: Words of benchmark items in one automaton: below 100 MB in a Python worker.
BLOCK_WORDS = 100_000

#: A document is dropped when more than this share of its words is hit.
MAX_COVERAGE = 0.5

# Words: a run of ASCII letters, digits and characters beyond ASCII, in lower case.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """All runs of words of several items. ``add`` them, then ``finish``, then ``hits``."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[object, list[int]]] = []

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            exact = self.length[q] == self.length[p] + 1
            self.link[new] = q if exact else self._split(p, q, word)
        return new

    def add(self, item_id: object, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words]
        if not ids:
            return
        last = 0
        for word in ids:
            last = self._extend(last, word)
        self.items.append((item_id, ids))

    def finish(self) -> SuffixAutomaton:
        """Note the windows: at the state that holds a window, its length and items."""
        own: dict[tuple[int, int], set] = {}
        self.shortest = min([min(self.window, len(ids)) for _, ids in self.items], default=0)
        for item_id, ids in self.items:
            size = min(self.window, len(ids))
            state = 0
            for k, word in enumerate(ids):
                state = self.next[state][word]
                if k + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    own.setdefault((at, size), set()).add(item_id)
        at_state: dict[int, list] = {}
        for (state, size), items in own.items():
            at_state.setdefault(state, []).append((size, frozenset(items)))
        # windows of a state and of all its suffixes, the shortest strings first
        self.windows: list[tuple] = [()] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.windows[self.link[state]] if state else ()
            here = at_state.get(state)
            self.windows[state] = (*above, *here) if here else above
        return self

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Per word, whether an occurrence of a window covers it; and the items with windows."""
        n = len(words)
        hit = np.zeros(n, bool)
        found: set = set()
        if not self.items or n < self.shortest:
            return hit, found
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * n), np.int64, n)
        # only stretches of item words as long as the shortest window
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        following, link, length, windows = self.next, self.link, self.length, self.windows
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = matched = 0
            for k, word in enumerate(ids[start:end].tolist(), start):
                while state and word not in following[state]:
                    state = link[state]
                    matched = length[state]
                if word in following[state]:
                    state = following[state][word]
                    matched += 1
                for size, items in windows[state]:
                    if size <= matched:
                        hit[k + 1 - size : k + 1] = True
                        found |= items
        return hit, found


class ItemBlock(NamedTuple):
    """Benchmark items (item_id, text) of a bounded number of words."""

    rows: DataFrame
    window: int

    def shared(self) -> Broadcast:
        """Their automaton, broadcast."""
        automaton = SuffixAutomaton(self.window)
        for row in self.rows.toLocalIterator():
            automaton.add(row.item_id, words_of(row.text))
        return self.rows.sparkSession.sparkContext.broadcast(automaton.finish())


def automata(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS) -> list[ItemBlock]:
    """The items in blocks of about ``block`` words, dealt by their hashes; one if they fit into one."""
    items = benchmark.select("item_id", "text").where("text is not null")
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    if total <= block:
        return [ItemBlock(items, window)]
    n = -(-5 * total // (4 * block))
    number = F.pmod(F.xxhash64("text", "item_id"), F.lit(n)).alias("_block")
    dealt = stored(items.select("*", number).sort("_block"), "items")
    return [ItemBlock(dealt.where(F.col("_block") == k).drop("_block"), window) for k in range(n)]


def _hits_by_text(documents: DataFrame, blocks: list[ItemBlock]) -> DataFrame:
    """What the blocks hit in the texts: (_digest, spans, items), written; a row per text with hits."""
    texts = documents.where("text is not null").select(F.sha2("text", 256).alias("_digest"), "text")
    parts = None
    for block in blocks:
        shared = block.shared()

        def find(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: tuple[list, ...] = ([], [], [])
                digests, own = batch.column("_digest").to_pylist(), batch.column("text").to_pylist()
                for digest, text in zip(digests, own, strict=True):
                    hit, items = shared.value.hits(words_of(text))
                    if hit.any():
                        names = [str(item) for item in items if item is not None]
                        for column, value in zip(rows, (digest, _spans(hit), names), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[0], pa.string()), pa.array(rows[1], pa.list_(pa.list_(pa.int64()))),
                        pa.array(rows[2], pa.list_(pa.string())),
                    ],
                    names=["_digest", "spans", "items"],
                )

        schema = "_digest string, spans array<array<bigint>>, items array<string>"
        found = stored(texts.mapInArrow(find, schema).dropDuplicates(["_digest"]), "hits")
        shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy("_digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return stored(merged, "hits")


def _with_hits(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Documents with the ``_spans`` and ``_items`` of their texts, null where nothing is hit."""
    size = hits.agg(F.count("*"), F.sum(64 + 24 * F.size("spans") + 24 * F.size("items"))).first()
    keyed = documents.withColumn("_digest", F.sha2("text", 256))
    hits = hits.select("_digest", F.col("spans").alias("_spans"), F.col("items").alias("_items"))
    few = may_broadcast(size[0], size[1] or 0)
    # copies of one text are one digest: its rows are cut by their other columns where they are many
    by = "doc_id" if "doc_id" in documents.columns else "text"
    return join_lookup(keyed, hits, ["_digest"], few, salt_by=by, how="left").drop("_digest")


def _mask(n: int, spans: list | None) -> np.ndarray:
    hit = np.zeros(n, bool)
    for first, end in spans or ():
        hit[first:end] = True
    return hit


def _without(text: str, hit: np.ndarray) -> str:
    """The text with a line break in place of each run of hit words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for first, end in _spans(hit):
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    kept.append(raw[at:])
    return b"\n".join(kept).decode()


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_REPORT = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(),
    "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()),
    "spans": pa.list_(pa.list_(pa.int64())),
}


def find_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, and the spans of hit words.

    ``items`` is sorted as strings; ``spans`` are [first word, end); ``items_sha256`` is the
    sha256 of the comma-joined items.
    """
    blocks = automata(benchmark, window)
    shared = blocks[0].shared() if len(blocks) == 1 else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            known = [None] * len(texts)
            if shared is None:
                known = zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)
            out = []
            for doc, text, own in zip(docs, texts, known, strict=True):
                words = words_of(text)
                if shared is None:
                    hit, names = _mask(len(words), own[0]), sorted(own[1] or [])
                else:
                    hit, items = shared.value.hits(words)
                    names = sorted(str(item) for item in items if item is not None)
                digest = hashlib.sha256(",".join(names).encode()).hexdigest()
                n_hit = int(hit.sum())
                spans = _spans(hit) if n_hit else []
                out.append((doc, len(words), n_hit, len(names), digest, n_hit > 0, names, spans))
            columns = zip(*out, strict=True) if out else [[]] * len(_REPORT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _REPORT.values(), strict=True)],
                names=list(_REPORT),
            )

    rows = documents.select("doc_id", "text")
    if shared is None:
        rows = _with_hits(rows, _hits_by_text(rows, blocks))
    return rows.mapInArrow(
        find,
        "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string,"
        " contaminated boolean, items array<string>, spans array<array<bigint>>",
    )


def remove_spans(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """Documents without their spans of benchmark words; the columns stay.

    A span is cut out of the text and a line break put in its place, again until no window is
    left. A document of which more than ``max_coverage`` is hit, or nothing is left, goes. All
    others keep their text to the letter. ``n_chars`` follows the text where there is one.
    """
    blocks = automata(benchmark, window)
    if len(blocks) > 1:
        return _remove_by_blocks(documents, blocks, max_coverage)
    shared = blocks[0].shared()

    def clean(text: str | None) -> tuple[bool, str | None]:
        total = removed = 0
        while True:
            words = words_of(text)
            total = total or len(words)
            hit, _ = shared.value.hits(words)
            if not hit.any():
                return True, text
            removed += int(hit.sum())
            if removed > max_coverage * total or removed == total:
                return False, None
            text = _without(text, hit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield _replaced(rows, [clean(text) for text in rows.column("text").to_pylist()])

    return documents.mapInArrow(tidy(cut), documents.schema)


def _replaced(rows: pa.RecordBatch, found: list[tuple[bool, str | None]]) -> pa.RecordBatch:
    """Rows with new texts, and without those that go."""
    columns = dict(zip(rows.schema.names, rows.columns, strict=True))
    texts = columns["text"].to_pylist()
    changed = [new != old for (_, new), old in zip(found, texts, strict=True)]
    if not any(changed):
        return rows
    texts = [new for _, new in found]
    columns["text"] = pa.array(texts, columns["text"].type)
    if "n_chars" in columns:
        sizes = zip(changed, texts, columns["n_chars"].to_pylist(), strict=True)
        sizes = [len(t or "") if new else old for new, t, old in sizes]
        columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
    rows = pa.RecordBatch.from_arrays(list(columns.values()), schema=rows.schema)
    return rows.filter(pa.array([keep for keep, _ in found]))


def _remove_by_blocks(documents: DataFrame, blocks: list[ItemBlock], max_coverage: float) -> DataFrame:
    """The same round by round: all blocks are hit before a text is cut, until none hits any more."""
    total, removed = free_name(documents, "total"), free_name(documents, "removed")
    current = documents.withColumns({total: F.lit(0), removed: F.lit(0)})
    schema = current.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                known = [rows.column(c).to_pylist() for c in ("text", "_spans", total, removed)]
                found, counts = [], ([], [])
                for text, spans, all_, gone in zip(*known, strict=True):
                    keep = True
                    if spans:
                        words = words_of(text)
                        hit = _mask(len(words), spans)
                        all_, gone = all_ or len(words), gone + int(hit.sum())
                        keep = gone <= max_coverage * all_ and gone != all_
                        text = _without(text, hit) if keep else None
                    found.append((keep, text))
                    counts[0].append(all_)
                    counts[1].append(gone)
                columns = {name: rows.column(name) for name in schema.names}
                columns[total], columns[removed] = (pa.array(c, pa.int32()) for c in counts)
                yield _replaced(
                    pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)), found
                )

    while True:
        hits = _hits_by_text(current.select("text"), blocks)
        if hits.isEmpty():
            return current.drop(total, removed)
        current = stored(_with_hits(current, hits).mapInArrow(tidy(cut), schema), "cut")
