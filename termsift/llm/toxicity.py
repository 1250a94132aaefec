"""Toxicity by a small bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own learned vector and the mean of the vectors of its hashed character
n-grams, so that unseen words are judged by their parts. A text is cut into overlapping windows of
words; every window is scored and the highest score is the document's. The network is trained on
the driver, on a bounded sample of labelled documents: a toxic document is represented by the
window that the network itself scores highest so far, any other by random windows. The sample is
bounded by documents and by windows of a document, which tasks choose; no document is too long.

Nulls, ties, repeats: null and empty texts have one empty window and get a score; null labels and
null ids are no examples, a document with several labels counts as toxic; rows with the same
doc_id are scored each for itself, and the least of their texts teaches; extra columns pass
through; an empty table gives an empty table. All windows of a very long text are scored, some
thousand at a time; of windows of equal score the text has that score. Without examples of both
labels, as with an empty table of labels, the score is 0.5 or, with one label, just beside it.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsift.llm.common import crc_split, slices, stored, worker_tool

WINDOW, STRIDE = 48, 36

#: Bounds of the training sample: documents of each label, and windows of such a document. From a
#: longer one, half of the windows are spread evenly, the others are those of the strongest words.
SAMPLE_PER_LABEL = 1200
SAMPLE_WINDOWS = 36

#: Buckets of word hashes, by which tasks judge the windows of long documents.
BUCKETS = 1 << 16

#: Longer runs of letters are several words, so that a window is bounded in bytes too.
WORD_BYTES = 64

#: Empty texts among the examples, not toxic.
EMPTY_EXAMPLES = 20

WORD_ROWS = 20_000
CHAR_ROWS = 1 << 15
DIM, HIDDEN = 6, 8
EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 200, 64, 0.02

#: Words whose inputs a Python worker keeps; it starts anew beyond that.
CACHED_WORDS = 100_000

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_SIZES = (3, 4, 5)


def _words(text: str | None) -> list[bytes]:
    words = (text or "").encode().translate(_FOLD).split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[at : at + WORD_BYTES] for w in words for at in range(0, len(w), WORD_BYTES)]


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ``<word>``: rows of the table, and the word each belongs to."""
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    place = np.arange(len(text))
    rows, owners = [], []
    h = text + np.uint64(1)
    for n in range(2, max(_SIZES) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + text[n - 1 :]
        if n in _SIZES:
            inside = place[: len(h)] + n <= ends[: len(h)]
            mixed = (h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            rows.append((mixed % np.uint64(CHAR_ROWS)).astype(np.int32))
            owners.append(owner[: len(h)][inside])
        if len(h) <= 1:
            break
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(owners)


def windows_of(n: int) -> list[int]:
    """First words of the windows of a text of n words; together they cover all of it."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """The network's arrays, and its forward and backward pass."""

    def __init__(self, vocabulary: list[bytes], seed: int = 7):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.rows = {word: k for k, word in enumerate(vocabulary)}
        self.p = {
            "word": 0.1 * small(len(vocabulary) + 1, DIM), "char": 0.1 * small(CHAR_ROWS, DIM),
            "attend": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }
        for d in ("f", "b"):
            self.p |= {f"W{d}": small(2 * DIM, 3 * HIDDEN), f"U{d}": small(HIDDEN, 3 * HIDDEN)}
            self.p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)

    def known(self, words: list[bytes]) -> np.ndarray:
        last = len(self.rows)
        return np.fromiter((self.rows.get(w, last) for w in words), np.int64, len(words))

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """A row per word: its vector, and the mean vector of its character n-grams."""
        rows, owner = char_grams(words)
        count = np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
        picked = self.p["char"][rows]
        sums = [np.bincount(owner, picked[:, k], len(words)) for k in range(DIM)]
        chars = (np.stack(sums, 1) / count).astype(np.float32)
        return np.concatenate([self.p["word"][self.known(words)], chars], axis=1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction. x: the projected inputs (time, window, 3 * HIDDEN)."""
        steps, size, _ = x.shape
        h = np.zeros((size, HIDDEN), np.float32)
        out = np.empty((steps, size, HIDDEN), np.float32)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        U, two = self.p[f"U{d}"], 2 * HIDDEN
        for t in order:
            g = h @ U
            gates = _sigmoid(x[t, :, :two] + g[:, :two])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[t, :, two:] + r * g[:, two:])
            new = n + z * (h - n)
            new = np.where(mask[t], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, two:]))
            h = out[t] = new
        return out

    def scores(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None):
        """Score of each window from its projected inputs; ``mask`` is (time, window, 1)."""
        tapes = ([], []) if keep is not None else (None, None)
        h = np.concatenate(
            [self._run("f", xf, mask, tapes[0]), self._run("b", xb, mask, tapes[1])], axis=2
        )
        e = np.where(mask[:, :, 0], h @ self.p["attend"], -30)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        weight = np.where(mask[:, :, 0], weight, 0)
        pooled = np.einsum("tb,tbh->bh", weight, h)
        score = _sigmoid(pooled @ self.p["out"] + self.p["bias"])
        if keep is not None:
            keep |= {"h": h, "weight": weight, "pooled": pooled, "tapes": tapes}
        return score

    def gradient(self, ids: np.ndarray, x: np.ndarray, words: list[bytes], target: np.ndarray):
        """Gradient of the mean log loss; ids: (window, time) rows of ``words``, -1 past the end."""
        p = self.p
        mask = (ids.T >= 0)[:, :, None]
        rows = np.where(ids.T >= 0, ids.T, 0)
        seen = x[rows]
        keep: dict = {}
        score = self.scores(
            seen @ p["Wf"] + p["cf"], seen @ p["Wb"] + p["cb"], mask, keep
        )
        d_logit = ((score - target) / len(target)).astype(np.float32)
        h, weight = keep["h"], keep["weight"]
        grad = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, h)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        dh_all = weight[:, :, None] * d_pooled + d_e[:, :, None] * p["attend"]
        grad["attend"] = np.einsum("tb,tbh->h", d_e, h)
        d_seen = np.zeros_like(seen)
        for d, part, tape in zip("fb", (0, HIDDEN), keep["tapes"], strict=True):
            U = p[f"U{d}"]
            gU, dx = np.zeros_like(U), np.zeros((*ids.T.shape, 3 * HIDDEN), np.float32)
            carry = np.zeros((len(ids), HIDDEN), np.float32)
            for t, before, z, r, n, g in reversed(tape):
                dh = carry + dh_all[t, :, part : part + HIDDEN]
                stay, dh = np.where(mask[t], 0, dh), np.where(mask[t], dh, 0)
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * g * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                gU += before.T @ dg
                carry = stay + dh * z + dg @ U.T
            flat = dx.reshape(-1, 3 * HIDDEN)
            grad |= {f"U{d}": gU, f"c{d}": flat.sum(axis=0)}
            grad[f"W{d}"] = seen.reshape(-1, 2 * DIM).T @ flat
            d_seen += dx @ p[f"W{d}"].T
        d_x = np.zeros_like(x)
        np.add.at(d_x, rows[mask[:, :, 0]], d_seen[mask[:, :, 0]])
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], self.known(words), d_x[:, :DIM])
        char_rows, owner = char_grams(words)
        count = np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
        spread = (d_x[:, DIM:] / count)[owner]
        sums = [np.bincount(char_rows, spread[:, k], CHAR_ROWS) for k in range(DIM)]
        grad["char"] = np.stack(sums, 1).astype(np.float32)
        return grad


class Scorer:
    """Scores texts; keeps the projected inputs of words seen by this worker."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, 6 * HIDDEN), np.float32)

    def _places(self, words: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.place) > CACHED_WORDS:
            self.clear()
        fresh = list({w for each in words for w in each}.difference(self.place))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            p, x = self.network.p, self.network.inputs(part)
            rows = np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], axis=1)
            first = len(self.place)
            while len(self.table) < first + len(part):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(part)] = rows
            self.place.update(zip(part, range(first, first + len(part)), strict=True))
        get = self.place.__getitem__
        return [np.fromiter(map(get, each), np.int64, len(each)) for each in words]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text."""
        out = []
        for run in slices(texts, lambda t: len(t or "")):
            out.append(self._run([_words(text) for text in run]))
        return np.concatenate(out) if out else np.zeros(0)

    def _run(self, words: list[list[bytes]]) -> np.ndarray:
        places = self._places(words)
        ids, owner = window_rows(places)
        best = np.zeros(len(words))
        half = 3 * HIDDEN
        order = np.argsort((ids >= 0).sum(axis=1), kind="stable")
        for at in range(0, len(ids), 2048):
            part = order[at : at + 2048]
            rows = ids[part].T
            rows = rows[: max(1, (rows >= 0).any(axis=1).sum())]
            x = self.table[np.where(rows >= 0, rows, 0)]
            score = self.network.scores(x[:, :, :half], x[:, :, half:], (rows >= 0)[:, :, None])
            np.maximum.at(best, owner[part], score)
        return best


def window_rows(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(window, WINDOW) rows of words, -1 past the end of a text; and the text of each window."""
    sizes = np.array([len(p) for p in places])
    counts = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STRIDE) + 1, 1)
    owner = np.repeat(np.arange(len(places)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = number[:, None] * STRIDE + np.arange(WINDOW)
    flat = np.concatenate([*places, np.array([-1])])
    base = np.cumsum(sizes) - sizes
    at = np.where(inside < sizes[owner][:, None], base[owner][:, None] + inside, len(flat) - 1)
    return flat[at], owner


# -- training -------------------------------------------------------------------------------------


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


def choose_windows(words: list[bytes], odds: np.ndarray) -> list[bytes]:
    """The text in up to ``SAMPLE_WINDOWS`` of its windows; neighbours among them are one piece."""
    starts = windows_of(len(words))
    n = len(starts)
    if n <= SAMPLE_WINDOWS:
        return [b" ".join(words)]
    of_word = odds[_buckets(words)]
    strength = np.array([of_word[at : at + WINDOW].max() for at in starts])
    even = np.linspace(0, n - 1, SAMPLE_WINDOWS // 2).astype(int)
    strength[even] = np.inf
    chosen = np.sort(np.argsort(-strength, kind="stable")[:SAMPLE_WINDOWS])
    runs = np.split(chosen, np.flatnonzero(np.diff(chosen) > 1) + 1)
    return [b" ".join(words[starts[run[0]] : starts[run[-1]] + WINDOW]) for run in runs]


def sample(documents: DataFrame, labels: DataFrame) -> list[tuple[list[bytes], int]]:
    """Up to ``SAMPLE_PER_LABEL`` training texts of each label, picked by a hash of their id.

    The ids are picked from the labels and sent to the documents, so that no text is moved but
    those of the sample. Tasks count over the whole texts how words stand to the labels and choose
    the windows of long ones by that; only those reach the driver, in pieces of folded words.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~crc_split(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    picked = [
        known.where(F.col("_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL)
        for label in (0, 1)
    ]
    texts = documents.select("doc_id", F.col("text").alias("_text"))
    texts = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    # an id may have any number of rows: one of them teaches, combined before the shuffle
    texts = texts.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
    texts = stored(texts, "toxicity_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having = np.zeros((2, BUCKETS + 1), np.int64)  # the last bucket is in every text
        for batch in batches:
            for text, label in zip(batch["_text"].to_pylist(), batch["_label"].to_pylist(), strict=True):
                having[label, np.unique(_buckets(_words(text)))] += 1
                having[label, BUCKETS] += 1
        used = np.flatnonzero(having.any(axis=0))
        columns = [used, having[0, used], having[1, used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "noes", "ones"])

    counts = texts.mapInArrow(count, "bucket bigint, noes bigint, ones bigint")
    counts = counts.groupBy("bucket").agg(F.sum("noes").alias("noes"), F.sum("ones").alias("ones"))
    having = np.zeros((2, BUCKETS + 1))
    for row in counts.collect():
        having[:, row["bucket"]] = row["noes"], row["ones"]
    noes, ones = having[:, :BUCKETS]
    odds = _smoothed(ones, noes, having[1, BUCKETS], having[0, BUCKETS]).astype(np.float32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pieces = [choose_windows(_words(text), odds) for text in part["_text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["_label"], pa.array(pieces, pa.list_(pa.binary()))],
                    names=["doc_id", "_label", "pieces"],
                )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(cut, f"doc_id {id_type}, _label int, pieces array<binary>").collect()
    found = sorted((r["doc_id"], [bytes(p) for p in r["pieces"]], r["_label"]) for r in rows)
    return [(pieces, label) for _, pieces, label in found]


def _smoothed(ones: np.ndarray, noes: np.ndarray, all_ones: int, all_noes: int) -> np.ndarray:
    share = (all_ones + 1) / (all_noes + 1)
    return np.log((ones + 0.5) / (noes + 0.5) / share) * np.minimum(1, (ones + noes) / 5)


def _log_odds(present: list[np.ndarray], label: np.ndarray, width: int) -> np.ndarray:
    """Smoothed log odds of label 1 for each feature, by the number of documents that have it."""
    ones = np.bincount(np.concatenate([p for p, y in zip(present, label, strict=True) if y]), minlength=width)
    noes = np.bincount(np.concatenate([p for p, y in zip(present, label, strict=True) if not y]), minlength=width)
    return _smoothed(ones, noes, label.sum(), len(label) - label.sum())


def train(examples: list[tuple[list[bytes], int]], seed: int = 7) -> Network | float:
    """Train on (pieces, label); without examples of both labels a constant score instead."""
    label = np.array([y for _, y in examples])
    if not 0 < label.sum() < len(label):
        return float((label.sum() + 1) / (len(label) + 2))
    examples = [*examples, *[([b""], 0)] * EMPTY_EXAMPLES]
    label = np.array([y for _, y in examples])
    # words by number at once: the words themselves are kept only once
    row_of: dict[bytes, int] = {}
    pieces, doc_of, places, counts = [], [], [], Counter()
    for number, (texts, _) in enumerate(examples):
        own = [
            np.array([row_of.setdefault(w, len(row_of)) for w in text.split()], np.int32)
            for text in texts
        ]
        pieces += own
        doc_of += [number] * len(own)
        places.append(np.concatenate(own))
        counts.update(set(places[-1].tolist()))
    distinct = list(row_of)
    del row_of
    vocabulary = [distinct[k] for k, n in counts.most_common(WORD_ROWS) if n >= 3]
    network = Network(vocabulary, seed)
    rng = np.random.default_rng(seed)
    # start from how words and n-grams stand to the labels
    grams, owner = char_grams(distinct)
    order = np.argsort(owner, kind="stable")
    by_word = grams[order]
    starts = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    del grams, owner, order
    grams_in = lambda p: np.unique(
        np.concatenate([by_word[starts[k] : starts[k + 1]] for k in np.unique(p)] or [by_word[:0]])
    )
    known = network.known(distinct)
    odds = _log_odds([np.unique(known[p]) for p in places], label, len(vocabulary) + 1)
    odds[-1] = 0
    network.p["word"][:, 0] = odds / 2
    network.p["char"][:, 0] = _log_odds([grams_in(p) for p in places], label, CHAR_ROWS) / 2
    # windows
    ids, piece = window_rows(pieces)
    doc = np.array(doc_of)[piece]
    x = network.inputs(distinct)
    strength = np.where(ids >= 0, x[:, [0, DIM]].sum(axis=1)[np.where(ids >= 0, ids, 0)], -9).max(axis=1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (5 * int(label.sum()))))
    for epoch in range(epochs):
        if epoch:
            strength = _strengths(network, ids, distinct)
        first = np.lexsort((-strength, doc))
        top = first[np.unique(doc[first], return_index=True)[1]]
        positive = top[label[doc[top]] == 1]
        clean = np.flatnonzero(label[doc] == 0)
        hard = top[label[doc[top]] == 0]
        hard = np.concatenate([
            hard[np.argsort(-strength[hard], kind="stable")][: 2 * len(positive)],
            np.flatnonzero((ids < 0).all(axis=1) & (label[doc] == 0))[:EMPTY_EXAMPLES],
        ])
        negative = np.concatenate([hard, rng.choice(clean, min(len(clean), 2 * len(positive)), False)])
        order = rng.permutation(np.concatenate([positive, negative]))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            used, where = np.unique(ids[part], return_inverse=True)
            where = where.reshape(ids[part].shape) - (used[0] < 0)
            own = [distinct[k] for k in used[used >= 0]]
            if not own:
                continue
            grad = network.gradient(where, network.inputs(own), own, label[doc[part]])
            step += 1
            rate = RATE / (1 + epoch * EPOCHS / epochs)
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[name] -= (
                    rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                ).astype(np.float32)
    return network


def _strengths(network: Network, ids: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    p, x = network.p, network.inputs(distinct)
    xf, xb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
    out = []
    for at in range(0, len(ids), 512):
        rows = ids[at : at + 512].T
        safe = np.where(rows >= 0, rows, 0)
        out.append(network.scores(xf[safe], xb[safe], (rows >= 0)[:, :, None]))
    return np.concatenate(out)


def with_toxicity(documents: DataFrame, model: Network | float, column: str = "toxicity") -> DataFrame:
    """Documents with the score of each whole text, from 0 to 1."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    where = documents.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if isinstance(model, Network):
            scorer = worker_tool((Scorer, name), lambda: Scorer(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                texts = rows.column(where).to_pylist()
                found = scorer(texts) if isinstance(model, Network) else np.full(len(texts), model)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(found.astype(float))],
                    names=[*rows.schema.names, column],
                )

    schema = documents.select("*", F.lit(0.0).alias(column)).schema
    return documents.mapInArrow(score, schema)


def fit_toxicity(documents: DataFrame, labels: DataFrame) -> Network | float:
    return train(sample(documents, labels))
