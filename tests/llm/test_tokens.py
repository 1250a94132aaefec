import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from tests.llm.cases import awkward, crc, empty
from termsift.llm import packing, token_files, tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def reference(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path, cut", [(WORD, "bare"), (BYTE, "spaced")])
@pytest.mark.parametrize(
    "letters", ["ab cA\n\t 'st\r!?1éñ\x1c\x85\xa0 ​中İ<|endoftext|>ªß²\xad", "ab 'sTR.,1\né²Às·", "a'l \n."]
)
def test_encoder_gives_the_ids_of_the_library(path, cut, letters, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 50)
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(1500)] + [None, "x" * 5000]
    own, want = tokens.Encoder(path, cut), reference(path)
    for got, text in zip(own.encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == want(text)


class _Counted:
    """A tokenizer, or its model, that counts the characters it is given."""

    def __init__(self, of, given):
        self.of, self.given = of, given

    def __getattr__(self, name):
        return _Counted(self.of.model, self.given) if name == "model" else getattr(self.of, name)

    def encode_batch_fast(self, texts, **options):
        self.given.extend(map(len, texts))
        return self.of.encode_batch_fast(texts, **options)

    def tokenize(self, piece):
        self.given.append(len(piece))
        return self.of.tokenize(piece)


@pytest.mark.parametrize("path, cut", [(WORD, "bare"), (BYTE, "spaced")])
def test_encoder_keeps_the_pieces_in_use(path, cut, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 400)
    own, given = tokens.Encoder(path, cut), []
    for name in ["tokenizer", "model"]:
        monkeypatch.setattr(own, name, _Counted(getattr(own, name, None), given), raising=False)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=8))
    common = [word() for _ in range(100)]
    want = reference(path)
    for _ in range(50):  # a text has the common words and 40 that no other has
        rare = [word() for _ in range(40)]
        text = " ".join(["", *common, *rare])
        (ids,) = own.encode([text])
        assert np.frombuffer(ids, "<u2").tolist() == want(text)
    assert sum(given) < 50 * 40 * 9 + 2 * 100 * 9


def test_encoder_of_a_tokenizer_that_is_not_byte_level(tmp_path):
    vocab = {"[UNK]": 0, " ": 1, "Ġ": 2, "a": 3, "é": 4, "Ã": 5, "aa": 6}
    model = models.BPE(vocab=vocab, merges=[("a", "a")], unk_token="[UNK]")
    path = f"{tmp_path}/plain.json"
    Tokenizer(model).save(path)
    own, want = tokens.Encoder(path, "spaced"), reference(path)
    for text in ["aa", "é", "Ãa", "b"]:
        (ids,) = own.encode([text])
        assert np.frombuffer(ids, "<u2").tolist() == want(text)


def test_packing_holds_every_id_once(spark):
    rnd = random.Random(2)
    docs = awkward(spark, [" ".join(rnd.choices("alpha beta gamma".split(), k=rnd.randint(1, 900))) for _ in range(40)])
    out = packing.pack_documents(spark, docs, WORD, keep_ids=True).collect()
    want = reference(WORD)
    by_doc = {}
    for row in out:
        ids = np.frombuffer(row.ids, "<u2")
        assert row.length == len(ids) <= packing.SEQUENCE and row.ids_crc32 == crc(ids)
        assert row.start == row.piece * packing.SEQUENCE
        by_doc.setdefault(row.doc_id, []).append((row.piece, ids.tolist()))
    for doc, text in docs.select("doc_id", "text").collect():
        ids = [*want(text), packing.END_ID]
        whole = sorted(by_doc[doc])[:: 2 if doc == 5 else 1]
        assert [i for _, part in whole for i in part] == ids
    places = {}
    for row in out:
        places.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE
    total = sum(row.length for row in out)
    assert len(places) <= -(-total // packing.SEQUENCE) + 1
    assert packing.pack_documents(spark, empty(spark), WORD).count() == 0


def test_packed_sequences_are_the_pieces_in_order(spark):
    packed = packing.pack_documents(spark, awkward(spark), WORD, keep_ids=True).cache()
    rows = {r.sequence_id: r for r in packing.packed_sequences(packed).collect()}
    for row in packed.collect():
        own = rows[row.sequence_id].ids
        assert own[2 * row.offset : 2 * (row.offset + row.length)] == row.ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_serves_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = 64
    hist = rng.poisson([0, 0.5, 3, 50][seed], size + 1)
    hist[0] = 0
    plan = packing.plan_sequences(hist)
    used = {}
    for k, (key, first, offset) in enumerate(zip(plan.key, plan.sequence, plan.offset, strict=True)):
        n, start = int(key) >> packing._KEY_BITS, int(key) & ((1 << packing._KEY_BITS) - 1)
        following = int(plan.key[k + 1]) if k + 1 < len(plan.key) else None
        same = following is not None and following >> packing._KEY_BITS == n
        end = following & ((1 << packing._KEY_BITS) - 1) if same else int(hist[n])
        for r in range(start, end):
            used.setdefault(int(first) + r - start, []).append((int(offset), n))
    assert sum(len(v) for v in used.values()) == hist.sum()
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= size and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
    assert len(used) == plan.sequences
    bound = -(-int((hist * np.arange(size + 1)).sum()) // size)
    assert plan.sequences <= bound * 1.2 + 1


def test_nonnegative_least_squares_finds_the_counts():
    hist = np.zeros(17)
    hist[[4, 12, 8]] = 100, 100, 60
    rows = packing.patterns(hist.astype(int))
    x = packing.repeat_counts(rows, hist)
    made = np.zeros(17)
    for row, count in zip(rows, x, strict=True):
        for n in row[row > 0]:
            made[n] += count
    assert (x >= 0).all() and np.abs(made - hist)[1:].max() < 1


def test_token_files_round_trip(spark, tmp_path):
    docs = awkward(spark, ["a short text", "a short text!"])
    folder = f"{tmp_path}/tokens"
    token_files.write_token_files(docs, folder, BYTE, shards=3)
    out = token_files.read_token_files(spark, folder, with_ids=True).collect()
    want = reference(BYTE)
    texts = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    start = 0
    assert len(out) == len(texts)
    for row, (doc, text) in zip(sorted(out, key=lambda r: r.start), texts, strict=True):
        ids = [*want(text), token_files.END_ID]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc, start, len(ids), ids)
        assert row.ids_crc32 == crc(ids)
        start += len(ids)
    shards = [token_files.Shard(folder, r.shard) for r in spark.read.parquet(f"{folder}/manifest").collect()]
    found = [ids for shard in shards for ids in shard.document(101)]
    assert [ids.tolist() for ids in found] == [[*want("a short text!"), 0]]
    with open(f"{folder}/dictionary.zstd", "ab") as file:
        file.write(b"x")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(folder, 0)


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(empty(spark), f"{tmp_path}/none", BYTE)
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_dictionary_takes_one_row_of_each_id(spark, monkeypatch):
    taken = []
    encode = token_files.Encoder.encode

    def count(self, texts):
        taken.extend(texts)
        return encode(self, texts)

    monkeypatch.setattr(token_files.Encoder, "encode", count)
    rows = [(7, f"text {k} of one id") for k in range(100, 500)] + [(k, f"other {k}") for k in range(20, 60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.train_dictionary(documents, BYTE)
    assert len(taken) == 41 and "text 100 of one id" in taken


def test_dictionary_from_long_texts_only(spark):
    rnd = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    documents = spark.createDataFrame(
        [(k, " ".join(rnd.choices(words, k=3000))) for k in range(60)], "doc_id long, text string"
    )
    texts = token_files._sample(documents)
    assert len(texts) == 60 and {len(t) for t in texts} == {token_files.SAMPLE_CHARS}
    assert len({t[:20] for t in texts}) == 60
    made = token_files.train_dictionary(documents, BYTE)
    assert len(made) > 1000 and made[:4] == b"\x37\xa4\x30\xec"  # a zstandard dictionary


def test_dictionary_of_few_ids_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_DOCUMENTS", 1)
    documents = spark.range(3000).selectExpr("id % 2 as doc_id", "'some text' as text")
    assert token_files._sample(documents) == ["some text"]


def test_encoder_keeps_little(monkeypatch):
    """However many words there are, a worker keeps the ids of few and encodes few at once."""
    rnd, longest = random.Random(7), []
    own = tokens.Encoder(WORD, "bare")
    ids_of = own._ids
    monkeypatch.setattr(own, "_ids", lambda texts: longest.append(sum(map(len, texts))) or ids_of(texts))
    for _ in range(12):
        own.encode([" ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(4000)) for _ in range(8)])
        assert len(own.known) <= 250_000
    assert max(longest) < 350_000
