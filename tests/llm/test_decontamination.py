import random
import re

import pytest

from tests.llm.cases import awkward, empty, prose
from termsift.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(folded)


def brute(doc, items, window):
    hit, found = [False] * len(doc), set()
    for item, own in items:
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == own[k : k + size]:
                    found.add(item)
                    hit[at : at + size] = [True] * size
    return hit, found


@pytest.mark.parametrize("seed", range(60))
def test_automaton_against_brute_force(seed):
    rnd = random.Random(seed)
    window = rnd.choice([2, 3, 5])
    letters = [b"a", b"b", b"c", b"d"][: rnd.choice([2, 3, 4])]
    items = [(k, rnd.choices(letters, k=rnd.randint(0, 9))) for k in range(rnd.randint(0, 5))]
    automaton = D.SuffixAutomaton(window)
    for item, own in items:
        automaton.add(item, own)
    automaton.finish()
    doc = rnd.choices([*letters, b"other"], k=rnd.randint(0, 40))
    hit, found = automaton.hits(doc)
    assert (hit.tolist(), found) == brute(doc, items, window)


def tables(spark):
    rnd = random.Random(4)
    items = [(k, prose(rnd, n)) for k, n in enumerate([30, 12, 10, 4, 1, 30])] + [(6, ""), (7, None)]
    items[5] = (5, items[0][1])
    clean = prose(rnd, 200, tag="c")
    leak = f"{clean} {items[0][1].upper()}! {clean}"
    part = f"{clean} {' '.join(items[1][1].split()[:9])} {clean}"
    short = f"{clean}, {items[3][1]}; {clean}"
    docs = awkward(spark, [clean, leak, part, short, items[0][1], items[4][1]])
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


def test_spans_against_brute_force(spark, monkeypatch):
    docs, benchmark, items = tables(spark)
    known = [(item, words(text)) for item, text in items]
    texts = dict(docs.where("doc_id is not null").select("doc_id", "text").collect())
    for block in (D.BLOCK_WORDS, 15):
        blocks = D.automata
        monkeypatch.setattr(D, "automata", lambda b, w, block=block, f=blocks: f(b, w, block))
        rows = [r for r in D.find_spans(docs, benchmark).collect() if r.doc_id is not None]
        monkeypatch.undo()
        assert len(rows) == docs.count() - 1
        for row in rows:
            hit, found = brute(words(texts[row.doc_id]), known, D.WINDOW) if row.doc_id != 4 else (None, set())
            assert row["items"] == sorted(map(str, found))
            assert row.contaminated == bool(found)
            if hit is not None:
                assert (row.n_words, row.n_hit) == (len(hit), sum(hit))
                assert sum(b - a for a, b in row.spans) == sum(hit)


def test_spans_go_and_clean_texts_stay(spark):
    docs, benchmark, _ = tables(spark)
    out = D.remove_spans(docs, benchmark)
    assert out.schema == docs.schema
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    after = out.collect()
    assert D.find_spans(out, benchmark).where("contaminated").count() == 0
    ids = [r.doc_id for r in after]
    assert 104 not in ids and 105 not in ids and ids.count(5) == 2 and 101 in ids
    for row in after:
        if row.doc_id not in (101, 103):
            assert before[row.doc_id, row.text] == row
        else:
            assert row.n_chars == len(row.text) and row.text.startswith(before_text(before, row.doc_id)[:100])


def before_text(before, doc):
    return next(text for (d, text) in before if d == doc)


def test_empty_tables(spark):
    docs, benchmark, _ = tables(spark)
    none = benchmark.where("false")
    assert D.remove_spans(docs, none).count() == docs.count()
    assert D.find_spans(empty(spark), benchmark).count() == 0
    assert D.find_spans(docs, none).where("contaminated or n_items > 0").count() == 0


def test_items_without_an_id_hit_but_are_not_named(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "else")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, text), (None, None)], "item_id long, text string")
    rows = {r.doc_id: r for r in D.find_spans(docs, items).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[1]["items"]) == (11, 1, ["7"]) and not rows[2].contaminated
    alone = D.find_spans(docs, items.where("item_id is null")).collect()
    assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in alone} == {(1, 11, 0, True), (2, 0, 0, False)}


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    """With any number of blocks, one at a time in the driver and in a worker."""
    rnd = random.Random(8)
    items = [(k, prose(rnd, rnd.choice([3, 12, 25]), 300, "b")) for k in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = []
    for _ in range(40):
        parts = [prose(rnd, rnd.randint(5, 60), 300, "c")]
        for _, text in rnd.sample(items, rnd.randint(0, 3)):
            parts += [text, prose(rnd, rnd.randint(0, 40), 300, "c")]
        texts.append(" ".join(parts))
    nested = items[1][1].split()
    texts.append(prose(rnd, 60, 300, "c") + " " + " ".join([*nested[:2], items[0][1], *nested[2:]]))
    docs = awkward(spark, texts + texts[:3])
    one = [D.find_spans(docs, benchmark).collect(), D.remove_spans(docs, benchmark).collect()]
    monkeypatch.setattr(D, "automata", lambda b, w=D.WINDOW, f=D.automata: f(b, w, 150))
    assert len(D.automata(benchmark)) >= 5
    many = D.find_spans(docs, benchmark), D.remove_spans(docs, benchmark)
    assert many[1].schema == docs.schema
    for a, b in zip(one, many, strict=True):
        assert sorted(map(str, a)) == sorted(map(str, b.collect()))
    assert any(r.contaminated for r in one[0])
