import random
import re
from collections import Counter

import pytest

from tests.llm.cases import awkward, empty
from termsift.llm import collocations as c
from termsift.llm.transducers import Transducer, union


def brute(rows, least, top=c.TOP, covered=c.COVERED):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        inside = any(
            len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v)))
            for (other, v), b in f.items() if other == lang and b >= least
        )
        if not inside:
            cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, k = min((1000 * a * n[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            out.append((lang, " ".join(w), a, *cuts[k], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def result(table):
    rows = table.collect()
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def texts(seed, n=120):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        words = [rnd.choice("aa bb CC dd é ü z\x01 -x".split() + ["w%d" % rnd.randint(0, 40)]) for _ in range(30)]
        gaps = [rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in words]
        out.append((rnd.choice(["en", "de", "de", None, "und"]), "".join(w + g for w, g in zip(words, gaps))))
    return out + [("en", "ha ha ha ha ha ha"), ("en", "new york city hall " * 9), ("fr", "only here")]


@pytest.mark.parametrize("least, top", [(3, 2000), (2, 5), (6, 2000)])
def test_against_brute_force(spark, least, top):
    rows = texts(least)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert result(c.collocations(docs, least=least, top=top)) == brute(rows, least, top)


def test_many_shards_and_ranges(spark, monkeypatch):
    rows = texts(9, 60)
    monkeypatch.setattr(c, "RANGE_ENTRIES", 40)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    sizes = c.sieve_sizes(1000)
    sieves, counted = {}, None
    for lengths in ((1,), (2,), (3, 4, 5)):
        counted = c.count_hashes(docs.fillna("und", ["lang"]), lengths, sieves, sizes)
        sieves = sieves | dict.fromkeys(lengths, c.frequent(counted, sizes, 3)[0])
    bounds = c.range_bounds(docs.fillna("und", ["lang"]), sieves, 20, len(rows))
    assert len(bounds) > 10 and bounds == sorted(bounds)
    counts = c.range_counts(docs.fillna("und", ["lang"]), sieves, bounds, 3).collect()
    assert len({r.range for r in counts}) > 8
    assert all(
        (r.range == 0 or bounds[r.range - 1] <= (r.lang.encode(), w))
        and (r.range == len(bounds) or (r.lang.encode(), w) < bounds[r.range])
        for r in counts for w, _ in Transducer.load(r.counts).paths()
    )
    assert result(c.collocations(docs, least=3)) == brute(rows, 3)


def test_tasks_that_write_out_early_lose_nothing(monkeypatch):
    import pyarrow as pa

    sizes = c.sieve_sizes(100)
    monkeypatch.setattr(c, "HELD_HASHES", 10)
    made = c._summed([c.Run([b"a b c d e f g h i j k l m n o p " * 2], "en").hashes[1]], [c.np.ones(32, int)])
    assert len(made[0]) == 16 and set(made[1].tolist()) == {2}
    run = c.Run([b"A b, c", b"d", b""], "en")
    assert [run.words(k, 1) for k in range(run.n)] == [(b"a",), (b"b",), (b"c",), (b"d",)]
    assert run.whole(2).tolist() == [True, False, False] and sizes.bits > sizes.part_bits
    assert pa.__version__


def test_awkward_rows(spark):
    docs = awkward(spark, ["tea time tea time tea time", "TEA TIME! tea\ttime"] * 3)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert result(c.collocations(docs, least=5)) == brute(rows, 5)
    assert c.collocations(empty(spark), least=1).collect() == []


def test_transducers():
    rnd = random.Random(4)
    sets = []
    for _ in range(5):
        own = Counter()
        for _ in range(300):
            own[tuple(rnd.choice([b"a", b"b", b"c", b"dd", b"\xc3\xa9"]) for _ in range(rnd.randint(1, 5)))] += rnd.randint(1, 9)
        sets.append(own)
    made = [Transducer.load(Transducer.build(sorted(own.items())).dump()) for own in sets]
    assert [list(t.paths()) for t in made] == [sorted(own.items()) for own in sets]
    total = sum(sets, Counter())
    assert list(union(made, 20).paths()) == sorted((w, n) for w, n in total.items() if n >= 20)
    wanted = sorted({*rnd.sample(sorted(total), 50), (b"zz",), (b"a", b"zz")})
    found = Transducer.build((w, 0) for w in wanted).compose(union(made))
    assert list(found) == [(w, total[w]) for w in wanted if w in total]
    # equal endings are one state
    long = Transducer.build(sorted((((b"%d" % k), b"x", b"y", b"z"), 7) for k in range(50)))
    assert len(long.states) == 5
    assert list(Transducer.load(Transducer.build([]).dump()).paths()) == []


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    made = Transducer.build([((b"x",), big), ((b"x", b"y"), big - 1), ((b"y",), big + 7)])
    counts = spark.createDataFrame([(0, "en", made.dump())], "range int, lang string, counts binary")
    phrases = spark.createDataFrame([("en", "x y", big - 1)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    (row,) = c.scored(phrases, totals, counts, []).collect()
    assert row.score == 1000 * (big - 1) * 9 * 10**15 // (big * (big + 7)) and (row.l, row.r) == (big, big + 7)


def test_sieves_let_all_frequent_hashes_through(spark):
    docs = spark.createDataFrame([("en", f"common word number {k} " * 3) for k in range(50)], "lang string, text string")
    sizes = c.Sizes(bits=20, part_bits=4)
    counted = c.count_hashes(docs, (1,), {}, sizes)
    sieve, n = c.frequent(counted, sizes, 100)
    run = c.Run([b"common word number"], "en")
    assert n == 3 and sieve(run.hashes[1]).all()
    others = c.Run([b" ".join(b"%d" % k for k in range(50))], "en")
    assert sieve(others.hashes[1]).sum() == 0
    assert dict(counted.where("part < 0").groupBy("lang").sum("words").collect()) == {"en": 600}
