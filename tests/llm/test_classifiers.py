import random
import zlib

import numpy as np
import pytest

from tests.llm.cases import awkward, empty, prose
from termsift.llm import language, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with rude words for toxic, shouting for low quality; and labels with awkward rows."""
    rnd = random.Random(6)
    docs, labels = [], []
    for k in range(500):
        words = prose(rnd, rnd.randint(5, 250)).split()
        toxic, low = int(k % 4 == 0), int(k % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["rudest", "vilest", "foulest"]) + rnd.choice("abc")
        text = " ".join(words)
        text = " ".join(f"{w.upper()}!!" for w in words) if low else text
        docs.append((k, text, "en", 0.5))
        labels.append((k, 1 - low, toxic))
    labels += [(None, 1, 1), (9000, 0, 1), (3, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, toxicity double"),
        spark.createDataFrame(labels, LABELS),
    )


def accuracy(rows, held_out, label, wanted):
    own = [(r["s"] >= 0.5) == bool(label(r.doc_id)) for r in rows if held_out(r.doc_id) == wanted]
    return sum(own) / len(own)


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    rows = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels), "s").collect()
    held_out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    assert len(rows) == 500 and rows[0].toxicity == 0.5
    assert accuracy(rows, held_out, lambda d: d % 4 == 0, True) >= 0.95


def test_long_labelled_documents_teach(spark):
    """Every text has more windows than the sample takes, and the rude words are in one of them."""
    rnd = random.Random(8)
    docs = []
    for k in range(240):
        words = prose(rnd, rnd.randint(2000, 4000)).split()
        at = rnd.randrange(len(words) - 10)
        if k % 3 == 0:
            words[at : at + 3] = [rnd.choice(["rudest", "vilest", "foulest"]) for _ in range(3)]
        docs.append((k, " ".join(words)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 3 = 0 as int) as toxic")
    examples = toxicity.sample(docs, labels)
    assert len(examples) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(240))
    for pieces, label in examples:
        rows, _ = toxicity.window_rows([np.array(p.split()) == b"" for p in pieces])
        assert len(rows) <= toxicity.SAMPLE_WINDOWS
        assert any(w in p for p in pieces for w in (b"rudest", b"vilest", b"foulest")) == bool(label)
    rows = toxicity.with_toxicity(docs, toxicity.train(examples), "s").collect()
    held_out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    assert accuracy(rows, held_out, lambda d: d % 3 == 0, True) >= 0.95


def test_one_row_of_each_id_teaches(spark):
    rows = [(1, f"text {k}") for k in range(300)] + [(k, f"other {k}") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic").distinct()
    examples = toxicity.sample(docs, labels)
    assert len(examples) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 30))
    assert ([b"text 0"], 1) in examples


def test_chosen_windows_are_windows_of_the_text():
    words = [b"%d" % k for k in range(5000)]
    odds = np.zeros(toxicity.BUCKETS)
    odds[toxicity._buckets([b"4321"])] = 1
    pieces = [p.split() for p in toxicity.choose_windows(words, odds)]
    starts = {int(p[at]) for p in pieces for at in toxicity.windows_of(len(p))}
    assert starts <= set(toxicity.windows_of(5000)) and len(starts) == toxicity.SAMPLE_WINDOWS
    assert any(b"4321" in p for p in pieces) and pieces[0][0] == b"0" and pieces[-1][-1] == b"4999"
    assert toxicity.choose_windows(words[:900], odds) == [b" ".join(words[:900])]
    assert toxicity._words("x" * 150 + " y") == [b"x" * 64, b"x" * 64, b"x" * 22, b"y"]


def test_quality_held_out(spark, labelled):
    docs, labels = labelled
    rows = quality.with_quality(docs, quality.fit_quality(docs, labels), "s").collect()
    held_out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    assert accuracy(rows, held_out, lambda d: d % 5 != 0, True) >= 0.97


def test_held_out_labels_teach_nothing(spark, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr(
        "doc_id",
        "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality",
        "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic",
    )
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, flipped)
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
    assert toxicity.sample(docs, labels) == toxicity.sample(docs, flipped)


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_both_labels_the_score_is_constant(spark, rows):
    docs, labels = awkward(spark), spark.createDataFrame(rows, LABELS)
    for scored in (
        toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels), "s"),
        quality.with_quality(docs, quality.fit_quality(docs, labels), "s"),
    ):
        found = scored.collect()
        assert len(found) == docs.count() and len({r.s for r in found}) == 1
        assert 0 <= found[0].s <= 1 and scored.columns[:-1] == docs.columns


def test_awkward_texts_get_scores(spark, labelled):
    docs, labels = labelled
    for fit, score in (
        (toxicity.fit_toxicity, toxicity.with_toxicity), (quality.fit_quality, quality.with_quality)
    ):
        model = fit(docs, labels)
        rows = score(awkward(spark), model, "s").collect()
        assert len(rows) == awkward(spark).count() and all(0 <= r.s <= 1 for r in rows)
        assert len({r.s for r in rows if r.doc_id == 5}) == 1
        assert score(empty(spark), model, "s").count() == 0


def test_gradient_against_differences():
    net = toxicity.Network([b"aa", b"bbb"])
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    words = [b"aa", b"bbb", b"ccx"]
    ids = np.array([[0, 1, 2, -1], [2, -1, -1, -1], [-1, -1, -1, -1], [1, 1, 0, 2]])
    target = np.array([1, 0, 1, 0.0])

    def loss():
        x, mask, p = net.inputs(words).astype(float), (ids.T >= 0)[:, :, None], net.p
        seen = x[np.where(ids.T >= 0, ids.T, 0)]
        s = net.scores(seen @ p["Wf"] + p["cf"], seen @ p["Wb"] + p["cb"], mask)
        return -(target * np.log(s) + (1 - target) * np.log(1 - s)).mean()

    grad = net.gradient(ids, net.inputs(words), words, target)
    for name, value in net.p.items():
        flat, own = value.reshape(-1), grad[name].reshape(-1)
        at = int(np.argmax(np.abs(own)))
        before = flat[at]
        flat[at] = before + 1e-2
        high = loss()
        flat[at] = before - 1e-2
        slope = (high - loss()) / 2e-2
        flat[at] = before
        assert abs(slope - own[at]) < 2e-3


def test_windows_cover_every_word_and_overlap():
    for n in [0, 1, 47, 48, 49, 84, 85, 500]:
        rows, owner = toxicity.window_rows([np.arange(n)])
        assert set(rows.ravel()) - {-1} == set(range(n)) and (owner == 0).all()
        starts = rows[:, 0].tolist()
        assert starts[1:] == [s + toxicity.STRIDE for s in starts[:-1]]


def test_discriminant_against_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(400, quality._STATISTICS)), rng.normal(1, 2, size=(300, quality._STATISTICS))]
    model = quality.discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in enumerate(x)})
    point = rng.normal(size=(5, quality._STATISTICS))
    log = []
    for k in (0, 1):
        cov = model.factor[k] @ model.factor[k].T
        d = point - model.mean[k]
        log.append(model.log_prior[k] - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])))


TEXTS = {
    "aa": "the cat and the dog are in the house with that thing", "bb": "der hund und die katze sind nicht im haus",
}


@pytest.fixture(scope="module")
def spoken(spark):
    rnd = random.Random(7)
    rows = [
        (k, " ".join(rnd.choices(TEXTS[lang].split(), k=rnd.randint(3, 60))), lang, None)
        for k in range(200) for lang in [rnd.choice(list(TEXTS))]
    ]
    rows += [(1000, TEXTS["aa"], None, None), (None, TEXTS["aa"], "bb", None), (1001, None, "aa", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_against_brute_force(spark, spoken):
    known = language.fit_languages(spoken)
    assert known.languages == ["aa", "bb"]
    rows = language.with_language(spoken, known, "p", "s").collect()
    held_out = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.p == r.lang for r in held_out if r.lang and r.text) >= 0.97 * sum(1 for r in held_out if r.lang and r.text)
    # profiles and distances anew, by dictionaries
    ranks = {}
    train = [r for r in rows if r.doc_id is not None and r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    for lang in known.languages:
        total = sum(language.gram_counts(r.text) for r in train if r.lang == lang)
        order = sorted((g for g in np.flatnonzero(total)), key=lambda g: (-total[g], g))[: language.PROFILE]
        ranks[lang] = {int(g): k for k, g in enumerate(order)}
    for row in rows[:60]:
        counts = language.gram_counts(row.text)
        own = sorted((int(g) for g in np.flatnonzero(counts)), key=lambda g: (-counts[g], g))[: language.PROFILE]
        distance = {
            lang: sum(abs(of.get(g, language.PROFILE) - k) for k, g in enumerate(own)) for lang, of in ranks.items()
        }
        assert row.p == min(distance, key=lambda lang: (distance[lang], lang)) and 0 <= row.s <= 1


def test_gram_counts_do_not_depend_on_the_step(monkeypatch):
    text = "Ein Hund, ein Wörterbuch und 12 Katzen. " * 30
    whole = language.gram_counts(text)
    for step in (7, 64, 1001):
        monkeypatch.setattr(language, "_STEP", step)
        assert (language.gram_counts(text) == whole).all()
    letters = " ".join(language.regex.findall(r"[^\s.,0-9]+", text.lower()))
    raw = f" {letters} ".encode()
    for letter in b"ehx":
        assert whole[letter] == raw.count(bytes([letter]))
    assert whole[language._ONE + (ord("h") << 8) + ord("u")] == raw.count(b"hu")


def test_languages_of_awkward_texts(spark, spoken):
    known = language.fit_languages(spoken)
    rows = language.with_language(awkward(spark), known, "p", "s").collect()
    assert {r.doc_id for r in rows if r.p == "und"} == {1, 2, 3, 6}
    none = language.fit_languages(empty(spark))
    assert {r.p for r in language.with_language(awkward(spark), none, "p", "s").collect()} == {"und"}
    assert language.with_language(empty(spark), known, "p", "s").count() == 0


def test_scorer_against_plain_windows(monkeypatch):
    """Cached, sorted and batched windows have the scores of windows run one by one."""
    rnd, rng = random.Random(3), np.random.default_rng(3)
    network = toxicity.Network([f"w{k}".encode() for k in range(50)], 5)
    for name, values in network.p.items():
        network.p[name] = (values + rng.normal(0, 0.2, values.shape)).astype(np.float32)
    p = network.p

    def plain(text):
        words = toxicity._words(text)
        best = 0.0
        for start in toxicity.windows_of(len(words)):
            own = words[start : start + toxicity.WINDOW]
            x = network.inputs(own) if own else np.zeros((1, 2 * toxicity.DIM), np.float32)
            mask = np.full((len(x), 1, 1), bool(own))
            score = network.scores((x @ p["Wf"] + p["cf"])[:, None], (x @ p["Wb"] + p["cb"])[:, None], mask)
            best = max(best, float(score[0]))
        return best

    texts = [prose(rnd, n, 90) for n in (1, 5, 47, 48, 49, 84, 85, 300, 2000)] + ["", None, "!?", "ä" * 500]
    texts += [prose(rnd, rnd.randint(1, 200), 90) for _ in range(60)]
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 60)  # the cache starts anew on the way
    scorer = toxicity.Scorer(network)
    assert np.allclose(scorer(texts), [plain(t) for t in texts], atol=1e-5)
    assert np.allclose(scorer(texts[::-1]), [plain(t) for t in texts[::-1]], atol=1e-5)
    assert len({round(plain(t), 3) for t in texts}) > 20
