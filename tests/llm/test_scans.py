import random
import re

from pyspark.sql import functions as F

from tests.llm.cases import awkward, empty
from termsift.llm import fixity, licenses

TEXTS = [
    "Under the MIT license. under-the mit LICENSE, under the mit licence",
    "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0 (CC-BY-NC)",
    "released under the GNU General Public License, version 3; all rights reserved",
    "given out by the GNU General Public License version 3",
    "general public license version", "mit license the under", "cc by nc",
    "license " * 3000 + "apache license version 2",
]


def brute(text, phrases):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = []
    for label, own in phrases:
        places += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    return len(words), places


def test_base_places_against_brute_force(spark):
    docs = awkward(spark, TEXTS)
    phrases = [(t.label, t.words) for t in licenses.TEMPLATES if t.base]
    texts = dict(docs.select("doc_id", "text").collect())
    rows = licenses.find_licenses(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        n, places = brute(texts[row.doc_id], phrases)
        starts = [k for k, _ in places]
        assert (row.n_words, row.n_base) == (n, len(places))
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score == 1 or not places)
    found = {row.doc_id: row.labels for row in rows}
    assert found[102] == "all-rights-reserved,gpl-3" and found[103] == "gpl-3"
    assert found[104] == found[105] == "" and licenses.find_licenses(empty(spark)).count() == 0


def test_a_place_may_miss_any_word_outside_the_key_phrase(spark):
    filler = [f"plain text number {k} of the sea" for k in range(20)]
    docs = [
        "under the new general public license version 3", "under the creative commons attribution license",
        "subject to a term of the mozilla public license v 2 0", "redistribution and use in source and any forms",
        "under the gnu general public licence version 3", "all right reserved",
    ]
    rows = [(k, t) for k, t in enumerate(docs + filler)]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = {r.doc_id: r.labels for r in found.collect()}
    assert [labels[k] for k in range(6)] == ["gpl-3", "cc-by", "mpl-2", "bsd", "", ""]
    # the words of highest inverse document frequency are looked up, and no common ones
    weights = licenses.word_weights(spark.createDataFrame(rows, "doc_id long, text string"))
    for t in licenses.TEMPLATES:
        postings = licenses.postings_of(t, weights)
        rest = [weights[w] for k, w in enumerate(t.words) if k not in postings.at]
        assert min(weights[t.words[k]] for k in postings.at) >= max(rest, default=0)
        assert sum(weights[t.words[k]] for k in postings.at) > postings.slack


def test_places_against_brute_force(spark):
    rnd, words = random.Random(3), sorted({w for t in licenses.TEMPLATES for w in t.words})
    texts = [" ".join(rnd.choices(words, k=40)) for _ in range(30)]
    for t in licenses.TEMPLATES * 6:
        own = [w if rnd.random() < 0.85 else "x" for w in t.words]
        texts.append(" ".join([*rnd.choices(words, k=3), *own, *rnd.choices(words, k=3)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = licenses.word_weights(docs)
    wanted = set()
    for k, text in enumerate(texts):
        own = text.split()
        for t in licenses.TEMPLATES:
            for start in range(-len(t.words), len(own)):
                same = [0 <= start + i < len(own) and own[start + i] == w for i, w in enumerate(t.words)]
                share = sum(weights[w] for w, s in zip(t.words, same) if s) / sum(weights[w] for w in t.words)
                if all(same[t.key_from : t.key_to]) and (all(same) if t.base else share >= licenses.MIN_SHARE):
                    wanted.add((k, t.label, start))
    found = licenses.find_licenses(docs).select("doc_id", F.explode("places").alias("p")).collect()
    assert {(r.doc_id, r.p.label, r.p.start) for r in found} == wanted and len(wanted) > 15


def test_no_python_in_the_plan(spark, capsys):
    licenses.find_licenses(awkward(spark, TEXTS)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def sides(spark):
    pages = [(k, f"http://h/{k}", f"<p>page {k}</p>") for k in range(-40, 2100, 3)]
    pages += [(None, "u", "h"), (None, None, None), (6, "http://again", "x"), (6, "http://h/6", None)]
    return spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, n string")


def replica(spark, files):
    """Files as lists of (id, content) or of a number of bytes that belong to no record."""
    rows = []
    for number, own in files.items():
        at = 0
        for entry in own:
            if isinstance(entry, int):
                at += entry
                continue
            rows.append((number, at, entry[0], entry[1].encode()))
            at += len(entry[1])
    return spark.createDataFrame(rows, "file long, offset long, id long, record binary")


def files_of(seed=0, per_file=120):
    rnd = random.Random(seed)
    return {
        f: [(1000 * f + k, f"record {f} {k} " + "x" * rnd.randint(0, 3000)) for k in range(per_file)]
        for f in (-3, 0, 1, 2, 40)
    }


def found(spark, a, b):
    return {(r.id, r.kind) for r in fixity.audit(replica(spark, a), replica(spark, b)).collect()}


def test_every_kind_of_damage_is_located(spark):
    a, b = files_of(), files_of()
    assert found(spark, a, b) == set()
    b[0][10], b[0][11] = b[0][11], b[0][10]  # swapped
    b[1][5] = (1005, b[1][5][1][:-7])  # truncated
    b[1][50] = (1050, "?" + b[1][50][1][1:])  # another byte
    del b[2][20]  # lost
    b[2].insert(60, (2999, "added"))
    b[40].append(b[-3].pop(30))  # into another file
    b[40].insert(70, 512)  # bytes of no record
    swapped = {(k, "moved") for k in (10, 11, 12)}
    # of a record that went to another file, the one behind it follows another one, too
    assert found(spark, a, b) == swapped | {
        (1005, "changed"), (1050, "changed"), (2020, "missing"), (2999, "extra"),
        (-2970, "moved"), (-2969, "moved"), (40070, "shifted"),
    }
    rows = {r.id: r for r in fixity.audit(replica(spark, a), replica(spark, b)).collect()}
    assert rows[1005].bytes_b == rows[1005].bytes_a - 7 and rows[1005].offset_a == rows[1005].offset_b
    assert (rows[-2970].file_a, rows[-2970].file_b) == (-3, 40)


def test_records_that_moved_together(spark):
    a, b = files_of(1), files_of(1)
    b[0][40:40] = [b[0].pop(3) for _ in range(5)]  # records 3 to 7 behind record 44
    assert found(spark, a, b) == {(3, "moved"), (8, "moved"), (45, "moved")}


def test_an_added_record_is_not_held_against_those_behind_it(spark):
    a, b = files_of(2), files_of(2)
    b[0].insert(0, (999, "first"))
    assert found(spark, a, b) == {(999, "extra")}
    del a[0][100]
    assert found(spark, a, b) == {(999, "extra"), (100, "extra")}


def test_only_ranges_that_differ_are_left(spark):
    a, b = files_of(3, 400), files_of(3, 400)
    b[1][200] = (1200, "!" + b[1][200][1][1:])
    sides_ = [fixity.digests(replica(spark, x)) for x in (a, b)]
    bad = fixity.differing_ranges(*sides_).collect()
    at = sum(len(text) for _, text in a[1][:200])
    assert [(r.file, r.part) for r in bad] == [(1, at >> fixity.RANGE_BITS)]
    leaf = fixity.ranges(sides_[0])
    levels = fixity.tree(leaf, fixity.steps([leaf]))
    sizes = [level.count() for level in levels]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 30 and sizes[-1] <= 2


def test_pages_against_a_copy(spark):
    a = fixity.place_records(fixity.warc_records(sides(spark)))
    assert fixity.audit(a, a.orderBy(F.rand())).count() == 0
    none = a.where("false")
    assert fixity.audit(none, none).count() == 0
    for pair, kind in (((a, none), "missing"), ((none, a), "extra")):
        rows = fixity.audit(*pair).collect()
        assert {r.kind for r in rows} == {kind} and len(rows) == sides(spark).count()
        assert sum(r.id is None for r in rows) == 2
    other = sides(spark).where("page_id is null or page_id % 97 != 5").withColumn(
        "html", F.when(F.col("page_id").isin(5, 6, 2000) | F.col("page_id").isNull(), "y").otherwise(F.col("html"))
    )
    b = fixity.place_records(fixity.warc_records(other))
    rows = [(r.id, r.kind) for r in fixity.audit(a, b).collect()]
    ids = [*range(-40, 2100, 3), 6, 6]
    lost = [k for k in ids if k % 97 == 5]
    changed = [k for k in ids if k in (5, 6, 2000) and k not in lost] + [None, None]
    wanted = [(k, "missing") for k in lost] + [(k, "changed") for k in changed]
    assert sorted(rows, key=str) == sorted(wanted, key=str)


def test_record_is_a_warc_record(spark):
    record = fixity.warc_records(sides(spark).where("page_id = 2")).first().record
    head, body = bytes(record).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.0\r\n") and body == b"<p>page 2</p>\r\n\r\n"
    assert f"Content-Length: {len(body) - 4}".encode() in head
