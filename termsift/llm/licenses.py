"""License scan by a positional rare-token index, in DataFrame expressions only.

A template is a run of licence words with a mandatory key phrase. The document frequencies of all
template words, counted over the whole table, give their inverse document frequency (IDF). The
index has postings of (template, position) for the words of highest IDF of every template: so many
that a place without any of them misses more of the template's IDF than ``MIN_SHARE`` allows. No
place is lost by looking up these words alone, and common words are never looked up.

A document is looked up by those words that it holds. Each occurrence is a vote for the start of
a template, and votes are intersected by their relative position: a start goes on if the words
that voted for it leave out no more than may be missing. There the key phrase must be in full, and
the words in place must hold ``MIN_SHARE`` of the IDF. Base phrases are templates of which nothing
may be missing.

Everything happens inside a document's row: two scans of the texts and no shuffle but the one for
the counts, which has a row per template word. Nothing depends on how often a word or a document
is repeated, and a very long text is one long row of words.

Nulls, ties, repeats: a null text is empty, has no words and no places; rows with the same doc_id
are scanned each for itself; of equally rare words the first in the template are looked up first;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    label: str
    words: list[str]
    key_from: int
    key_to: int
    base: bool


def _template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, part = text.split(), key.split()
    at = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
    return Template(label, words, at, at + len(part), base)


# Base phrases with their labels, then licence lines with their key phrases.
TEMPLATES = [
    _template("mit", "under the mit license", "under the mit license", True),
    _template("apache-2", "apache license version 2", "apache license version 2", True),
    _template("cc-by-nc", "cc by nc", "cc by nc", True),
    _template("gpl-3", "under the gnu general public license version 3", "general public license version 3"),
    _template("gpl-2", "under the gnu general public license version 2", "general public license version 2"),
    _template("lgpl", "under the gnu lesser general public license", "lesser general public license"),
    _template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source"),
    _template("cc-by", "under a creative commons attribution license", "creative commons attribution"),
    _template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

#: Share of a template's inverse document frequency that must stand in place.
MIN_SHARE = 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_words(text: Column) -> Column:
    """Words of a whole text, in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _GAPS), "")


def word_weights(documents: DataFrame, templates: list[Template] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template word, over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(text_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    # the empty word counts the documents
    counts = documents.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word"))
    found = {row["word"]: row["count"] for row in counts.groupBy("word").count().collect()}
    total = found.get("", 0) + 1
    return {w: math.log(total / (found.get(w, 0) + 1)) for w in vocabulary}


class Postings(NamedTuple):
    """Of one template: the positions that are looked up, and what of their IDF may be missing."""

    at: list[int]
    slack: float


def postings_of(template: Template, weights: dict[str, float]) -> Postings:
    """The fewest words, of the highest IDF, that cannot all be missing where the template stands."""
    own = [weights[w] for w in template.words]
    missing = 0.0 if template.base else (1 - MIN_SHARE) * sum(own)
    at: list[int] = []
    for k in sorted(range(len(own)), key=lambda k: (-own[k], k)):
        at.append(k)
        if sum(own[i] for i in at) > missing + 1e-9:
            break
    return Postings(at, missing)


def _looked_up(words: Column, vocabulary: list[str]) -> Column:
    """Array of (at, word) of the words that have postings."""
    marked = F.transform(
        words, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word")))
    )
    return F.array_compact(marked)


def _places(words: Column, hits: Column, template: Template, weights: dict[str, float]) -> Column:
    """Array of (start, share) where the template stands."""
    size = len(template.words)
    own = [weights[w] for w in template.words]
    total = sum(own)
    postings = postings_of(template, weights)
    enough = sum(own[k] for k in postings.at) - postings.slack - 1e-9

    def at(start: Column, k: int) -> Column:
        return F.coalesce(F.get(words, start + k) == template.words[k], F.lit(False))

    def key_holds(start: Column) -> Column:
        holds = F.lit(True)
        for k in range(template.key_from, template.key_to):
            holds = holds & at(start, k)
        return holds

    def share(start: Column) -> Column:
        if template.base or total <= 0:
            return F.lit(1.0)
        parts = [F.when(at(start, k), own[k]).otherwise(0.0) for k in range(size)]
        return sum(parts[1:], parts[0]) / total

    voters = [template.words[k] for k in postings.at]
    vote = lambda hit, k: F.when(
        hit["word"] == template.words[k], F.struct((hit["at"] - k).alias("start"), F.lit(own[k]).alias("idf"))
    )
    votes = F.array_compact(
        F.flatten(F.transform(hits, lambda hit: F.array(*[vote(hit, k) for k in postings.at])))
    )
    if len(postings.at) > 1:
        # intersect the postings: the votes for one start are summed up
        starts = F.array_distinct(F.transform(votes, lambda v: v["start"]))
        agreed = lambda s: F.aggregate(
            F.filter(votes, lambda v: v["start"] == s), F.lit(0.0), lambda sum_, v: sum_ + v["idf"]
        )
        starts = F.filter(starts, lambda s: agreed(s) >= enough)
    else:
        starts = F.transform(votes, lambda v: v["start"])
    entries = F.filter(starts, lambda start: (start >= -template.key_from) & key_holds(start))
    found = F.transform(
        entries, lambda s: F.struct(s.cast("long").alias("start"), share(s).alias("share"))
    )
    found = F.filter(found, lambda p: p["share"] >= MIN_SHARE)
    none = F.array().cast("array<struct<start:bigint,share:double>>")
    return F.when(F.exists(hits, lambda hit: hit["word"].isin(voters)), found).otherwise(none)


def find_licenses(documents: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per document: words, places of base phrases, labels and the best score.

    ``places`` holds (label, start, share) of every template found.
    """
    weights = word_weights(documents, templates)
    vocabulary = sorted({t.words[k] for t in templates for k in postings_of(t, weights).at})
    words = documents.select("doc_id", text_words(F.col("text")).alias("words"))
    words = words.select("*", _looked_up(F.col("words"), vocabulary).alias("hits"))
    held = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *[
            _places(F.col("words"), F.col("hits"), t, weights).alias(f"t{k}")
            for k, t in enumerate(templates)
        ],
    )
    base = [k for k, t in enumerate(templates) if t.base]
    starts = lambda k: F.transform(f"t{k}", lambda p: p["start"])
    labels = lambda ks: F.array_compact(
        F.array(*[F.when(F.size(f"t{k}") > 0, templates[k].label) for k in ks])
    )
    joined = lambda ks: F.array_join(F.array_sort(F.array_distinct(labels(ks))), ",")
    every = range(len(templates))
    best = F.greatest(
        F.lit(0.0),
        *[F.coalesce(F.array_max(F.transform(f"t{k}", lambda p: p["share"])), F.lit(0.0)) for k in every],
    )

    def named(k: int) -> Column:
        label = F.lit(templates[k].label).alias("label")
        return F.transform(f"t{k}", lambda p: F.struct(label, p["start"], p["share"]))

    all_base = F.concat(*[starts(k) for k in base])
    return held.select(
        "doc_id",
        "n_words",
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).alias("first_word"),
        F.array_max(all_base).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(every).alias("labels"),
        F.round(best, 6).alias("score"),
        F.concat(*map(named, every)).alias("places"),
    )


def oracle(templates: list[Template] = TEMPLATES) -> str:
    """The same in SQL, by one row per word."""
    rows = ", ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {t.key_to - t.key_from}, {i}, '{w}',"
        f" {str(t.key_from <= i < t.key_to).lower()})"
        for k, t in enumerate(templates) for i, w in enumerate(t.words)
    )
    return f"""WITH template AS (SELECT * FROM (VALUES {rows})
  AS v(t, label, base, size, key_size, i, word, is_key)),
held AS (SELECT doc_id, [w for w in regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
    if w <> ''] AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM held),
hit AS (SELECT * FROM word WHERE word IN (SELECT word FROM template)),
weight AS (SELECT word, ln((SELECT count(*) + 1 FROM documents) / (coalesce(df, 0) + 1)::DOUBLE) AS idf
  FROM (SELECT DISTINCT word FROM template)
  LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM hit GROUP BY word) USING (word)),
weighted AS (SELECT *, sum(idf) OVER (PARTITION BY t) AS total FROM template JOIN weight USING (word)),
place AS (SELECT doc_id, t, any_value(label) AS label, any_value(base) AS base, pos - i AS start,
    CASE WHEN any_value(base) OR any_value(total) <= 0 THEN 1.0 ELSE sum(idf) / any_value(total) END AS share
  FROM hit JOIN weighted USING (word) GROUP BY doc_id, t, pos - i
  HAVING count(*) FILTER (is_key) = any_value(key_size)),
found AS (SELECT * FROM place WHERE share >= {MIN_SHARE})
SELECT doc_id, len(words)::BIGINT AS n_words, count(start) FILTER (base)::BIGINT AS n_base,
  min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  round(coalesce(max(share), 0.0), 6)::DOUBLE AS score
FROM held LEFT JOIN found USING (doc_id) GROUP BY doc_id, words"""
