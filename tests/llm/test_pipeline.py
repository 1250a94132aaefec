"""The pipeline's stages and the registered queries, on a small folder of tables."""

import random
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.cases import prose
from termsift.llm import decontamination, ngram_join
from termsift.llm.queries import queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd, docs, labels = random.Random(9), [], []
    item = prose(rnd, 30, 5000, "b")
    for k in range(300):
        words = prose(rnd, rnd.randint(20, 120), 3000).split()
        toxic, low = k % 6 == 1, k % 7 == 2
        for at in rnd.sample(range(len(words)), 4) if toxic else ():
            words[at] = "vilest" + rnd.choice("xyz")
        text = " ".join(f"{w.upper()}!!" for w in words) if low else " ".join(words)
        docs.append((k, f"{text} {item} {text}" if k % 50 == 0 else text, "en", "s", 0))
        labels.append((k, int(not low), int(toxic)))
    docs += [(1000 + k, docs[k][1], "en", "s", 0) for k in range(0, 60, 5)]  # copies
    docs += [(2000, None, "en", "s", 0), (2001, "", None, "s", 0), (None, "no id at all", "en", None, 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {
        "documents": spark.createDataFrame(docs, schema).selectExpr(
            "doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars"
        ),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stages_take_their_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda table: {r.doc_id for r in table.select("doc_id").collect()}
    states = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert after.schema == docs.schema
        states.append(docs := after)
    given, mild, good, single, clean = map(ids, states)
    toxic = {k for k in range(300) if k % 6 == 1}
    low = {k for k in range(300) if k % 7 == 2}
    plain = set(range(300)) - toxic - low
    assert len(toxic & mild) <= 0.1 * len(toxic) and len(plain - mild) <= 0.02 * len(plain)
    assert len(low & good) <= 0.1 * len(low) and len(plain - good) <= 0.04 * len(plain)
    found = ngram_join.near_duplicates(states[2], 5, 80).collect()
    assert single == {r.component_id for r in found} and not single & set(range(1000, 1060))
    assert clean <= single and {None, 2000, 2001} <= clean
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.find_spans(states[4], benchmark).where("contaminated").count() == 0
    before = dict(states[3].select("doc_id", "text").collect())
    for doc, text in states[4].select("doc_id", "text").collect():
        assert text == before[doc] or doc % 50 == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, states[4], sf_dir)
    assert ids(packed) == clean and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_toxicity_without_both_labels_rejects_nothing(spark, sf_dir, tmp_path, toxic):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [] if toxic is None else [(k, 1, toxic) for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    after = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert after.schema == docs.schema and after.count() == docs.count()


def test_toxicity_with_long_labelled_texts_only(spark, tmp_path):
    rnd, docs = random.Random(10), []
    for k in range(120):
        words = prose(rnd, 1900).split()
        for at in rnd.sample(range(len(words)), 40) if k % 3 == 0 else ():
            words[at] = "vilest" + rnd.choice("xyz")
        docs.append((k, " ".join(words)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 3 = 0 as int) as toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    toxic = set(range(0, 120, 3))
    assert len(kept & toxic) <= 4 and len(kept - toxic) >= 76


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality", "deduplication", "decontamination", "packing",
    ]


def test_queries_are_registered():
    names = set(entry.queries())
    assert set(queries()) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14))


@pytest.mark.parametrize("name, parts, rest", [("op7_toxicity", 5, 0), ("op8_quality", 3, 1), ("op10_language", 3, 1)])
def test_held_out_rows(spark, sf_dir, name, parts, rest):
    rows = queries()[name](spark, sf_dir).collect()
    assert len(rows) == 315
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == rest)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op3_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
        ("op4_ngram_join", "doc_id n_shingles component_id"),
        ("op5_benchmark_decontamination", "doc_id n_words n_hit n_items items_sha256 contaminated"),
        ("op6_token_files", "doc_id start n_tokens ids_crc32"),
    ],
)
def test_contract_columns(spark, sf_dir, name, columns):
    out = queries()[name](spark, sf_dir)
    assert set(columns.split()) <= set(out.columns) and out.select("doc_id").distinct().count() == 315


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where(
            "false" if name == "documents" else "true"
        ).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "sequence_id", "ids"} <= set(out.columns)
