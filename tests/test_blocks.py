import random
import re

import pytest
from data import INDEX, RESULTS

from termsift import cluster
from termsift.operators.boolean import blocks_of, boolean_search_blocks, reach, reach_blocks
from termsift.schemas import BLOCKS, DOC_IDS, POSTINGS
from termsift.sources.blocks import block_postings, build_blocks, read_blocks, write_blocks


def postings_of(spark, index):
    rows = [(term, doc, term[:2]) for term, docs in index.items() for doc in docs]
    return spark.createDataFrame(rows, POSTINGS).repartition(4)


def mixed():
    rnd = random.Random(8)
    return {
        "dense": list(range(5000)),
        "half": rnd.sample(range(100_000), 4000),
        "sparse": rnd.sample(range(1 << 45), 700),
        "ends": [*range(300), *range((1 << 40), (1 << 40) + 400)],
        "below": [-5, -1, 0, 3, -(1 << 60)],
        "many": rnd.sample(range(-50_000, 50_000), 3000),
        "rare": [17, 4242, 99_999],
        "one": [7, 7, 7],
    }


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_blocks_hold_every_posting_once(spark, monkeypatch, size):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
    index = mixed()
    blocks = build_blocks(postings_of(spark, index), ids_per_block=64)
    found = {}
    for r in blocks.collect():
        ids = [r.first_id + o for o in r.offsets]
        assert ids == sorted(set(ids)) and (r.n, r.last_id) == (len(ids), ids[-1])
        assert len({i >> r.shift for i in ids}) == 1
        found.setdefault(r.term, []).extend(ids)
    assert {t: sorted(ids) for t, ids in found.items()} == {t: sorted(set(ids)) for t, ids in index.items()}
    sizes = {t: [r.n for r in blocks.where(f"term = '{t}'").collect()] for t in ("dense", "half", "rare")}
    assert max(sizes["dense"]) <= 64 and 32 <= 4000 / len(sizes["half"]) <= 256 and sizes["rare"] == [3]


def test_written_blocks(spark, tmp_path):
    path, index = str(tmp_path / "blocks"), mixed()
    write_blocks(build_blocks(postings_of(spark, index), 64), path)
    some = read_blocks(spark, path, ["dense", "rare", "zzzz"])
    assert set(some.columns) == set(BLOCKS.names) and {r.term for r in some.collect()} == {"dense", "rare"}
    found = block_postings(read_blocks(spark, path))
    wanted = {(t, i, t[:2]) for t, ids in index.items() for i in ids}
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    assert read_blocks(spark, path, ["zzzz"]).count() == 0


def test_results(spark):
    blocks = build_blocks(postings_of(spark, INDEX), 2).cache()
    for text, wanted in RESULTS.items():
        assert {r[0] for r in boolean_search_blocks(blocks, text).collect()} == wanted, text


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_random_queries(spark, monkeypatch, size):
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
    index = mixed()
    postings = postings_of(spark, index)
    blocks = build_blocks(postings, 64).cache()
    own = {t: set(ids) for t, ids in index.items()}
    cases = {
        "rare and dense": own["rare"] & own["dense"],
        "dense and rare and half": own["rare"] & own["dense"] & own["half"],
        "rare or one and dense": (own["rare"] | own["one"]) & own["dense"],
        "dense and not half": own["dense"] - own["half"],
        "below and many and not rare": (own["below"] & own["many"]) - own["rare"],
        "sparse or ends": own["sparse"] | own["ends"],
        "zzzz and dense": set(),
    }
    for text, wanted in cases.items():
        assert {r[0] for r in boolean_search_blocks(blocks, text).collect()} == wanted, text
        assert reach_blocks(blocks, text)[1:] == reach(postings.distinct(), text)[1:]


def test_and_skips_whole_blocks(spark):
    index = {"common": list(range(50_000)), "other": list(range(0, 50_000, 5)), "rare": [11, 12, 40_000]}
    blocks = build_blocks(postings_of(spark, index)).cache()
    rare = spark.createDataFrame([(i,) for i in index["rare"]], DOC_IDS)
    opened = blocks_of(blocks, rare, ["common", "other"])
    assert blocks.where("term = 'common'").count() >= 90
    assert {r.term: r["count"] for r in opened.groupBy("term").count().collect()} == {"common": 2, "other": 2}
    assert block_postings(opened).count() < 0.1 * 60_000
    assert {r[0] for r in boolean_search_blocks(blocks, "common and rare and not other").collect()} == {11, 12}


def test_a_common_term_is_spread(spark):
    index = {"common": list(range(40_000)), "rare": [1]}
    blocks = build_blocks(postings_of(spark, index))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert shuffles and all(keys.count(",") == 4 for keys in shuffles)  # and a number of parts
    assert blocks.where("term = 'common'").count() >= 70


def test_no_postings(spark):
    blocks = build_blocks(spark.createDataFrame([], POSTINGS))
    assert blocks.collect() == [] and boolean_search_blocks(blocks, "a and b").collect() == []
