import numpy as np
import pytest
from pyspark.sql import functions as F

from termsift.llm import multi_index as mi
from termsift.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x double, whitened int"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, v, 1, "e", 0.5, 7) for k, v in rows], schema)


def vectors(seed, n, dim=8, copies=40):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype("f4")
    x[:, 2] = x[:, 1] * 0.5 + 0.1 * x[:, 2]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(n + k, x[3].tolist()) for k in range(copies)]
    return rows


BAD = [
    (9001, None), (9002, []), (9003, [None] * 8), (9004, [float("nan")] + [0.0] * 7),
    (9005, [float("inf")] + [0.0] * 7), (9006, [1.0] * 5),
]


def brute_whitening(rows):
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s).astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    return n, deviation, centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_brute_force(spark):
    rows = vectors(1, 300) + [(5, vectors(1, 300)[5][1]), (None, vectors(1, 300)[7][1])]
    out = wh.whitened_components(table(spark, rows + BAD).repartition(7)).collect()
    n, deviation, whitened, explained = brute_whitening(rows)
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    found = sorted(((r.vec_id if r.vec_id is not None else -1, r.component, round(abs(r.whitened), 7), r.deviation) for r in out))
    wanted = sorted(
        (k if k is not None else -1, j + 1, round(abs(whitened[i, j]), 7), int(deviation[i]))
        for i, (k, _) in enumerate(rows) for j in range(8)
    )
    assert [f[:2] + f[3:] for f in found] == [w[:2] + w[3:] for w in wanted]
    assert np.allclose([f[2] for f in found], [w[2] for w in wanted], atol=1e-6)
    shares = {r.component: r.explained for r in out}
    assert np.allclose([shares[k + 1] for k in range(8)], explained, rtol=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    # one sign for all rows
    signs = {}
    place = {k: i for i, (k, _) in enumerate(rows)}
    for r in out:
        if r.vec_id is not None and abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * whitened[place[r.vec_id], r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_groups(spark):
    rows = vectors(2, 100, copies=500)  # one group of five sixths of the rows
    weighted, model, error = wh.whiten(table(spark, rows))
    assert model.n == 600 and weighted.count() == 600 and error < 1e-9
    once, model, _ = wh.whiten(table(spark, rows), weighted=False)
    assert model.n == 100 and once.count() == 600
    same = weighted.where("id >= 100 or id = 3").select("whitened").distinct().collect()
    assert len(same) == 1
    assert wh.whiten(table(spark, rows), components=2)[0].first().whitened.__len__() == 2


def test_whitening_without_variance_and_without_rows(spark):
    assert wh.whitened_components(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert wh.whitened_components(table(spark, [])).collect() == []
    assert wh.whitened_components(table(spark, BAD[:5])).collect() == []
    flat = [(k, [float(k % 5), 3.0, 0.0]) for k in range(50)]
    out = wh.whitened_components(table(spark, flat)).collect()
    assert {r.component for r in out} == {1} and out[0].explained == pytest.approx(1)


def test_exact_numbers():
    x = np.array([[2**61, 5], [2**61 + 1, 7], [2**61 + 5, 9]])
    sums = [int(sum(int(v) for v in column)) for column in x.T]
    wanted = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert wh.deviations(x, 3, sums) == wanted
    assert np.allclose(wh.centred(x, 3, sums), [[-2, -2], [-1, 0], [3, 2]])
    assert wh.deviations(np.array([[0], [2**40]]), 2, [2**40]) == [None, None]


def test_sums_beyond_64_bits(spark):
    groups = spark.createDataFrame([([2**62, -5], 7), ([2**62, 4], 9)], "x array<long>, weight long")
    assert wh.exact_sums(groups, 2) == (16, [16 * 2**62, 1])


# -- nearest neighbours ---------------------------------------------------------------------------


def brute_nearest(rows, wanted, every):
    x = np.array([v for _, v in rows], float)
    ids = np.array([k for k, _ in rows])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:wanted]
        out.setdefault(ids[i], [(int(ids[j]), score[j]) for j in order])
    return out


def recall(found, wanted):
    hits = 0
    for k, best in wanted.items():
        own = sorted((r for r in found if r.query_id == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) == len(best)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {j for j, _ in best})
    return hits / sum(map(len, wanted.values()))


@pytest.mark.parametrize("kind", ["scattered", "clusters", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind == "lengths":
        x *= rng.exponential(size=(3000, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype("f4"))]
    docs = table(spark, rows + BAD[:2]).repartition(5)
    found = mi.nearest_neighbours(docs, F.col("vec_id") % 20 == 0).collect()
    wanted = brute_nearest(rows, 20, 20)
    assert {r.query_id for r in found} == set(wanted) and recall(found, wanted) >= 0.9
    exact = {(k, j): s for k, best in wanted.items() for j, s in best}
    for r in found:
        assert r.score == pytest.approx(exact.get((r.query_id, r.vec_id), r.score), rel=1e-12)


def test_clusters_are_not_walked_through(spark):
    rng = np.random.default_rng(7)
    x = 4 * rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    entries = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<double>")
    grid = mi.fit_grid(entries, len(x))
    counts = np.bincount(grid.cells(x), minlength=len(grid.books[0]) ** 2).reshape(len(grid.books[0]), -1)
    walked = [counts.ravel()[mi.walk(grid, counts.astype(float), x[k], 20)[0]].sum() for k in range(50)]
    assert np.mean(walked) < 0.2 * len(x)


def test_copies_ties_and_own_ids(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(60)] + [(k, [0.9, 0.1 * (k % 3), 0.0]) for k in range(60, 90)]
    rows += [(40, [1.0, 0.0, 0.5]), (20, [0.0, 1.0, 0.0])]  # a repeated row, and an id with two vectors
    docs = table(spark, [*rows, (100, [0.0] * 3), (None, [1.0] * 3), *BAD])
    found = mi.nearest_neighbours(docs, F.col("vec_id") % 20 == 0).collect()
    assert not [r for r in found if r.query_id == r.vec_id or r.query_id == 100 or r.vec_id in (None, 100)]
    zero = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0]
    assert zero == [*range(1, 21)]
    forty = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 40]
    assert forty == [*range(20)] + [20] and len(set(forty)) == 21 or forty == [*range(20)]
    assert sum(r.query_id == 20 for r in found) == 40  # two vectors, two lists


def test_common_vectors_keep_their_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(mi, "COMMON", 50)
    rows = [(k, [1.0, 2.0]) for k in range(700, 0, -1)] + [(1000 + k, [float(k), 1.0]) for k in range(30)]
    entries = mi.entries_of(
        spark.createDataFrame(rows, "id long, vector array<float>").repartition(6), 21
    ).collect()
    own = {tuple(r.vector): r.ids for r in entries}
    assert own[1.0, 2.0] == list(range(1, 22)) and len(own) == 31


def test_bounds_only_save_rows(spark, monkeypatch):
    """What a query gets back does not depend on its bound, be it too high for all or for some."""
    rng = np.random.default_rng(9)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(600, 6)))]
    docs = table(spark, rows)
    results = []
    for passing in (5, 1, 0.01, 1e9):
        monkeypatch.setattr(mi, "PASSING", passing)
        found = mi.nearest_neighbours(docs, F.col("vec_id") % 20 == 0).collect()
        results.append(sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found))
    assert len(results[0]) == 600 and all(r == results[0] for r in results)


def test_rows_of_the_grid_are_dealt_into_blocks():
    counts = np.zeros((6, 2), np.int64)
    counts[:, 0] = [10, 20, 250, 5, 5, 90]
    blocks = mi.blocks_of(counts, 100)
    assert blocks.first.tolist() == [0, 0, 1, 4, 4, 4] and blocks.parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_few_rows(spark):
    assert mi.nearest_neighbours(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert mi.nearest_neighbours(table(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).collect() == []
    rows = [(k, [float(k)]) for k in range(1, 6)]
    found = mi.nearest_neighbours(table(spark, rows), F.col("vec_id") == 5).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [
        (1, 4, 20.0), (2, 3, 15.0), (3, 2, 10.0), (4, 1, 5.0),
    ]
