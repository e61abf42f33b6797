import numpy as np
import pytest
from pyspark.sql import functions as F

from tableguard.llm import neighbours as nn


def brute(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def as_dict(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_exact_on_small_table_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]
    x[100] = x[200]
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [1.0] * 7 + [None]), (1300, [float("nan")] + [1.0] * 7), (1400, [float("inf")] + [1.0] * 7), (None, x[3].tolist()), (1500, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in good + bad + [good[10]]], "vec_id long, embedding array<float>, rank int")
    got = as_dict(nn.search(df, F.col("vec_id") % 10 == 0))
    want = brute(good, range(0, 300, 10))
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def recall_of(spark, x, monkeypatch, every=100):
    """Recall against brute force, and the curves and reach that were measured."""
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    chosen, real = [], nn.measure
    monkeypatch.setattr(nn, "measure", lambda *a: chosen.append(real(*a)) or chosen[-1])
    got = as_dict(nn.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % every == 0))
    want = brute(rows, range(0, len(x), every))
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]), *chosen[0]


def test_recall_with_structure(spark, monkeypatch):
    """Windows suffice where vectors lie near a surface: far fewer comparisons than vectors."""
    rng = np.random.default_rng(2)
    x = np.sin(rng.uniform(-2, 2, size=(12_000, 2)) @ rng.normal(size=(2, 64)) * 0.5 + rng.normal(size=64)) + rng.normal(size=(12_000, 64)) * 1e-3
    recall, curves, reach = recall_of(spark, x, monkeypatch)
    assert recall >= 0.9 and curves * 2 * reach <= 12_000 / 2


def test_recall_without_structure(spark, monkeypatch):
    """Windows are never dearer than all vectors."""
    x = np.random.default_rng(2).normal(size=(6000, 64))
    recall, curves, reach = recall_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True), monkeypatch)
    assert recall >= 0.9 and curves * min(6000, 2 * reach) <= 6000


def test_small_tables_with_structure_use_windows(spark, monkeypatch):
    """However few the vectors are: what was measured decides, not their number."""
    rng = np.random.default_rng(8)
    x = np.sin(rng.uniform(-2, 2, size=(1500, 1)) @ rng.normal(size=(1, 64)) * 0.5 + rng.normal(size=64)) + rng.normal(size=(1500, 64)) * 1e-4
    recall, curves, reach = recall_of(spark, x, monkeypatch, every=20)
    assert recall >= 0.9 and curves * 2 * reach < 1500 / 2


def test_equally_dear_windows_give_way_to_the_whole_curve(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(4000, 64))
    recall, curves, reach = recall_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True), monkeypatch)
    assert (recall, curves, reach) == (1.0, 1, 4000)


def test_ties_and_vectors_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 2, size=(3000, 6)) + 1.0, 1e7 + rng.integers(0, 9, size=(3000, 4))):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = as_dict(nn.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 300 == 0, reach=3000, curves=1))
        want = brute(rows, range(0, 3000, 300))
        assert {q: [v for v, _ in got[q]] for q in want} == {q: [v for v, _ in want[q]] for q in want}


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [len(v) for v in as_dict(nn.search(df, F.col("vec_id") % 100 == 0)).values()] == [2, 2]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert nn.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    key = nn.hilbert_keys(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_ranks_are_places(spark):
    keys = spark.createDataFrame([(c, (k * 7919) % 101, k) for c in range(3) for k in range(200)], "curve int, place long, rep long").repartition(5)
    rows = nn._ranks(keys).collect()
    for c in range(3):
        want = [k for _, k in sorted(((k * 7919) % 101, k) for k in range(200))]
        assert [r.rep for r in sorted((r for r in rows if r.curve == c), key=lambda r: r["rank"])] == want


def test_oracle(spark, data, duck):
    from tableguard.llm import queries
    from tests.conftest import same_rows

    same_rows(nn.op5_nearest(spark, data), duck.execute(queries.oracle_sql()["op5_nearest"]))
