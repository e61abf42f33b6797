import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableguard.llm import clustering, queries

from ..conftest import same_rows


def brute(rows, clusters, rounds, dims, seed="2"):
    """One row for each kept vector, by plain loops."""
    kept = [(k, [math.floor(256 * float(x)) for x in v]) for k, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda k: (k is None, "" if k is None else hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (*hashed(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = {k: sum(d for d, c in own if c == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((k, c, d, inertia[c], sum(inertia.values()), sha[c]) for (k, _), (d, c) in zip(kept, own)), key=repr)


def test_equal_to_plain_loops_with_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 12)).astype(np.float32).tolist()
    rows = list(enumerate(x)) + [(7, x[9]), (7, x[7]), (None, x[3]), (None, x[3]), (200, x[5]), (201, x[5])]
    bad = [(300, None), (301, []), (302, x[0][:11]), (303, x[0][:11] + [None]), (304, [float("nan")] + x[0][:11]), (305, x[0][:11] + [float("-inf")])]
    df = spark.createDataFrame([(k, v, "a", 1, 2) for k, v in rows + bad], "vec_id long, embedding array<float>, key string, cluster int, Distance int")
    got = clustering.cluster(df.repartition(5), clusters=9, rounds=3, dims=12)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows + bad, 9, 3, 12)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in clustering.cluster(df, clusters=40, dims=2).collect()), key=repr) == brute(rows, 40, 5, 2)
    empty = clustering.cluster(df.limit(0), dims=2)
    assert empty.count() == 0 and empty.dtypes == clustering.cluster(df, dims=2).dtypes


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(df, dims=2)


@given(st.integers(0, 2**32), st.integers(1, 30), st.integers(1, 9), st.sampled_from([1, 7, 8, 9, 20]), st.sampled_from([2, 100, 1 << 27]))
@settings(max_examples=80, deadline=None)
def test_search_is_exact(seed, n, k, dims, largest):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-largest, largest, (n, dims)), rng.integers(-largest, largest, (k, dims))
    own, best, _ = clustering.nearest(x, c, rng.permutation(dims))
    far = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (best == far.min(axis=1)).all() and (own == far.argmin(axis=1)).all()


def test_search_abandons_far_centroids():
    """Where some dimensions vary most, few centroids outlive the first of them."""
    rng = np.random.default_rng(4)
    spread = np.where(np.arange(64) < 6, 2000, 20)
    x, c = (rng.normal(size=(n, 64)) * spread for n in (2000, 40))
    x, c = x.astype(np.int64), c.astype(np.int64)
    assert clustering.nearest(x, c, np.argsort(-x.var(axis=0)))[2] < 0.25 * 2000 * 40 * 64


def test_query_agrees_with_its_sql(spark, data, duck):
    same_rows(queries.queries()["op12_centroids"](spark, data), duck.execute(queries.oracle_sql()["op12_centroids"]))
