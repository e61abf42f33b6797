"""Centroid clustering of integer vectors by partial-distance search.

Components are turned into integers, so that sums, centroids and distances are
exact and the same however rows lie. Each round is one job over the written
table of integers: every task assigns its vectors to the nearest centroid and
adds them up by cluster; Spark adds the tasks' sums, and the driver holds the
centroids alone, whose number and length are parameters.

Search for the nearest centroid takes dimensions in the order of their variance
over all vectors, ``CHUNK`` at a time. A vector begins with the centroid nearest
on the first of them and gives up any other as soon as its squared differences
are strictly above the best distance so far. Those that are not finish all
dimensions, so the result is that of a full search, ties to the smaller number.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = "2"
CHUNK = 8
BLOCK = 8192
#: Integers within this bound have squared distances that a long can hold.
LARGEST = 1 << 27


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, their squared distance, and how many differences of components it took."""
    x, c = np.ascontiguousarray(vectors[:, order].T), centroids[:, order]
    n, dims, every = x.shape[1], len(order), np.arange(x.shape[1])
    first = np.stack([((x[:CHUNK] - row[:CHUNK, None]) ** 2).sum(axis=0) for row in c])
    own = first.argmin(axis=0)
    start = own.copy()
    best = first[own, every] + ((x[CHUNK:] - c[own, CHUNK:].T) ** 2).sum(axis=0)
    work = len(c) * n * min(CHUNK, dims) + n * max(0, dims - CHUNK)
    for k in range(len(c)):
        left = np.flatnonzero((first[k] <= best) & (start != k))
        far = first[k, left]
        for at in range(CHUNK, dims, CHUNK):
            if not len(left):
                break
            far = far + ((x[at : at + CHUNK, left] - c[k, at : at + CHUNK, None]) ** 2).sum(axis=0)
            work += len(left) * min(CHUNK, dims - at)
            stays = far <= best[left]
            left, far = left[stays], far[stays]
        wins = (far < best[left]) | (k < own[left])
        best[left[wins]], own[left[wins]] = far[wins], k
    return own, best, work


def _blocks(column, dims: int):
    """Vectors of an Arrow column, BLOCK at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    for at in range(0, len(flat), BLOCK):
        yield flat[at : at + BLOCK]


def _variances(vectors: DataFrame, dims: int) -> np.ndarray:
    """Of each dimension over all vectors. They steer the search only, so doubles do."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((3, dims))
        for b in batches:
            for x in _blocks(b.column(1), dims):
                total += [np.full(dims, len(x)), x.sum(axis=0), (x.astype(np.float64) ** 2).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), *map(pa.array, total)], names=["dim", "n", "s", "q"])

    found = vectors.mapInArrow(run, "dim int, n double, s double, q double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in "nsq")).collect()
    n, s, q = np.array([[r.n, r.s, r.q] for r in sorted(found)]).T
    return q / n - (s / n) ** 2


def _next(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    dims, now = len(order), np.array(centroids, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        sums, counts = np.zeros((len(now), dims), dtype=np.int64), np.zeros(len(now), dtype=np.int64)
        for b in batches:
            for x in _blocks(b.column(1), dims):
                own = nearest(x, now, order)[0]
                for k in np.unique(own):
                    sums[k] += x[own == k].sum(axis=0)
                counts += np.bincount(own, minlength=len(now))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(used)), pa.int32()), pa.array(np.repeat(counts[used], dims)), pa.array(sums[used].ravel())], names=["cluster", "dim", "n", "s"]
        )

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = vectors.mapInArrow(run, "cluster int, dim int, n long, s long").groupBy("cluster", "dim").agg(exact("n"), exact("s"))
    out = [list(c) for c in centroids]
    for r in found.collect():
        out[r.cluster][r.dim] = int(r.s) // int(r.n)
    return out


def _assigned(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    dims, now = len(order), np.array(centroids, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [nearest(x, now, order)[:2] for x in _blocks(b.column(1), dims)]
            if found:
                own, best = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(best)], names=["key", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key {vectors.schema[0].dataType.simpleString()}, cluster int, distance long")


def integers(v: Column, dims: int) -> tuple[Column, Column]:
    """A vector's integers, and whether it is kept: of that length, without nulls, NaN or infinity.

    A kept component beyond LARGEST raises, as its distances would not fit a long.
    """
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) <= LARGEST, F.floor(scaled(x)).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for squared distances in longs")).cast("int"))
    return F.transform(v, whole), F.coalesce((F.size(v) == dims) & finite, F.lit(False))


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    The first centroids are the vectors whose ``seed:key`` has the smallest
    SHA-256, null keys last, equal ones by their integers; fewer vectors than
    ``clusters`` make as many centroids. Null and repeated keys are rows like
    others, equal vectors are vectors like others, an empty table stays empty,
    and further columns, whatever their names, are not looked at.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    c = lambda name: F.col(names[df.columns.index(name)])
    whole, kept = integers(c(vector), dims)
    vectors = materialize(df.toDF(*names).where(kept).select(c(key).alias("key"), whole.alias("v")))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    centroids = [list(r.v) for r in vectors.orderBy(first.asc_nulls_last(), "v").limit(clusters).select("v").collect()]
    shape = {"cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if not centroids:
        return vectors.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *(F.lit(None).cast(t).alias(n) for n, t in shape.items())).limit(0)
    order = np.argsort(-_variances(vectors, dims), kind="stable")
    for _ in range(rounds):
        centroids = _next(vectors, centroids, order)
    found = materialize(_assigned(vectors, centroids, order))
    release(vectors)
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    listed = {
        "cluster_inertia": [sums.get(k, 0) for k in range(len(centroids))], "inertia": [sum(sums.values())] * len(centroids),
        "centroid_sha256": [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids],
    }
    more = (F.get(F.array(*map(F.lit, listed[n])), F.col("cluster")).cast(t).alias(n) for n, t in shape.items())
    return found.select(F.col("key").alias(key), "cluster", "distance", *more)


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Every 64-dimensional embedding with its cluster after five rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """Full search, round after round."""
    fine = f"len(embedding) = {DIMENSIONS} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    far = "list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    floor = ", ".join(f"((sum(v[{k}]) - (sum(v[{k}]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT" for k in range(1, DIMENSIONS + 1))
    steps = [
        f"q AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM q QUALIFY c < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT id, any_value(q.vec_id) AS vec_id, any_value(q.v) AS v, min({{'d': {far}, 'c': c.c}}) AS m FROM q, c{k} c GROUP BY id)")
        if k < ROUNDS:
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT m.c AS c, [{floor}] AS v FROM a{k} GROUP BY m.c) n ON n.c = c.c)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.c = m.c"""
