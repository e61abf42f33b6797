"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are centred, scaled, projected by several random rotations to a few
coordinates, shifted, and put in order along a Hilbert curve; each rotation is
one curve. Spark range-partitions the curve keys, and the offsets of its
partitions give every vector a rank. A query's candidates are the vectors
within ``reach`` ranks before and after it on each curve; their exact distances
are computed, and the best of all curves are merged and ranked again.

``reach`` and the number of curves are measured: ``PROBES`` queries are compared
with all vectors, and the cheapest choice is taken whose windows hold ``RECALL``
of their true neighbours. Vectors with structure need few ranks. For vectors
without any, windows of several curves would be dearer than one window over a
whole curve; that one is then taken, whose answer is exact.

Work is dealt in blocks of ranks: a block holds at most ``MOST`` vectors, of
whatever key, and meets only the queries whose window touches it. Equal
vectors are one point with its smallest ids, as many as a result can hold, so
that a group of copies of any size neither fills a window nor hides a tie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

CURVES = 8
COORDINATES = 12
BITS = 5
PROBES = 128
RECALL = 0.95
BLOCK = 2048
MOST = 65_536
K = 10


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (n, d), d * bits < 64.

    Gray-code form: the bits of all coordinates, taken plane by plane, are
    rotated and reflected from the top plane down.
    """
    x = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    d, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        b, low = np.uint64(level), np.uint64((1 << level) - 1)
        for k in range(d):
            flip = ((x[k] >> b) & one) == one
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, d):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(((x[-1] >> np.uint64(level)) & one) == one, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(d):
            key = (key << one) | (((x[k] ^ turn) >> np.uint64(level)) & one)
    return key


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, curves: int = CURVES, reach: int | None = None, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest found of each query row.

    Nearness is Euclidean distance in double precision; ties go to smaller
    keys. A row is never its own neighbour. Rows with a null key or with a
    vector that is null, zero or holds null or non-finite components take no
    part, nor do vectors of another length than the most common one. A row
    repeated with key and vector counts once, and rows of one key are no
    neighbours of each other. Other columns take no part. No query, no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if kind == "float" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & _valid(F.col("v")))
    out = f"query_id {vectors.schema[key].dataType.simpleString()}, rank int, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], out)
    dim = lengths.n
    rows = materialize(rows.where(F.size("v") == dim).dropDuplicates(["id", "v"]))
    same = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(same)).where(f"r <= {k + 1}")
    members = materialize(few.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")))
    asked = materialize(rows.where("q").join(members.select("v", "rep"), "v").select("id", "rep").distinct())
    total, mean, spread = _spread(members, dim)
    ranked = materialize(_ranks(_keys(members, dim, mean, spread, curves, seed)))
    queries = asked.select("rep").distinct()
    if reach is None:
        curves, reach = measure(ranked, members.select("rep", "v"), queries, dim, curves, k, recall, total)
    found = _windows(ranked.where(F.col("curve") < curves), members.select("rep", "v"), queries, dim, mean, reach, k)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "rep"))).where(f"r <= {k}")
    near = best.select("q", "rep", "dist").union(asked.select(F.col("rep").alias("q"), "rep", F.lit(0.0)).distinct())
    named = near.join(members.select("rep", "ids"), "rep").join(asked.select(F.col("rep").alias("q"), F.col("id").alias("query_id")), "q")
    each = named.select("query_id", "dist", F.explode("ids").alias(key)).where(F.col("query_id") != F.col(key))
    order = Window.partitionBy("query_id").orderBy("dist", key)
    return each.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", key, F.col("dist").alias("score"))


def measure(ranked: DataFrame, points: DataFrame, queries: DataFrame, dim: int, curves: int, k: int, recall: float, total: int) -> tuple[int, int]:
    """The number of curves and the reach whose windows hold the recall asked for
    of the probes' true neighbours, at the fewest comparisons for each query."""
    import pyarrow as pa

    kind = points.schema["rep"].dataType.simpleString()
    rows = points.join(queries.orderBy(F.xxhash64("rep"), "rep").limit(PROBES), "rep").collect()
    if not rows or total <= k + 1:
        return 1, total
    probes, ids = np.array([r.v for r in rows], dtype=np.float64), [r.rep for r in rows]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, rep = _matrix(b.column(1), dim), b.column(0)
                for own, p in zip(ids, probes):
                    d = ((x - p) ** 2).sum(axis=1)
                    near = np.argsort(d, kind="stable")[: k + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(near), rep.type), rep.take(pa.array(near)), pa.array(d[near])], names=["q", "rep", "dist"])

    found = points.select("rep", "v").mapInArrow(run, f"q {kind}, rep {kind}, dist double").where("q != rep")
    true = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "rep"))).where(f"r <= {k}").select("q", "rep")
    pairs = F.broadcast(true)  # k for each probe
    at = ranked.join(pairs.select("rep", "q"), "rep").select("curve", "q", "rep", F.col("rank").alias("there"))
    own = ranked.join(F.broadcast(pairs.select(F.col("q").alias("rep")).distinct()), "rep").select("curve", F.col("rep").alias("q"), F.col("rank").alias("here"))
    apart = at.join(F.broadcast(own), ["curve", "q"]).select("curve", "q", "rep", F.abs(F.col("here") - F.col("there")).alias("far")).collect()
    need: dict[tuple, list[int]] = {}
    for r in apart:
        need.setdefault((r.q, r.rep), [total] * curves)[r.curve] = r.far
    far = np.minimum.accumulate(np.array(list(need.values())), axis=1)
    choices = [(total, 1, total)]
    for c in range(1, curves + 1):
        ranks = max(1, int(np.ceil(1.1 * np.quantile(far[:, c - 1], recall))))
        choices.append((c * min(total, 2 * ranks), c, ranks))
    # Of equally dear choices the whole curve, which is exact; it comes first.
    _, c, ranks = min(choices, key=lambda choice: choice[0])
    return c, ranks


def _spread(members: DataFrame, dim: int) -> tuple[int, np.ndarray, float]:
    """Number of points, their mean, and the root of their mean variance."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "q": [float((x * x).sum())]})

    sums = members.select("v").mapInArrow(run, "n long, s array<double>, q double")
    each = sums.select("n", "q", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("col").alias("s")).orderBy("pos").collect()
    n = each[0].n
    mean = np.array([r.s for r in each]) / n
    return n, mean, float(np.sqrt(max(each[0].q / n - mean @ mean, 1e-30) / dim))


def _keys(members: DataFrame, dim: int, mean, spread: float, curves: int, seed: int) -> DataFrame:
    d = min(COORDINATES, dim)

    def run(batches):
        import pyarrow as pa

        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :d] for _ in range(curves)]
        shifts = rng.random((curves, d))
        for b in batches:
            if not b.num_rows:
                continue
            x = (_matrix(b.column(1), dim) - mean) / spread
            for c in range(curves):
                cell = np.clip((x @ turns[c] + 3 + 6 * shifts[c]) / 12 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(cell, BITS).astype(np.int64)), b.column(0)], names=["curve", "place", "rep"])

    kind = members.schema["rep"].dataType.simpleString()
    return members.select("rep", "v").mapInArrow(run, f"curve int, place long, rep {kind}")


def _ranks(keys: DataFrame) -> DataFrame:
    """(curve, rep, rank): place in the order of each curve, ties by rep."""
    dealt = keys.repartitionByRange("curve", "place", "rep").sortWithinPartitions("curve", "place", "rep")
    held = materialize(dealt.select("curve", "rep", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    starts = held.groupBy("curve", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return held.withColumn("part", part).join(starts, ["curve", "part"]).select("curve", "rep", (F.col("at") - F.col("first") + F.col("before")).alias("rank"))


def _windows(ranked: DataFrame, points: DataFrame, queries: DataFrame, dim: int, mean: np.ndarray, reach: int, k: int) -> DataFrame:
    """(q, rep, dist): the best k of each query's windows, by block, made distinct."""
    placed = ranked.join(points, "rep")
    size = int(np.clip(reach // 8, BLOCK, MOST))
    block = lambda c: F.floor(c / size)
    last = F.lit(ranked.agg(F.max("rank")).first()[0] // size)
    own = placed.select("curve", block(F.col("rank")).alias("block"), F.lit(0).alias("asks"), "rank", "rep", "v")
    wide = F.sequence(F.greatest(block(F.col("rank") - reach), F.lit(0)), F.least(block(F.col("rank") + reach), last))
    asks = placed.join(queries, "rep", "left_semi").select("curve", F.explode(wide).alias("block"), F.lit(1).alias("asks"), "rank", "rep", "v")
    dealt = own.union(asks).repartition("curve", "block").sortWithinPartitions("curve", "block", "asks")

    def run(batches):
        import pyarrow as pa

        now, data, queue = None, [], []

        def close():
            if not data or not queue:
                return
            dr, di, dv = (np.concatenate(x) for x in zip(*data))
            centred = dv - mean
            norms = (centred * centred).sum(axis=1)
            for qr, qi, qv in queue:
                for at in range(0, len(qr), 64):
                    r, i, x = qr[at : at + 64], qi[at : at + 64], qv[at : at + 64]
                    own = x - mean
                    rough = norms[None, :] - 2 * (own @ centred.T)
                    rough[(np.abs(dr[None, :] - r[:, None]) > reach) | (di[None, :] == i[:, None])] = np.inf
                    top = min(len(di), k) - 1
                    limit = np.partition(rough, top, axis=1)[:, top]
                    # All that rounding may have put in the wrong order stay.
                    slack = 1e-11 * (norms.max() + (own * own).sum(axis=1))
                    who, near = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
                    # Summed from the first component to the last, as plain loops and SQL do.
                    dist = np.sqrt(np.concatenate([np.add.accumulate((dv[near[a : a + 8192]] - x[who[a : a + 8192]]) ** 2, axis=1)[:, -1] for a in range(0, len(who), 8192)] or [np.zeros(0)]))
                    order = np.lexsort((di[near], dist, who))
                    who, near, dist = who[order], near[order], dist[order]
                    first = np.searchsorted(who, who, side="left")
                    ok = np.arange(len(who)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(i[who[ok]]), pa.array(di[near[ok]]), pa.array(dist[ok])], names=["q", "rep", "dist"])

        for b in batches:
            if not b.num_rows:
                continue
            curve, blk, asks, rank, rep = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            v = _matrix(b.column(5), dim)
            new = np.flatnonzero(np.concatenate(([True], (curve[1:] != curve[:-1]) | (blk[1:] != blk[:-1]) | (asks[1:] != asks[:-1]))))
            for a, z in zip(new, np.append(new[1:], len(curve))):
                if now != (curve[a], blk[a]):
                    yield from close()
                    now, data, queue = (curve[a], blk[a]), [], []
                part = (rank[a:z], rep[a:z], v[a:z])
                if asks[a]:
                    queue = [part]
                    yield from close()
                else:
                    data.append(part)
                queue = []

    kind = points.schema["rep"].dataType.simpleString()
    return dealt.mapInArrow(run, f"q {kind}, rep {kind}, dist double").groupBy("q", "rep").agg(F.min("dist").alias("dist"))


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search(vectors, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """Brute force; equal to op5_nearest on tables that its windows cover."""
    fine = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
    far = "sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    return f"""WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {fine}),
    d AS (SELECT q.vec_id AS query_id, c.vec_id, {far} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM d QUALIFY rank <= {K}"""
