import math
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tableguard.llm import mixing


def fill(sizes: dict, weights=(5, 2, 1), share=1.5, limit=2):
    """Targets by the rule as told: share, stop at the limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * unit > limit * sizes[s]]
        if not full:
            return out | {s: w[s] * unit for s in open_}
        for s in full:
            out[s] = float(limit * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, size long, source string, shard int")


def check(rows, got):
    sizes = defaultdict(int)
    for _, n, s, _ in rows:
        sizes[s] += n
    want, taken = fill(sizes), defaultdict(int)
    assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.size, r.source, r.shard)) for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == sum(d.words for d in r.draws) and 0 <= r.taken <= 2 * r.size
        assert len({d.copy for d in r.draws}) == len(r.draws) and all(0 < d.words <= r.size for d in r.draws)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_mix(spark):
    rng = np.random.default_rng(0)
    names = ["b", "a", None, "é", "Z", "", "one-doc", "no words"]
    rows = [(i, int(rng.integers(0, 400)), names[int(rng.integers(0, 6)) if i % 3 else 1], 5) for i in range(900)]
    rows += [(5000, 1_000_000, "one-doc", 1), (6000, 0, "no words", 1), (6001, 0, "no words", 1), (None, 10, "b", 1), (None, 10, "b", 1), (7, 3, "b", 1), (7, 3, "b", 1)]
    first = mixing.plan_mix(frame(spark, rows), "size", shards=8, block_words=64).collect()
    check(rows, first)
    clash = frame(spark, rows).repartition(7).selectExpr("*", "1 AS target", "2 AS taken", "3 AS draws", "4 AS source_size", "5 AS copy", "6 AS words")
    planned = mixing.plan_mix(clash, "size", shards=8, block_words=64)
    again = planned.drop("copy", "words").collect()
    assert mixing.draw_mix(planned).columns.count("words") == 1
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_shards_are_even_and_disjoint(spark):
    rows = [(i, 50, f"s{i % 4}", 0) for i in range(4000)]
    planned = mixing.plan_mix(frame(spark, rows), "size", shards=8, block_words=500)
    drawn = mixing.draw_mix(planned).collect()
    words = Counter()
    for r in drawn:
        words[r.shard] += r.words
    assert set(words) == set(range(8)) and max(words.values()) < 1.1 * min(words.values())
    assert Counter((r.doc_id, r.copy) for r in drawn).most_common(1)[0][1] == 1
    order = [r.doc_id for r in drawn if r.shard == 3]
    assert order != sorted(order)


def test_one_and_no_source(spark):
    check(rows := [(i, 9, None, 0) for i in range(50)], mixing.plan_mix(frame(spark, rows), "size").collect())
    assert mixing.plan_mix(frame(spark, []), "size").count() == 0
    check(rows := [(1, 0, "a", 0)], mixing.plan_mix(frame(spark, rows), "size").collect())


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 500), min_size=1), st.sampled_from([1, 2, 8, 16]))
@settings(max_examples=50, deadline=None)
def test_splitting_tree_is_exact(quotas, shards):
    got = mixing.splitting_tree(quotas, shards, 1)
    assert {s: sum(n) for s, n in got.items()} == quotas
    totals = [sum(got[s][k] for s in quotas) for k in range(shards)]
    assert max(totals) - min(totals) <= 1 and min(min(n) for n in got.values()) >= 0


def test_splitting_tree_follows_the_hypergeometric_law():
    draws = np.array([mixing.splitting_tree({"a": 30, "b": 70}, 2, seed)["a"][0] for seed in range(3000)])
    assert abs(draws.mean() - 15) < 0.15 and abs(draws.var() - 50 * 0.3 * 0.7 * 50 / 99) < 0.5


def test_words(spark):
    texts = [None, "", " \t\x0b\x0c\r\n", "a b c", "x" * 10 + "\n" + "y"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(mixing.n_words(rows.text)).collect()] == [0, 0, 0, 2, 2]


def test_shards_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARDS", 4)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    monkeypatch.setattr(mixing, "SMALL", 0)
    rows = [(i, 50, f"s{i % 4}", 0) for i in range(400)]
    got = mixing.plan_mix(frame(spark, rows), "size", block_words=100).collect()
    check(rows, got)
    assert {d.shard for r in got for d in r.draws} == set(range(32))


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(k, 5 + k, "ab"[k % 2], k, k, k, k, k) for k in range(20)], "doc_id long, size long, source string, _row int, _src int, _order int, _start int, _key int")
    planned = mixing.plan_mix(docs, "size")
    assert planned.columns == [*docs.columns, "source_size", "target", "taken", "draws"]
    rows = planned.collect()
    assert all(tuple(r[3:8]) == (r.doc_id,) * 5 and r.taken == sum(d.words for d in r.draws) for r in rows)
    drawn = mixing.draw_mix(planned).collect()
    assert sum(r.words for r in drawn) == sum(r.taken for r in rows) and all(r._row == r.doc_id for r in drawn)


def test_many_sources_and_a_huge_one(spark):
    """100,000 sources beside one with a third of all rows: quotas of pools are split exactly, and over all shards."""
    from pyspark.sql import functions as F

    name = F.when(F.col("id") < 100_000, F.concat(F.lit("s"), F.col("id").cast("string"))).otherwise(F.lit("huge"))
    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), name.alias("source"), (1 + F.col("id") % 50).alias("size"))
    planned = mixing.plan_mix(docs, "size", shards=16, block_words=16).select("doc_id", "source", "size", "taken", "draws")
    rows = planned.collect()
    assert sorted(r.doc_id for r in rows) == list(range(150_000))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = fill(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    for which in (True, False):
        words = Counter()
        for r in rows:
            for d in r.draws:
                words[d.shard] += d.words * ((r.source == "huge") == which)
        assert set(words) == set(range(16)) and max(words.values()) < 1.1 * min(words.values())


def test_a_source_is_dealt_to_ranges_that_grow_with_it(spark, monkeypatch):
    """No task places more than a range of a source, and texts take no part in that."""
    seen, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, *a: seen.append(write(df, *a)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(40_000).selectExpr("id AS doc_id", "'all' AS source", "5L AS size", "repeat('x', 1000) AS text")
        assert mixing.plan_mix(docs, "size").count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    dealt = next(t for t in seen if "_range" in t.columns and "_order" in t.columns)
    parts = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(parts) == 4 and max(parts) < 15_000 and not {"text", "_row"} & set(dealt.columns)
