"""Mixing sources to target weights through a hypergeometric splitting tree.

1. Sizes in words are summed by source; targets come from weights by filling
   up to a limit (``targets``).
2. Each source's documents are put in a random order by hash. A document's
   place is the number of words before it. The first and the second copy of
   every document follow one another in one long stream of words, of which the
   mix takes exactly the target: whole documents, and a part of the last one.
3. The taken words of a source are a quota of blocks. A binary tree of
   multivariate hypergeometric draws splits the quotas among output shards:
   each node gives half its blocks to each side, drawn from the exact counts.
4. A shard draws its disjoint range of the permuted blocks of each source, and
   its rows are shuffled locally by hash.

Keys and sizes are dealt to ranges by source and hash (Spark samples the
bounds), so a source with a third of all rows fills a third of the ranges. Places
are running sums within a range plus what the ranges before it hold. Only these
narrow rows are sorted by place; whole rows, texts and all, move once, by source
and hash, to what was drawn for them.

Sources stay in Spark, however many there are: their numbers and running sums are
found by ranges too. The tree's categories are the sources with more than one in
``OWN`` of all blocks, and ``POOLS`` pools of the others, by hash. The blocks of a
pool are put in a random order, and its quota in a shard takes the next ones of
that order: a permutation dealt into parts of given sizes follows the same
law as a tree over the pool's sources. So the driver holds at most ``OWN + POOLS``
quotas for each shard. There are ``SHARDS`` shards, or as many more as keep one
below ``SHARD_WORDS`` words. The quotas are broadcast up to ``SMALL`` of them, else joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_A_FILE, WORD, materialize, table

# Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
OWN, POOLS = 256, 256
SHARDS = 64
SHARD_WORDS = 1 << 26
BLOCK_WORDS = 4096
SMALL = 5_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order, ranges: int, **sums: Column) -> DataFrame:
    """df with sums over all rows that come before each one in an order, none for the first.

    No task holds more than a range of the order; a row for each range is broadcast.
    """
    held = materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    until = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_ranges = held.groupBy("_range").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    starts = of_ranges.select("_range", *(F.coalesce(F.sum(k).over(until), F.lit(0)).alias(f"_{k}") for k in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = held.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in sums.items())).join(F.broadcast(starts), "_range")
    return placed.select(*df.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(_src, source_size, target), one row per source.

    Targets share ``share`` times all words by weight; a source that would get
    more than ``limit`` times its size stops there and the rest is shared
    again. With sources in order of limit / weight, the share for each unit of
    weight once the first k are at their limit is
    (total - limits so far) / weights left, and the largest of these holds.
    """
    each = materialize(sized.groupBy("_src", "_name").agg(F.sum("size").alias("source_size")))
    ranges = 1 + each.count() // ROWS_A_FILE
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    each = running(each, [F.asc_nulls_last("_name")], ranges, number=F.lit(1)).select("_src", "_name", "source_size", w.alias("w"))
    filled = materialize(running(each, [F.expr(f"{limit} * source_size / w"), F.asc_nulls_last("_name")], ranges, full=F.col("source_size"), weighed=F.col("w")))
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    unit = filled.agg(F.max((F.lit(share * (whole.size or 0)) - limit * F.col("full")) / (F.lit(whole.w or 1.0) - F.col("weighed")))).first()[0]
    target = F.least((limit * F.col("source_size")).cast("double"), F.col("w") * F.lit(unit or 0.0))
    return filled.select("_src", "source_size", target.alias("target"))


def splitting_tree(quotas: dict[str, int], shards: int, seed: int) -> dict[str, list[int]]:
    """Blocks of each source for each shard, with shards equal within one block.

    ``shards`` must be a power of two, and there must be fewer than 10**9
    blocks, the sampler's own limit. Reruns with equal quotas agree.
    """
    names = sorted(quotas)
    level = [np.array([quotas[s] for s in names], dtype=np.int64)]
    rng = np.random.default_rng(seed)
    while len(level) < shards:
        below = []
        for counts in level:
            left = rng.multivariate_hypergeometric(counts, int(counts.sum()) // 2, method="marginals")
            below += [left, counts - left]
        level = below
    return {s: [int(c[i]) for c in level] for i, s in enumerate(names)}


def plan_mix(docs: DataFrame, size: str, source: str = "source", key: str = "doc_id", shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """docs with source_size, target, taken and ``draws``.

    Columns that docs have by these four names are replaced; others pass
    through, whatever their names. ``taken`` is the sum of what shards draw.

    ``size`` names a long column with the size of each row. ``draws`` lists
    (copy, shard, words) of what the mix takes of the row: copies 0 and 1,
    fewer words than its size where the stream ends. Null sources are one
    source. Rows with null or repeated keys are rows like others; rows equal
    in key and size may swap their draws. Rows without words draw nothing, nor do
    those whose size is null. ``docs`` is read twice, and must give the same rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken", "draws")]
    tag = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long")
    place_in_hash = F.xxhash64(F.lit(seed), F.col(key), amount).alias("_order"), F.col(key).alias("_key"), amount.alias("size")
    # The row is kept apart, so that its columns may have any names.
    rows = docs.select(tag.alias("_src"), *place_in_hash, F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    narrow = docs.select(tag.alias("_src"), *place_in_hash, F.col(source).alias("_name"))
    dealt = materialize(narrow.repartitionByRange("_src", "_order").withColumn("_range", F.spark_partition_id()))

    sources = materialize(targets(dealt))
    words = sources.agg(F.coalesce(F.sum(F.rint("target").cast("long")), F.lit(0))).first()[0]
    while words // block_words > 5 * 10**8:
        block_words *= 2
    if shards is None:
        shards = max(SHARDS, 1 << (words // SHARD_WORDS).bit_length())
    sources = sources.withColumn("_blocks", F.ceil(F.rint("target") / block_words).cast("long"))
    blocks = sources.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]
    own = F.col("_blocks") * OWN > blocks
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64(F.lit(seed + 4), "_src"), F.lit(POOLS)).cast("string"))
    sources = sources.withColumn("_category", F.when(own, F.concat(F.lit("source "), "_src")).otherwise(pool))
    quotas = {r._category: r.n for r in sources.groupBy("_category").agg(F.sum("_blocks").alias("n")).collect()}
    tree = splitting_tree(quotas, shards, seed)
    ends = spark.createDataFrame([(c, np.cumsum(n).tolist()) for c, n in tree.items()], "_category string, _ends array<long>")
    if len(quotas) * shards <= SMALL:
        ends = F.broadcast(ends)
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(shards.bit_length() - 1))))

    def shard_at(block: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda k, s: F.when(F.element_at("_ends", k + s) <= block, k + s).otherwise(k))

    permuted = Window.partitionBy("_category").orderBy(F.xxhash64(F.lit(seed + 3), "_src", "_block"), "_src", "_block")
    pooled = sources.where(~own & (F.col("_blocks") > 0)).select("_src", "_category", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    pooled = pooled.withColumn("_at", F.row_number().over(permuted) - 1).join(ends, "_category")
    lists = pooled.select("_src", F.struct("_block", shard_at(F.col("_at")).alias("shard")).alias("_b")).groupBy("_src").agg(F.array_sort(F.collect_list("_b"))["shard"].alias("_list"))
    of_sources = sources.join(lists, "_src", "left").join(ends, "_category")

    per_range = dealt.groupBy("_src", "_range").agg(F.sum("size").alias("_start"))
    starts = per_range.withColumn("_start", F.sum("_start").over(Window.partitionBy("_src").orderBy("_range")) - F.col("_start"))
    within = Window.partitionBy("_src", "_range").orderBy("_order", F.asc_nulls_last("_key"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_in", F.sum("size").over(within) - F.col("size")).join(starts.join(of_sources, "_src"), ["_src", "_range"])
    want = F.rint("target").cast("long")

    def draw(copy: int) -> Column:
        at = F.col("_start") + F.col("_in") + copy * F.col("source_size")
        got = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), want - at))
        block = F.floor(at / block_words)
        shard = F.when(F.col("_list").isNull(), shard_at(block)).otherwise(F.get("_list", block.cast("int")))
        return F.when(got > 0, F.struct(F.lit(copy).alias("copy"), shard.alias("shard"), got.alias("words")))

    draws = F.array_compact(F.array(*(draw(c) for c in range(LIMIT))))
    drawn = placed.select("_src", "_order", "_key", "size", F.struct("source_size", "target", draws.alias("draws")).alias("_drawn"))
    # What was drawn and whole rows are numbered alike below their hash, and the n-th of both belong together.
    both = drawn.unionByName(rows, allowMissingColumns=True).repartition("_src", "_order")
    alike = Window.partitionBy("_src", "_order", F.col("_row").isNull()).orderBy(F.asc_nulls_last("_key"), "size")
    both = both.withColumn("_n", F.row_number().over(alike))
    out = both.withColumn("_drawn", F.first("_drawn", ignorenulls=True).over(Window.partitionBy("_src", "_order", "_n"))).where(F.col("_row").isNotNull())
    taken_words = F.aggregate("_drawn.draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), "_drawn.source_size", "_drawn.target", taken_words.alias("taken"), "_drawn.draws")


def draw_mix(planned: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """A row for each draw, dealt to its shard and shuffled within it.

    Rows of a shard lie together, in random order; ``shard`` and ``copy`` name
    the draw and ``words`` how many words of the row it takes.
    """
    names = [c for c in planned.columns if c not in ("draws", "copy", "shard", "words")]
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    rows = planned.select(row, F.col(key).alias("_key"), F.explode("draws").alias("_d"))
    rows = rows.select("_row", "_d.copy", "_d.shard", "_d.words", F.xxhash64(F.lit(seed + 2), F.col("_key"), "_d.copy", "_d.shard").alias("_shuffle"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "_shuffle")
    return dealt.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), "copy", "shard", "words")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return plan_mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))
