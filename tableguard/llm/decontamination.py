"""Benchmark decontamination with spaced seeds.

A seed is the hash of the tokens at the kept positions of a fixed mask; the
positions it skips may hold any token. Test and training seeds are joined, and
around each hit the two token sequences are compared along the diagonal: the
overlap counts if some window has enough equal tokens in place, so that single
substitutions do not hide a copy. Of twelve tokens two may differ, of an item of
nine to eleven tokens one; the masks are such that wherever these lie, some mask
at some place skips them all, so no overlap is without a seed. An item of fewer
tokens counts only where it stands whole: its seed is the hash of all of it.

Tokens are lower-cased runs of letters and digits. A benchmark of up to
``SMALL`` tokens is broadcast after that size has been counted, and every text
stays in its row: no shuffle but of verified hits. A larger one is joined by
shuffling seeds, and texts meet only the hits they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: The positions that each mask keeps. What they skip is disjoint and covers all nine.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 3, 4, 5, 6, 8), (1, 2, 3, 5, 6, 7))
SPAN = 9
WINDOW = 12
EQUAL = 10
SMALL = 200_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _seeds(df: DataFrame, at: str, short=(), whole: bool = False) -> DataFrame:
    """A row for each place and seed: a mask's, and those of all tokens of each short length.

    With ``whole``, short seeds are only those of rows of just that length.
    Generators and the join on the seed compile into one loop over a text,
    which then holds the token array once; rows carry no tokens until they hit.
    """
    size, least = F.size("_w"), min((SPAN, *short))
    placed = df.withColumn(at, F.explode(F.slice(F.sequence(F.lit(0), size), F.lit(1), F.greatest(size - least + 1, F.lit(0)))))
    here = F.col(at)
    hashed = lambda tag, keep: F.xxhash64(F.lit(tag), *(F.get("_w", here + p) for p in keep))
    seeds = F.array(*(hashed(m, mask) for m, mask in enumerate(MASKS)))
    if short:
        long = (F.when(here + SPAN <= size, hashed(m, mask)) for m, mask in enumerate(MASKS))
        fits = lambda n: (size == n) & (here == 0) if whole else here + n <= size
        # Those that do not fit are null and meet nothing.
        seeds = F.array(*long, *(F.when(fits(n), hashed(-n, range(n))) for n in short))
    return placed.withColumn("_seed", F.explode(seeds))


def _around(tokens: Column, at: Column) -> tuple[Column, Column]:
    """The tokens near a place that its windows can reach, and the place in them."""
    before = F.least(at, F.lit(WINDOW - SPAN))
    return F.slice(tokens, at - before + 1, before + WINDOW), before


def _overlaps(w: Column, item: Column, i: Column, j: Column, size: Column) -> Column:
    """Whether the tokens around w[i] and item[j] agree in some window.

    Items of fewer tokens than a window must agree over their whole length,
    those of fewer than a seed spans in every token.
    """
    shift = i - j
    low = F.greatest(F.lit(0), -shift, j + SPAN - WINDOW)
    high = F.least(F.size(item), F.size(w) - shift, j + WINDOW)
    width = F.least(F.lit(WINDOW), size)
    need = F.when(size < SPAN, size).otherwise(F.ceil(width * EQUAL / WINDOW))
    same = F.transform(F.sequence(low, high - 1), lambda x: F.when(F.get(w, x + shift) == F.get(item, x), 1).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    ok = F.exists(F.sequence(F.lit(1), high - low - width + 1), lambda s: total(F.slice(same, s, width)) >= need)
    return F.when(high - low >= width, ok).otherwise(F.lit(False))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", small: int = SMALL) -> DataFrame:
    """Rows (key, _key, item_id, seeds, first_token, last_token) of leaks.

    ``_key`` is a hash of key and text: rows equal in both count once, and a
    null key is a key like others. Null texts and items, and those without
    tokens, never match. Items equal in id and text count once more for each
    row only in work, not in the result. Other columns of docs take no part.
    """
    keyed = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(key), F.col(text)).alias("_key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    items = benchmark.select(F.col(item_key).alias("item_id"), tokens(F.coalesce(F.col(item_text), F.lit(""))).alias("_w"))
    sizes = items.groupBy(F.size("_w").alias("n")).agg(F.count("*").alias("items")).agg(F.sum(F.col("n") * F.col("items")), F.sort_array(F.collect_set(F.when(F.col("n").between(1, SPAN - 1), F.col("n"))))).first()
    short = tuple(sizes[1])
    near, j = _around(F.col("_w"), F.col("_j"))
    ours = _seeds(items, "_j", short, whole=True).select("_seed", "item_id", F.size("_w").alias("_size"), near.alias("_item"), j.alias("_ij"), "_j")
    theirs = _seeds(keyed, "_i", short)
    near, i = _around(F.col("_w"), F.col("_i"))
    if (sizes[0] or 0) <= small:
        hits = theirs.join(F.broadcast(ours), "_seed")
    else:
        met = theirs.select("_id", "_key", "_i", "_seed").join(ours.drop("_j"), "_seed").drop("_seed")
        texts = keyed.dropDuplicates(["_id", "_key"])
        hits = met.join(texts, met["_id"].eqNullSafe(texts["_id"]) & (met["_key"] == texts["_key"])).select(met["*"], "_w")
    # Generated rows keep the check out of the join, whose loop compiles without it.
    each = F.struct("_size", "_item", "_ij", near.alias("_near"), i.alias("_at"))
    cut = hits.select("_id", "_key", "item_id", "_i", F.explode(F.array(each)).alias("_h"))
    found = cut.where(_overlaps(*(F.col(f"_h.{c}") for c in ("_near", "_item", "_at", "_ij", "_size"))))
    return found.groupBy(F.col("_id").alias(key), "_key", "item_id").agg(
        F.count_distinct("_i").alias("seeds"), F.min("_i").cast("long").alias("first_token"), F.max(F.col("_i") + F.least(F.col("_h._size"), F.lit(SPAN)) - 1).cast("long").alias("last_token")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that overlap with an item of the benchmark.

    All columns pass through, whatever their names; nulls, repeated rows and
    empty tables as in ``find_overlaps``.
    """
    own = fresh("own", [*docs.columns, "_id", "_key"])
    leaks = find_overlaps(docs, benchmark, text, key).select(F.col(key).alias("_id"), "_key").distinct()
    mine = docs.withColumn(own, F.xxhash64(F.col(key), F.col(text)))
    return mine.join(leaks, (mine[own] == leaks["_key"]) & mine[key].eqNullSafe(leaks["_id"]), "left_anti").drop(own)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_overlaps(docs, table(spark, sf_dir, "benchmark")).drop("_key")


def oracle() -> str:
    split = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w != '')"
    seeds = "[" + ", ".join(f"'{m}|' || " + " || ' ' || ".join(f"w[i + {p + 1}]" for p in mask) for m, mask in enumerate(MASKS)) + "]"
    places = lambda t: f"SELECT *, unnest({seeds}) AS seed FROM (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM {t})"
    return f"""WITH d AS (SELECT doc_id, {split} AS w FROM documents), b AS (SELECT item_id, {split} AS w FROM benchmark),
    ds AS ({places("d")}), bs AS ({places("b")}),
    h AS (SELECT DISTINCT doc_id, item_id, ds.i AS i, bs.i AS j, ds.w AS w, bs.w AS v FROM ds JOIN bs USING (seed)),
    r AS (SELECT *, greatest(0, j - i, j - {WINDOW - SPAN}) AS lo, least(len(v), len(w) - i + j, j + {WINDOW}) AS hi, least({WINDOW}, len(v)) AS n FROM h),
    e AS (SELECT *, list_transform(range(lo, hi), lambda x: (w[x + i - j + 1] = v[x + 1])::INT) AS same FROM r),
    ok AS (SELECT * FROM e WHERE hi - lo >= n AND list_bool_or(list_transform(range(1, hi - lo - n + 2), lambda s: list_sum(same[s:s + n - 1]) >= ceil(n * {EQUAL} / {WINDOW})))),
    g AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {SPAN - 1}))),
    whole AS (SELECT DISTINCT doc_id, item_id, i, n FROM g JOIN (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS gram FROM b) USING (n, gram)),
    found AS (SELECT doc_id, item_id, i, {SPAN} AS n FROM ok UNION ALL SELECT doc_id, item_id, i, n FROM whole)
    SELECT doc_id, item_id, count(DISTINCT i)::BIGINT AS seeds, min(i)::BIGINT AS first_token, max(i + n - 1)::BIGINT AS last_token FROM found GROUP BY doc_id, item_id"""
