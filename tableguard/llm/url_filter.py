"""URL filters: rules on hosts and paths, and a character language model for all other URLs.

Two variable-order Markov models learn the characters of accepted and of rejected
URLs, which are those that a rule decides, each different URL once. A character's
probability after a context of up to ``ORDER`` characters is Witten-Bell's mix of
the context's own counts and the next shorter one's; contexts that a model has not
seen ``CONTEXT`` times are no branches of its tree, and the shorter one decides.
A URL's score is the difference of its log-likelihoods under both models for each
character. Every model weight is a whole number, so a score does not depend on the
order of sums. The threshold is calibrated on labelled URLs that the models have
not seen: it separates them with the least sum of both error rates.

A position's weight depends on its window alone, the character and its context.
So windows are counted once, weighed level by level in tables of different
windows, and joined to the positions of URLs. Each different URL is scored once,
under its hash: positions carry no text, and are added up where they are, before
anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ORDER = 4
CONTEXT = 2
WEIGHT = 1_000_000
STEP = 1000
START, END = "\x02", "\x03"
#: Windows in a broadcast table, about 50 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_ADDRESS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def hashed(url: Column) -> Column:
    return F.unhex(F.sha2(url, 256))


def matched(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, the first of equal length; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def windows(url: Column) -> Column:
    """For each character of a URL and its end, the character with its context."""
    cut = F.split(F.concat(F.lit(START * ORDER), url, F.lit(END)), "")
    at = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), lambda i: F.concat(*(F.get(c, i + k) for k in range(ORDER + 1))))
    # As a variable the characters are cut apart once, not again for each window.
    return F.get(F.transform(F.array(cut), at), F.lit(0))


def for_calibration(url: Column) -> Column:
    """Three sixteenths of all URLs, by hash."""
    return F.substring(F.sha2(url, 256), 1, 1).isin("0", "1", "2")


def weigh(labelled: DataFrame) -> DataFrame:
    """(window, weight) of every window of (url, accepted, held): its log-likelihood ratio in units of 1 / WEIGHT.

    Models learn from URLs whose label is not null and that are not held back for calibration.
    """
    learns = {n: F.when(~F.col("held") & (F.col("accepted") == k), 1).otherwise(0).alias(n) for n, k in (("a", True), ("r", False))}
    seen = labelled.select(F.explode(windows(F.col("url"))).alias("window"), *learns.values())
    counts = materialize(seen.groupBy("window").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    below = None
    for k in range(1, ORDER + 2):
        grams = counts.groupBy(F.substring("window", -k, k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        # A context's characters are few, whatever the number of URLs.
        context = Window.partitionBy(F.substring("gram", 1, k - 1))
        grams = grams.select("gram", *(c.alias(n + s) for n in "ar" for s, c in (("", F.col(n)), ("n", F.sum(n).over(context)), ("t", F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).over(context)))), F.count("*").over(context).alias("v"))
        if below is None:
            grams = grams.withColumns({f"{n}p": 1.0 / F.col("v") for n in "ar"})
        else:
            grams = grams.withColumn("under", F.substring("gram", 2, k - 1)).join(below, "under")
        mixed = {n: F.when(F.col(f"{n}n") >= CONTEXT, (F.col(n) + F.col(f"{n}t") * F.col(f"{n}p")) / (F.col(f"{n}n") + F.col(f"{n}t"))).otherwise(F.col(f"{n}p")) for n in "ar"}
        below = grams.select(F.col("gram").alias("under"), *(mixed[n].alias(f"{n}p") for n in "ar"))
    ratio = F.round((F.log("ap") - F.log("rp")) * WEIGHT).cast("long")
    return materialize(below.select(F.col("under").alias("window"), ratio.alias("weight")))


def scored(urls: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """(keys, score): the mean weight of each url's windows in thousandths, rounded down; short keys tell urls apart."""
    small = weights.count() <= BROADCAST_ROWS
    places = urls.select(*keys, F.explode(windows(F.col("url"))).alias("window")).join(F.broadcast(weights) if small else weights, "window")
    mean = F.sum("weight") / (F.count("*") * (WEIGHT // STEP))
    return places.groupBy(*keys).agg(F.floor(mean).alias("score"))


def threshold(labelled: DataFrame, weights: DataFrame) -> int | None:
    """The score from which URLs are accepted; None where one kind has no URL to learn from.

    Where one kind has none to calibrate on, it is 0. Of equally good thresholds,
    those between two scores included, the one nearest to 0 is taken, of two the smaller.
    """
    known = labelled.where("accepted IS NOT NULL").select("hash", "url", "accepted", "held")
    sizes = {(r.accepted, r.held): r.n for r in known.groupBy("accepted", "held").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get((True, False)) and sizes.get((False, False))):
        return None
    if not (sizes.get((True, True)) and sizes.get((False, True))):
        return 0
    # As many rows as there are different scores: tens of thousands at most.
    counts = scored(known.where("held"), weights, "hash", "accepted").groupBy("score").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    before = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    errors = F.coalesce(F.sum("a").over(before), F.lit(0)) / sizes[True, True] + (sizes[False, True] - F.coalesce(F.sum("r").over(before), F.lit(0))) / sizes[False, True]
    # From the score below it to its own, a score's errors are those of any threshold.
    nearest = F.least("score", F.greatest(F.lit(0), F.lag("score").over(Window.orderBy("score")) + 1))
    return counts.select(nearest.alias("least"), errors.alias("e")).orderBy("e", F.abs("least"), "least").first()["least"]


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; score only where the model decides.

    A null URL, or one without ``://``, has an empty host and path and meets no
    rule. Null and empty URLs are allowed: they hold no character to object to, and have no score. So are all
    without a rule if rules accept or reject no URL that the models may learn
    from. Repeated rows and keys stay as they are, an empty table stays empty,
    and further columns, whatever their names, are not looked at.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    c = lambda name: F.col(names[df.columns.index(name)])
    rows = df.toDF(*names).select(c(key).alias("key"), F.coalesce(c(url), F.lit("")).alias("url"))
    rows = rows.select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", matched(F.col("host"), F.col("path"), rules).alias("m"))
    labelled = rows.where("url <> ''").groupBy("url").agg((F.first("m.verdict") == "allow").alias("accepted"))
    # Written, so that hash and fold are made once for a URL and not again for each of its windows.
    labelled = materialize(labelled.select("*", hashed(F.col("url")).alias("hash"), for_calibration(F.col("url")).alias("held")))
    weights = weigh(labelled)
    least = threshold(labelled, weights)
    own = [F.col("key").alias(key), "host", "path", "m.rule"]
    if least is None:
        return rows.select(*own, F.coalesce("m.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("score"))
    ruled = F.col("m").isNotNull() | (F.col("url") == "")
    closed = rows.where(ruled).select(*own, F.coalesce("m.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("score"))
    found = scored(labelled.where("accepted IS NULL"), weights, "hash")
    judged = rows.where(~ruled).withColumn("hash", hashed(F.col("url"))).join(found, "hash")
    return closed.unionByName(judged.select(*own, F.when(F.col("score") >= least, "allow").otherwise("block").alias("verdict"), "score"))


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    """Each page's host and path, the rule that fits, and the verdict."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """Counts, levels, threshold and verdicts; every window looked up for itself."""
    rule = "CASE {} END"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    cases = lambda k: rule.format(" ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits))
    levels = []
    for k in range(1, ORDER + 2):
        over = f"OVER (PARTITION BY g[1:{k - 1}])" if k > 1 else "OVER ()"
        mixed = ", ".join(f"CASE WHEN {n}n >= {CONTEXT} THEN ({n} + {n}k * {n}p) / ({n}n + {n}k) ELSE {n}p END AS {n}p" for n in "ar")
        levels.append(f"g{k} AS (SELECT right(w, {k}) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1)")
        levels.append(f"n{k} AS (SELECT g, " + ", ".join(f"{n}::DOUBLE AS {n}, (sum({n}) {over})::DOUBLE AS {n}n, (count(*) FILTER ({n} > 0) {over})::DOUBLE AS {n}k" for n in "ar") + f", (count(*) {over})::DOUBLE AS v FROM g{k})")
        source = f"(SELECT *, 1 / v AS ap, 1 / v AS rp FROM n{k})" if k == 1 else f"(SELECT n.*, b.ap, b.rp FROM n{k} n JOIN b{k - 1} b ON b.g = right(n.g, {k - 1}))"
        levels.append(f"b{k} AS MATERIALIZED (SELECT g, {mixed} FROM {source})")
    padded = f"repeat(chr(2), {ORDER}) || url || chr(3)"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '{_ADDRESS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{_ADDRESS}', 2) AS path FROM pages),
    m AS (SELECT *, {cases(1)} AS rule, {cases(2)} AS ruled FROM p),
    u AS MATERIALIZED (SELECT url, any_value(ruled) AS ruled, substr(sha256(url), 1, 1) IN ('0', '1', '2') AS held FROM m WHERE url <> '' GROUP BY url),
    x AS MATERIALIZED (SELECT url, ruled, held, substr({padded}, i, {ORDER + 1}) AS w FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM u)),
    c AS MATERIALIZED (SELECT w, count(*) FILTER (NOT held AND ruled = 'allow') AS a, count(*) FILTER (NOT held AND ruled = 'block') AS r FROM x GROUP BY w),
    {", ".join(levels)},
    k AS (SELECT g, round((ln(ap) - ln(rp)) * {WEIGHT})::BIGINT AS weight FROM b{ORDER + 1}),
    s AS MATERIALIZED (SELECT url, any_value(ruled) AS ruled, any_value(held) AS held, floor(sum(weight)::DOUBLE / (count(*) * {WEIGHT // STEP}))::BIGINT AS score FROM x JOIN k ON k.g = x.w GROUP BY url),
    z AS (SELECT score, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS r FROM s WHERE held AND ruled IS NOT NULL GROUP BY score),
    t AS (SELECT score FROM (SELECT least(score, greatest(0, lag(score) OVER (ORDER BY score) + 1)) AS score, coalesce(sum(a) OVER q, 0)::DOUBLE / (SELECT sum(a) FROM z)::DOUBLE + ((SELECT sum(r) FROM z) - coalesce(sum(r) OVER q, 0))::DOUBLE / (SELECT sum(r) FROM z)::DOUBLE AS e FROM z WINDOW q AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) ORDER BY e, abs(score), score LIMIT 1),
    y AS (SELECT count(DISTINCT ruled) FILTER (NOT held) AS learnt, count(DISTINCT ruled) FILTER (held) AS tried FROM u)
    SELECT page_id, host, path, rule, coalesce(m.ruled, CASE WHEN s.score < (SELECT CASE WHEN learnt < 2 THEN NULL WHEN tried < 2 THEN 0 ELSE (SELECT score FROM t) END FROM y) THEN 'block' ELSE 'allow' END) AS verdict FROM m LEFT JOIN s ON s.url = m.url"""
