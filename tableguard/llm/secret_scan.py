"""Secret scans through a trigram inverted index.

1. Every rule's expression gives a Boolean trigram query (``trigrams``).
2. The index holds a posting (row key, trigram) for each trigram of any query
   that a row's lower-cased text contains.
3. Conjunctions are intersected by merging postings on the row key: a row is a
   candidate of a rule if its postings cover one of the rule's conjunctions.
4. Candidates are verified with the expression itself. Rules without mandatory
   trigrams are tried on all texts.

The row key is a 64-bit hash of id and text. Two rows that share it only share
candidates, which verification settles, so a collision never changes a result.
Postings carry no text. The one wide shuffle moves texts to their candidates,
by that key, so no source or copied text makes a task large: repeated rows
have one key each only if id and text are both equal, and a skewed join splits.
Only the rules are broadcast; their number is fixed by the caller.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table
from .trigrams import EVERYTHING, trigram_query


@dataclass(frozen=True)
class Rule:
    """``measured``: the group whose length must be at least ``least``."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


# The base kinds.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # A run that is long enough matches whole, so the least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Further kinds: private keys and tokens whose form names the issuer.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES
_CHUNK = 256


def _fold(pattern: str) -> str:
    """[aA] as a: the queries are in lower case, so both letters ask the same."""
    return re.sub(r"\[([a-z])([A-Z])\]", lambda m: m[1] if m[1].upper() == m[2] else m[0], pattern)


def rule_queries(rules=RULES) -> list[tuple[int, list[list[str]]]]:
    """(rule number, conjunctions) of every rule that has mandatory trigrams."""
    out = []
    for n, rule in enumerate(rules):
        q = trigram_query(_fold(rule.pattern))
        if q != EVERYTHING and all(q):
            out.append((n, sorted(sorted(c) for c in q)))
    return out


def postings(keyed: DataFrame, text: str, rules=RULES) -> DataFrame:
    """The inverted index over the rules' trigrams: (_key, trigram)."""
    vocabulary = sorted({t for _, q in rule_queries(rules) for c in q for t in c})
    low = F.col("_low")
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in vocabulary)))
    return keyed.select("_key", F.lower(text).alias("_low")).select("_key", F.explode(held).alias("trigram"))


def candidates(keyed: DataFrame, text: str, rules=RULES) -> DataFrame:
    """(_key, _rules): the numbers of the rules that may match the row; there may be any number of rules."""
    spark = keyed.sparkSession
    asked = [(n, k, t) for n, q in rule_queries(rules) for k, c in enumerate(q) for t in c]
    whole = [(n, k, len(c)) for n, q in rule_queries(rules) for k, c in enumerate(q)]
    clauses = spark.createDataFrame(asked, "rule int, clause int, trigram string")
    whole = spark.createDataFrame(whole, "rule int, clause int, full int")
    met = (
        postings(keyed, text, rules)
        .repartition("_key")
        .join(F.broadcast(clauses), "trigram")
        .groupBy("_key", "rule", "clause")
        .agg(F.size(F.collect_set("trigram")).alias("seen"))
        .join(F.broadcast(whole), ["rule", "clause"])
        .where("seen = full")
    )
    return met.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def _positions(found: Column, gaps: Column, measured: Column, least: int) -> Column:
    """Array of (start, end) of matches at least so long, in code points.

    Matches and the gaps between them alternate, so positions are running sums
    of their lengths. They are summed in chunks: time stays near linear.
    """
    steps = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("f"), measured.alias("m")),
        lambda x: F.struct(F.char_length(x["g"]).alias("g"), F.char_length(x["f"]).alias("f"), F.char_length(x["m"]).alias("m")),
    )
    spot = "array<struct<start:int,end:int,m:int>>"

    def one(acc, x):
        start = acc["pos"] + x["g"]
        end = start + x["f"]
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    def chunk(acc, c):
        inner = F.aggregate(c, F.struct(acc["pos"].alias("pos"), F.array().cast(spot).alias("out")), one)
        return F.aggregate(F.array(inner), acc, lambda a, x: F.struct(x["pos"].alias("pos"), F.concat(a["out"], F.array(x["out"])).alias("out")))

    chunks = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(_CHUNK)), lambda i: F.slice(steps, i, F.lit(_CHUNK)))
    spots = F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{spot}>").alias("out")), chunk)["out"])
    return F.when(F.size(found) > 0, F.filter(spots, lambda x: x["m"] >= least)).otherwise(F.array().cast(spot))


def _numbered(spots: Column, n: int) -> Column:
    return F.transform(spots, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["end"].alias("end")))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES) -> DataFrame:
    """The rows of docs with ``_spans``: array of (start, kind number, end).

    Spans are sorted by start, then kind as listed, then end. A null text is
    scanned as an empty one, one of any length whole; rows with null or repeated
    ids are all kept. Other columns pass through, whatever their names; only one
    that is called ``_spans`` is replaced. No rows, no rows.
    """
    names = [c for c in docs.columns if c != "_spans"]
    body = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(text).alias("_text"), F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    indexed = {n for n, _ in rule_queries(rules)}
    # The row holds the text: it is taken out again after the join, so texts move once.
    named = rows.select("_row", "_key").join(candidates(rows, "_text", rules), "_key", "left").withColumn("_text", F.col(f"_row.`{text}`"))
    none = F.array().cast("array<string>")

    def tried(n: int, found: Column) -> Column:
        if n not in indexed:
            return found
        return F.when(F.array_contains(F.coalesce(F.col("_rules"), F.array().cast("array<int>")), n), found).otherwise(none)

    def pieces(n: int, rule: Rule) -> list[Column]:
        """Gaps and, if need be, the measured groups; nothing where nothing was found."""
        some = F.size(f"_f{n}") > 0
        gaps = F.when(some, F.split(body, rule.pattern, -1)).otherwise(none).alias(f"_g{n}")
        return [gaps] + [F.when(some, F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.measured))).otherwise(none).alias(f"_m{n}")] * bool(rule.measured)

    found = named.select("*", *(tried(n, F.regexp_extract_all(body, F.lit(r.pattern), F.lit(0))).alias(f"_f{n}") for n, r in enumerate(rules)))
    cut = found.select("*", *(c for n, r in enumerate(rules) for c in pieces(n, r)))
    spots = (_numbered(_positions(F.col(f"_f{n}"), F.col(f"_g{n}"), F.col(f"_m{n}" if r.measured else f"_f{n}"), r.least), n) for n, r in enumerate(rules))
    return cut.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), F.array_sort(F.flatten(F.array(*spots))).alias("_spans"))


def _written(spans: Column, rules) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["n"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the spans that scan_secrets found; overlapping ones become one mark."""
    span = "array<struct<start:int,end:int>>"

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        apart = F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.when(F.size(acc) == 0, apart).when(x["start"] < last["end"], joined).otherwise(apart)

    spans = fresh("merged", scanned.columns)
    merged = scanned.withColumn(spans, F.aggregate("_spans", F.array().cast(span), merge))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    stops = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.char_length(text)))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    clean = F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(F.col(text))
    return merged.withColumn(text, clean).drop(spans, "_spans")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of base kinds, a digest of base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs)
    of = lambda n: F.size(F.filter("_spans", lambda x: x["n"] == n)).cast("long")
    base = F.filter("_spans", lambda x: x["n"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *(of(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)),
        F.sha2(_written(base, RULES), 256).alias("base_sha256"),
        _written(F.col("_spans"), RULES).alias("spans"),
    )


def _positions_sql(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""list_transform(range(1, len(m.{rule.kind}) + 1), lambda i: {{
        's': coalesce(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(m.{rule.kind}[1:i - 1], lambda g: length(g))), 0),
        'l': length(m.{rule.kind}[i]),
        'm': length({f"regexp_extract_all(t, '{pattern}', {rule.measured})" if rule.measured else f"m.{rule.kind}"}[i])}})"""


def oracle() -> str:
    found = ", ".join("'{}': regexp_extract_all(t, '{}')".format(r.kind, r.pattern.replace("'", "''")) for r in RULES)
    spots = ",\n".join(f"list_transform(list_filter({_positions_sql(r)}, lambda x: x.m >= {r.least}), lambda x: {{'start': x.s::BIGINT, 'n': {n}, 'end': (x.s + x.l)::BIGINT}})" for n, r in enumerate(RULES))
    names = ", ".join(f"'{r.kind}'" for r in RULES)
    written = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda x: [{names}][x.n + 1] || ':' || x.start || ':' || x.end), ','), '')"
    base = f"list_filter(s, lambda x: x.n < {len(BASE_RULES)})"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.n = {n}))::BIGINT AS n_{r.kind}" for n, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, t, {{{found}}} AS m FROM d),
    p AS (SELECT doc_id, list_sort(flatten([{spots}])) AS s FROM f)
    SELECT doc_id, {counts}, sha256({written(base)}) AS base_sha256, {written("s")} AS spans FROM p"""
