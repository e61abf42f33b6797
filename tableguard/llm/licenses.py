"""License scans: sparse TF-IDF cosine to templates, inherited by directory.

1. Headers. A text's terms (runs of letters and digits, so that line ends and
   comment marks do not count) are compared with notices window by window: a
   window has the notice's own number of terms, and its place follows from a
   term that both share. Only the heaviest terms of a notice ask for windows: a
   window with none of them cannot reach ``LEAST`` (the rest of the notice's
   vector is shorter than that), so none is lost.
2. Licence files, which their base name tells, are compared as a whole with
   complete licence texts too. Copies are weighed once.
3. Document frequencies of template terms are counted over all texts. Terms in
   no template weigh as much as the rarest, which only lowers a cosine.
4. A file without a licence of its own takes that of the nearest ancestor
   directory that has a licence file: directories are joined with those above
   them, and the deepest wins. Files then meet the result by their directory.

Templates are a fixed, small set, and so are the statistics made for them.
Tables by directory and by licence text are broadcast up to ``SMALL`` rows,
which are counted; larger ones are joined, directories by salted keys, because
a directory may hold a third of all files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, table

# Notices by which works refer to their licence.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0"),
}
FOLDER = Path(__file__).with_name("templates")
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"
LEAST = 0.75
SMALL = 200_000
SALTS = 32
_TERM = r"[a-z0-9]+"


def complete_texts(folder: Path = FOLDER) -> dict[str, str]:
    """Complete licence texts by name; each is a file of the folder."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted(Path(folder).glob("*.txt"))}


def _terms(s: str) -> list[str]:
    return re.findall(_TERM, s.lower())


def _found(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), F.lit(0))


def term_frequencies(texts: Column, docs: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each term of the vocabulary, in one pass."""
    asked = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in sorted(vocabulary | {""})], "term string"))
    each = docs.select(F.explode(F.concat(F.array_distinct(_found(texts)), F.array(F.lit("")))).alias("term"))
    n = {r.term: r.n for r in each.join(asked, "term").groupBy("term").agg(F.count("*").alias("n")).collect()}
    return n.pop("", 0), n


class Weights:
    """Weights of terms over n texts, and unit vectors of templates."""

    def __init__(self, texts: list[tuple[str, str]], n: int, df: dict[str, int]):
        self.texts = [(name, _terms(s)) for name, s in texts]
        self.rare = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, terms in self.texts for t in terms}

    def vector(self, terms: list[str]) -> dict[str, float]:
        v = {t: c * self.idf[t] for t, c in Counter(terms).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def asking(self, terms: list[str], least: float) -> set[str]:
        """The heaviest terms, without which a window cannot reach ``least``."""
        out, left = set(), 1.0
        for t, w in sorted(self.vector(terms).items(), key=lambda x: (-x[1], x[0])):
            if left < least * least - 1e-9:
                break
            out.add(t)
            left -= w * w
        return out


def _best_notice(text: Column, notices: Weights, least: float) -> Column:
    """(score, license) of the best window and notice; smaller names win ties; null without windows."""
    asks: dict[str, list[tuple[int, int]]] = {}
    for k, (_, terms) in enumerate(notices.texts):
        for t in notices.asking(terms, least):
            asks.setdefault(t, []).extend((k, at) for at, x in enumerate(terms) if x == t)
    places = F.create_map(*(F.lit(t) if c == 0 else F.array(*(F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in v)) for t, v in sorted(asks.items()) for c in (0, 1)))
    idf = F.create_map(*(F.lit(x) for t, w in sorted(notices.idf.items()) for x in (t, w)))
    kinds = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(terms)).alias("m"), F.create_map(*(F.lit(x) for t, w in sorted(notices.vector(terms).items()) for x in (t, w))).alias("w")) for name, terms in notices.texts))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("license"))

    def score(words: Column, at: Column) -> Column:
        kind = F.element_at(kinds, at["k"] + 1)
        low = F.greatest(at["start"], F.lit(0))
        here = F.slice(words, low + 1, F.greatest(kind["m"] + at["start"] - low, F.lit(0)))
        weighed = F.transform(F.array_distinct(here), lambda t: F.struct((F.size(F.filter(here, lambda u: u == t)) * F.coalesce(F.element_at(idf, t), F.lit(notices.rare))).alias("w"), F.coalesce(F.element_at(kind["w"], t), F.lit(0.0)).alias("o")))
        total = lambda f: F.aggregate(weighed, F.lit(0.0), lambda a, x: a + f(x))
        return F.struct(F.round(total(lambda x: x["w"] * x["o"]) / F.sqrt(total(lambda x: x["w"] * x["w"])), 9).alias("score"), kind["license"].alias("license"))

    def best(words: Column) -> Column:
        met = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(sorted(asks)))
        windows = F.array_distinct(F.flatten(F.transform(met, lambda i: F.transform(F.element_at(places, F.get(words, i)), lambda z: F.struct(z["k"].alias("k"), (i - z["o"]).alias("start"))))))
        return F.aggregate(F.transform(windows, lambda at: score(words, at)), none, _better)

    # Bound by a lambda, the terms of a text are found once.
    return F.element_at(F.transform(F.array(_found(text)), lambda words: F.when(F.size(words) > 0, best(words)).otherwise(none)), 1)


def _better(a: Column, b: Column) -> Column:
    """The one of two (score, license) with the higher score, then the smaller name."""
    return F.when(a["license"].isNull() | (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["license"] < a["license"])), b).otherwise(a)


def _best_text(files: DataFrame, whole: Weights) -> DataFrame:
    """(h, score, license): the best complete text for each of files (h, text), distinct by h."""
    spark = files.sparkSession
    idf = F.broadcast(spark.createDataFrame(sorted(whole.idf.items()), "term string, idf double"))
    of = F.broadcast(spark.createDataFrame([(t, name, w) for name, terms in whole.texts for t, w in sorted(whole.vector(terms).items())], "term string, license string, o double"))
    counts = files.select("h", F.explode(_found(F.col("text"))).alias("term")).groupBy("h", "term").agg(F.count("*").alias("c"))
    weighed = counts.join(idf, "term", "left").select("h", "term", (F.col("c") * F.coalesce("idf", F.lit(whole.rare))).alias("w"))
    norms = weighed.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(of, "term").groupBy("h", "license").agg(F.sum(F.col("w") * F.col("o")).alias("dot"))
    scored = dots.join(norms, "h").select("h", (-F.round(F.col("dot") / F.col("norm"), 9)).alias("s"), "license")
    return scored.groupBy("h").agg(F.min(F.struct("s", "license")).alias("b")).select("h", (-F.col("b.s")).alias("score"), F.col("b.license").alias("license"))


def _directories(path: Column) -> Column:
    """The directories above a path, with the empty one for the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan_licenses(files: DataFrame, path: Column, text: str = "text", templates=TEMPLATES, texts: dict[str, str] | None = None, least: float = LEAST, small: int = SMALL) -> DataFrame:
    """files with license, score, origin (header, file or directory:<name>).

    ``license`` is the file's own best match of at least ``least``, else that of
    the nearest ancestor directory with a licence file; a directory with several
    takes the best score, then the smaller name. origin is null without any.
    Null and empty texts have no own licence; a row with a null path has no
    directory. Repeated rows are rows like others; texts of any length are read
    whole. Other columns pass through, whatever their names; license, score and
    origin are replaced. No rows, no rows.
    """
    base = files.drop("license", "score", "origin")
    taken = [*files.columns, "license", "score", "origin"]
    at, named, parent, h, salt = (fresh(n, taken) for n in ("path", "named", "parent", "h", "salt"))
    base = base.withColumn(at, path)
    base = base.withColumns({named: F.coalesce(F.regexp_like(F.element_at(F.split(at, "/"), -1), F.lit(FILE_NAME)), F.lit(False)), parent: F.regexp_replace(at, r"/?[^/]*$", "")})
    body = F.coalesce(F.col(text), F.lit(""))
    base = base.withColumn(h, F.when(F.col(named), F.xxhash64(body)).otherwise(F.xxhash64(at, body)))
    short = [(name, s) for name, v in sorted(templates.items()) for s in v]
    long = sorted((complete_texts() if texts is None else texts).items())
    n, df = term_frequencies(F.col(text), files, {t for _, s in short + long for t in _terms(s)})
    notices, whole = Weights(short, n, df), Weights(long, n, df)

    units = base.where(F.col(named)).select(F.col(h).alias("h"), body.alias("text")).dropDuplicates(["h"])
    by_text = materialize(_best_text(units, whole).where(F.col("score") >= least).select("h", F.struct("score", "license").alias("whole")))
    one = F.broadcast(by_text) if by_text.count() <= small else by_text

    def judged(rows: DataFrame, keep: list[Column]) -> DataFrame:
        """Rows with own: the best of notices and complete texts, if good enough."""
        met = rows.join(one, (rows[h] == one["h"]) & rows[named], "left")
        first = met.select(*keep, _best_notice(F.col(text), notices, least).alias("notice"), "whole")
        own = F.when(F.col("whole").isNull(), F.col("notice")).otherwise(_better(F.col("notice"), F.col("whole")))
        # A generator between: the score is not computed for each of its uses.
        each = first.withColumn("own", F.explode(F.array(own)))
        return each.withColumn("own", F.when(F.col("own.score") >= least, F.col("own"))).drop("notice", "whole")

    held = judged(base.where(F.col(named)), [F.col(parent).alias("dir")]).where("own IS NOT NULL")
    by_dir = materialize(held.groupBy("dir").agg(F.min(F.struct((-F.col("own.score")).alias("s"), F.col("own.license").alias("l"))).alias("best")))
    # Directories, not files, are joined with what lies above them.
    dirs = base.where(F.col(at).isNotNull()).select(F.col(parent).alias("parent")).distinct()
    above = dirs.select("parent", F.explode(F.array_distinct(F.concat(_directories(F.col("parent")), F.array("parent")))).alias("dir"))
    few = F.broadcast(by_dir) if by_dir.count() <= small else by_dir
    nearest = materialize(above.join(few, "dir").groupBy("parent").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "best")).alias("up")))
    rows = judged(base, [F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("row")])
    if nearest.count() <= small:
        up = rows.join(F.broadcast(nearest), F.col(f"row.{parent}") == nearest["parent"], "left")
    else:
        spread = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(f"row.{at}")), F.lit(SALTS)).cast("int"))
        up = salted.join(spread, (F.col(f"row.{parent}") == spread["parent"]) & (F.col(salt) == spread["salt"]), "left")
    own = F.col("own").isNotNull()
    return up.select(
        *(F.col(f"row.`{c}`").alias(c) for c in files.columns if c not in ("license", "score", "origin")),
        F.when(own, F.col("own.license")).otherwise(F.col("up.best.l")).alias("license"),
        F.when(own, F.col("own.score")).otherwise(-F.col("up.best.s")).alias("score"),
        F.when(own & F.col(f"row.{named}"), "file").when(own, "header").otherwise(F.concat(F.lit("directory:"), F.col("up.dir"))).alias("origin"),
    )


SPEAKS = r"\blicen[cs]ed?\b"


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence of each document.

    documents has no paths: they are dealt into folders source/lang/thousands of
    the id, and a text that speaks of a licence, however long, is a licence file
    of its folder.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    name = F.when(F.regexp_like(F.lower("text"), F.lit(SPEAKS)), F.lit("LICENSE-")).otherwise(F.lit("doc-"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.coalesce(name, F.lit("doc-")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return scan_licenses(docs, path).select("doc_id", "license", "score", "origin")


def oracle() -> str:
    """SQL for op10_license_scan."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({k}, {quoted(name)}, {quoted(' '.join(_terms(s)))})" for k, (name, s) in enumerate(rows))
    short, long = [(name, s) for name, v in sorted(TEMPLATES.items()) for s in v], sorted(complete_texts().items())
    total = "(SELECT count(*) FROM d)"
    weights = lambda t: f"SELECT k, license, term, c * idf / sqrt(sum((c * idf) ** 2) OVER (PARTITION BY k)) AS w FROM (SELECT k, license, term, count(*) AS c FROM {t} GROUP BY ALL) JOIN {t}i USING (term)"
    idf = lambda t: f"SELECT term, ln((1 + {total}) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM {t}) LEFT JOIN f USING (term)"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TERM}') AS w, coalesce(regexp_matches(lower(text), '{SPEAKS}'), false) AS named,
        concat_ws('/', source, lang, floor(doc_id / 1000)::BIGINT::VARCHAR) AS dir FROM documents),
    f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d) GROUP BY term),
    nt(k, license, terms) AS (VALUES {values(short)}), wt(k, license, terms) AS (VALUES {values(long)}),
    s AS (SELECT k, license, unnest(string_split(terms, ' ')) AS term, unnest(range(0, len(string_split(terms, ' ')))) AS o FROM nt),
    g AS (SELECT k, license, unnest(string_split(terms, ' ')) AS term FROM wt),
    si AS ({idf("s")}), gi AS ({idf("g")}), sw AS ({weights("s")}), gw AS ({weights("g")}),
    asks AS (SELECT k, term FROM sw QUALIFY coalesce(1 - sum(w * w) OVER (PARTITION BY k ORDER BY w DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) >= {LEAST * LEAST - 1e-9}),
    m AS (SELECT k, max(o) + 1 AS m FROM s GROUP BY k),
    p AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS i FROM d),
    win AS (SELECT DISTINCT p.doc_id, s.k, p.i - s.o AS b FROM p JOIN asks USING (term) JOIN s ON s.k = asks.k AND s.term = p.term),
    wide AS (SELECT doc_id, k, b, unnest(d.w[greatest(b, 0) + 1:b + m.m]) AS term FROM win JOIN m USING (k) JOIN d USING (doc_id)),
    ww AS (SELECT doc_id, k, b, term, count(*) * coalesce(any_value(idf), ln(1 + {total}) + 1) AS w FROM wide LEFT JOIN si USING (term) GROUP BY ALL),
    ns AS (SELECT doc_id, any_value(license) AS license, round(sum(ww.w * coalesce(sw.w, 0)) / sqrt(sum(ww.w * ww.w)), 9) AS score FROM ww LEFT JOIN sw USING (k, term) GROUP BY doc_id, k, b),
    fw AS (SELECT doc_id, term, count(*) * coalesce(any_value(idf), ln(1 + {total}) + 1) AS w FROM (SELECT doc_id, unnest(w) AS term FROM d WHERE named) LEFT JOIN gi USING (term) GROUP BY ALL),
    fn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM fw GROUP BY doc_id),
    fs AS (SELECT doc_id, license, round(sum(fw.w * gw.w) / any_value(norm), 9) AS score FROM fw JOIN gw USING (term) JOIN fn USING (doc_id) GROUP BY doc_id, license),
    own AS (SELECT * FROM (SELECT * FROM ns UNION ALL SELECT * FROM fs) WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
    up AS (SELECT dir, license, score FROM own JOIN d USING (doc_id) WHERE named QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1)
    SELECT doc_id, coalesce(own.license, up.license) AS license, coalesce(own.score, up.score) AS score,
      CASE WHEN own.license IS NOT NULL AND named THEN 'file' WHEN own.license IS NOT NULL THEN 'header' WHEN up.license IS NOT NULL THEN 'directory:' || dir END AS origin
    FROM d LEFT JOIN own USING (doc_id) LEFT JOIN up USING (dir)"""
