import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableguard.llm import licenses as lic

MIT, APACHE, GPL = (lic.TEMPLATES[k][0] for k in ("MIT", "Apache-2.0", "GPL-3.0"))


def brute(files, texts):
    """(license, score, origin) of each (path, text), by plain loops over every window."""
    terms = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    n, df = len(files), Counter(t for _, x in files for t in set(terms(x)))

    def vector(s, vocabulary):
        v = {t: c * (math.log((1 + n) / (1 + (df[t] if t in vocabulary else 0))) + 1) for t, c in Counter(s).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def cosine(a, b):
        return round(sum(w * b.get(t, 0) for t, w in a.items()), 9)

    short = [(k, terms(s)) for k, v in lic.TEMPLATES.items() for s in v]
    long = [(k, terms(s)) for k, s in texts.items()]
    words = {t for _, s in short for t in s}, {t for _, s in long for t in s}

    def own(path, text):
        named, w, scores = bool(path and re.match(lic.FILE_NAME, path.split("/")[-1])), terms(text), []
        for k, s in short:
            v = vector(s, words[0])
            for at in range(1 - len(s), len(w)):
                here = w[max(0, at) : at + len(s)]
                if set(here) & set(s):
                    scores.append((-cosine(vector(here, words[0]), v), k))
        if named and w:
            scores += [(-cosine(vector(w, words[1]), vector(s, words[1])), k) for k, s in long]
        best = min(scores, default=(0, None))
        return (best[1], -best[0], named) if -best[0] >= lic.LEAST else None

    found = [own(*f) for f in files]
    dirs = {}
    for (path, _), o in zip(files, found):
        if o and o[2]:
            d = path.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, (0, "~")), (-o[1], o[0]))
    out = []
    for (path, _), o in zip(files, found):
        if o:
            out.append((o[0], o[1], "file" if o[2] else "header"))
            continue
        up = path.rpartition("/")[0] if path is not None else None
        while up is not None and up not in dirs:
            up = up.rpartition("/")[0] if up else None
        out.append((dirs[up][1], -dirs[up][0], f"directory:{up}") if up is not None else (None, None, None))
    return out


TEXTS = lic.complete_texts()
GPL_HEADER = """# This program is free software: you can redistribute it
# and/or modify it under the terms of the GNU General Public
# License as published by the Free Software Foundation, either
# version 3 of the License, or (at your option) any later version.
"""
BSD_HEADER = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
FILES = [
    ("LICENSE", MIT), ("a/LICENSE.txt", lic.TEMPLATES["Apache-2.0"][1]), ("a/COPYING", GPL), ("a/b/c/d.py", "no words on rights"), ("a/b/x.py", "# " + GPL + "\nprint(1)"), ("q.py", None),
    ("ab/y.py", "text"), ("a/b/LICENSE", "a license that is like none of them, all rights are with nobody at all in this place"), ("z/e.py", ""), (None, "no path"), (None, MIT),
    ("t.py", "one\r\n" + APACHE + "\r\n" + MIT), ("deep/" * 40 + "f.py", "x"), ("long.py", "word " * 3_000 + "\n" + MIT), ("tie.py", "license license"),
    ("m/LICENSE", TEXTS["MIT"].replace("MIT License", "Copyright (c) 2020 Some One")), ("m/src/x.c", "int x;"), ("p/LICENSE", TEXTS["Apache-2.0"]), ("p/x.c", "int y;"), ("g/COPYING", TEXTS["GPL-3.0"]), ("g/h/x.c", "int z;"),
    ("h1.py", "x\n" + GPL_HEADER + "import os"), ("h2.c", "/*\n" + BSD_HEADER + "*/ int a;"), ("h3.js", MPL_HEADER + "let a"), ("h4.txt", "some words before it " + " ".join(TEXTS["MIT"].split()) + " and after it"), ("h5.md", "pictures: CC BY 4.0"),
]


@pytest.mark.parametrize("small", [lic.SMALL, 0])
def test_against_brute_force(spark, small):
    rows = FILES + FILES[:2]
    df = spark.createDataFrame([(p, t, 1, 2) for p, t in rows], "path string, text string, score int, _path int")
    found = lic.scan_licenses(df, F.col("path"), small=small)
    assert found.columns == ["path", "text", "_path", "license", "score", "origin"]
    got = found.collect()
    want = Counter(repr((p, w[0], w[1] and round(w[1], 7), w[2])) for (p, _), w in zip(rows, brute(rows, TEXTS)))
    assert Counter(repr((r.path, r.license, r.score and round(r.score, 7), r.origin)) for r in got) == want
    have = {r.path: (r.license, r.origin) for r in got}
    assert [have[f"h{k}"][0] for k in ("1.py", "2.c", "3.js", "4.txt", "5.md")] == ["GPL-3.0", "BSD-3-Clause", "MPL-2.0", "MIT", "CC-BY-4.0"]
    assert have["m/src/x.c"] == ("MIT", "directory:m") and have["p/x.c"] == ("Apache-2.0", "directory:p") and have["g/h/x.c"] == ("GPL-3.0", "directory:g")
    assert have["p/LICENSE"] == ("Apache-2.0", "file") and have["a/b/c/d.py"][1] == "directory:a"


def test_documents(spark, data):
    """Every document with a notice has its licence, and inheritance reaches others."""
    got = {r.doc_id: r for r in lic.op10_license_scan(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    for r in docs:
        line = next((x for x in r.text.split("\n") if re.search("(?i)licen[cs]ed?", x)), None)
        assert (got[r.doc_id].origin in ("file", "header")) == (line is not None)
        if line:
            assert got[r.doc_id].license == next(k for k, v in lic.TEMPLATES.items() if line in v)
    assert any((r.origin or "").startswith("directory:") for r in got.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "path string, text string")
    assert lic.scan_licenses(df, F.col("path")).count() == 0


def test_oracle(spark, data, duck):
    from tableguard.llm import queries
    from tests.conftest import same_rows

    same_rows(lic.op10_license_scan(spark, data), duck.execute(queries.oracle_sql()["op10_license_scan"]))


def test_complete_texts_decide_in_the_query(spark, tmp_path):
    """Whole licence texts of any length among the documents, judged by the query and by its SQL."""
    import duckdb

    from tableguard.llm import queries
    from tests.conftest import same_rows

    texts = lic.complete_texts()
    long = max(texts, key=lambda k: len(texts[k]))
    rows = [(k, t, "s", "en") for k, t in enumerate([texts["MIT"], "plain words here", texts[long], "more words"])] + [(2000, "far away", "s", "en"), (3, None, "t", "de")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(path)
    got = {(r.doc_id, r.origin): (r.license, r.score) for r in lic.op10_license_scan(spark, str(tmp_path)).collect()}
    assert got[0, "file"][0] == "MIT" and got[2, "file"][0] == long and got[2, "file"][1] > 0.99 and len(texts[long]) > 30_000
    assert (1, "directory:s/en/0") in got and (2000, None) in got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    same_rows(lic.op10_license_scan(spark, str(tmp_path)), con.execute(queries.oracle_sql()["op10_license_scan"]))
