import re

import numpy as np
import pytest

from tableguard.llm import decontamination as dc
from tableguard.llm import queries


def brute(docs, items):
    """Pairs that agree in some window along some diagonal, by comparing everything, without seeds."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in docs:
        w = cut(text)
        where = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        for k, item in items:
            v = cut(item)
            n = min(12, len(v))
            need = n if len(v) < 9 else -(-n * 10 // 12)
            for shift in {i - j for j, x in enumerate(v) for i in where.get(x, ())}:
                same = [0 <= x + shift < len(w) and w[x + shift] == v[x] for x in range(len(v))]
                inside = [0 <= x + shift < len(w) for x in range(len(v))]
                if n and any(all(inside[s : s + n]) and sum(same[s : s + n]) >= need for s in range(len(v) - n + 1)):
                    out.add((d, k))
    return out


def test_masks_leave_no_overlap_without_a_seed():
    """Any two substitutions in twelve tokens, and any one in nine, are skipped by a mask at some place."""
    at = [[p + m for m in mask] for mask in dc.MASKS for p in range(12 - dc.SPAN + 1)]
    assert all(any(not {a, b} & set(places) for places in at) for a in range(12) for b in range(12))
    assert all(any(a not in mask for mask in dc.MASKS) for a in range(9))
    assert all(len(set(m)) == 6 and max(m) < dc.SPAN for m in dc.MASKS)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(4)
    word = lambda n: list(rng.choice([f"w{k}" for k in range(300)] + ["the"] * 60, n))
    items = [(k, " ".join(word(int(rng.integers(8, 60))))) for k in range(30)] + [(98, "too short to tell"), (99, None), (97, ""), (96, "What is the capital of France?"), (95, "single"), (94, "漢字一続きの文")]
    items += [(100 + n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (5, 8, 9, 10, 11, 12, 15)]
    docs = []
    for d in range(60):
        text, item = word(80), items[d % 30][1].split()
        if d % 2:
            passage = [w if rng.random() > 0.08 or d % 4 == 1 else "changed" for w in item]
            text[30:30] = [w.upper() + "," for w in passage]
        docs.append((d, " ".join(text)))
    docs += [(200, "Now: what is the capital of france, too short to"), (201, "what is the new capital of france"), (202, "single"), (203, "before 漢字一続きの文 after"), (204, "singles")]
    for n in (5, 8, 9, 10, 11, 12, 15):  # one word, and two, changed anywhere
        whole = [f"i{n}x{k}" for k in range(n)]
        changes = [{a, b} for a in range(n) for b in range(a, n)]
        docs += [(1000 * n + c, " ".join(["x", *("y" if k in gone else t for k, t in enumerate(whole)), "z"])) for c, gone in enumerate(changes)]
    docs += [(100, None), (101, ""), (102, items[3][1]), (None, items[4][1]), (103, " ".join(word(20_000)) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("small", [dc.SMALL, 0])
def test_against_brute_force(spark, tables, small):
    docs, items = tables
    got = dc.find_overlaps(spark.createDataFrame([(a, b, 0) for a, b in docs + docs[:3]], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), small=small)
    pairs = [(r.doc_id, r.item_id) for r in got.collect()]
    want = brute([d for d in docs if d[0] != 103], items)
    assert sorted(map(repr, (p for p in pairs if p[0] != 103))) == sorted(map(repr, want))
    assert (103, 5) in pairs and (None, 4) in pairs and len(want) > 25 and {(200, 96), (202, 95), (203, 94)} <= want


def test_decontaminate(spark, tables):
    docs, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = dc.decontaminate(spark.createDataFrame(docs + docs[:2], "doc_id long, text string"), benchmark).collect()
    bad = {d for d, _ in brute([d for d in docs if d[0] != 103], items)} | {103}
    assert sorted(repr(r.doc_id) for r in left) == sorted(repr(d) for d, _ in docs + docs[:2] if d not in bad)


def test_oracle_of_short_items(spark, tables):
    """The SQL agrees on items of every length."""
    import duckdb
    import pandas as pd

    from tests.conftest import same_rows

    docs, items = tables
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.register(name, pd.DataFrame(rows, columns=[key, "text"]).astype({key: "Int64"}))
    found = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    same_rows(found.drop("_key"), con.execute(dc.oracle()))


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "what is it", 5, 6), (2, "nothing", 7, 8)], "doc_id long, text string, _own int, _key int")
    items = spark.createDataFrame([(1, "What is it?")], "item_id long, text string")
    left = dc.decontaminate(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "nothing", 7, 8)]


def test_oracle(spark, data, duck):
    from tests.conftest import same_rows

    same_rows(dc.op7_decontamination(spark, data), duck.execute(queries.oracle_sql()["op7_decontamination"]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert dc.find_overlaps(none, items).count() == 0
    assert dc.find_overlaps(some, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert dc.decontaminate(some, items).count() == 0
