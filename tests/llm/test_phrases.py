import random
import re
from collections import Counter, defaultdict

import pytest

from tableguard.llm import phrases, queries

from ..conftest import same_rows


def brute(rows, max_n=3, least=10, contained=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by plain loops over (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in found.items():
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * b >= contained * a and inside(q) for q, b in found.items()):
                listed.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(listed)[:top], 1)]
    return sorted(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c\x00", "c", "c\x01", "\x1fé", "Éa", "ß", "dd", "hot"]
    text = lambda: "".join(rng.choice(words[: rng.randint(1, 10)]) + rng.choice([" ", " ", " ", "\t ", ".", ",", "\n", "\x0b", "; ", " "]) for _ in range(rng.randint(0, 40)))
    rows = [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" .,\n", "fr"), ("x", "xx")] + [("hot pair here. hot pair there", "en")] * 40


@pytest.mark.parametrize("max_n, parts, block", [(3, None, 1 << 20), (3, 20, 1000), (2, 3, 300), (4, 10, 2000)])
def test_equal_to_plain_loops(spark, monkeypatch, max_n, parts, block):
    """Whatever the blocks, and whether heavy prefixes are dealt out or not."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rows = some_texts(max_n, 150)
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, N int").repartition(5)
    got = phrases.collocations(df, max_n=max_n, least=4, contained=70, top=60, parts=parts)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, max_n, 4, 70, 60)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_heavy_prefixes_are_found_and_dealt_by_more_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    rows = [(f"the cat w{k}. the cat x{k % 7}. y{k} the", "en") for k in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    texts = df.selectExpr("lang", "cast(text as binary) text")
    total, heavy = phrases._heavy(texts, 3, 10)
    assert total == 300 * 8 and {b"en\nthe", b"en\nthe cat", b"en\ncat"} <= heavy and len(heavy) < 20
    deals = {r.deal for r in phrases._packed(texts, 3, heavy).where("startswith(decode(key, 'utf-8'), 'the')").collect()}
    assert deals == {2, 3}
    assert sorted(map(tuple, phrases.collocations(df, parts=10).collect())) == brute(rows)


def test_counts_beyond_64_bits(spark):
    """Products of counts stay exact: floor(10**6 * a * a / (l * r))."""
    a, left, right = 4_000_000_000_007, 4_000_000_000_111, 5_000_000_000_123
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    (got,) = df.selectExpr(f"({phrases.SCALE}BD * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))").first()
    assert got == 1_000_000 * a * a // (left * right)


def test_long_text_and_long_words(spark):
    rows = [("word " * 300_000 + "." + "ab" * 100_000 + " z. " * 12, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(df).count() == 0


def test_query_agrees_with_its_sql(spark, data, duck):
    same_rows(queries.queries()["op13_collocations"](spark, data), duck.execute(queries.oracle_sql()["op13_collocations"]))
