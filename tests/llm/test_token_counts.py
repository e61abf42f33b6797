import math

import pytest
import regex

from tableguard.llm import token_counts as tc

PIECES = {bytes([b]): -5.0 - b / 512 for b in range(256)} | {b"ab": -6.0, b"abc": -6.5, b" the": -3.0, b"th": -4.0, b"he": -4.0, "é".encode(): -5.5}


def brute(word, pieces=PIECES):
    """Best score, then fewest pieces, over all splits."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces))
    return -best[-1][1], best[-1][0]


def test_trie_counts():
    words = {"abc", "abcab", "ab", " the", " thee", " th", "é", "éab", "zzz", "", "a" * 3000}
    got = tc.trie_counts(words, PIECES, tc.endings(PIECES))
    for w in words:
        n, p = brute(w.encode())
        assert got[w][0] == n and math.isclose(got[w][1], p)


vocabulary = pytest.mark.skipif(not __import__("os").path.exists(tc.VOCABULARY), reason="needs the vocabulary file")


def all_splits(known, pieces, cut):
    for t in set(cut) - known.keys():
        known[t] = brute(t.encode(), pieces)
    return [known[t] for t in cut]


@vocabulary
@pytest.mark.parametrize(("together", "kept"), [(tc.TOGETHER, tc.KEPT), (50, 20)])
def test_documents(spark, monkeypatch, together, kept):
    """Against all splits of every pre-token of whole texts, one of them a single long pre-token."""
    monkeypatch.setattr(tc, "TOGETHER", together)
    monkeypatch.setattr(tc, "KEPT", kept)
    texts = [None, "", "Hello there, hello there!", "  \n\n x", "éèß 😀 123456", "word " * 40_000, "x" * 1500, "The quick brown fox isn't jumping over unbelievably lazy dogs; antidisestablishmentarianism"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1), (None, "null id", 1)]
    got = tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    pieces, known = tc.read_vocabulary(tc.VOCABULARY), {}
    assert len(got) == len(rows) and abs(sum(map(math.exp, pieces.values())) - 1) < 1e-9
    for r in got:
        each = all_splits(known, pieces, regex.findall(tc.PATTERN, (texts[r.doc_id] if r.doc_id is not None else "null id") or ""))
        assert r.n_tokens == sum(n for n, _ in each) and r.n_pretokens == len(each) and math.isclose(r.log_prob, sum(p for _, p in each), abs_tol=1e-9)


@vocabulary
def test_query(spark, data):
    """The query over its whole table against all splits of every pre-token."""
    pieces, known = tc.read_vocabulary(tc.VOCABULARY), {}
    got = {r.doc_id: r for r in tc.op4_token_counts(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        each = all_splits(known, pieces, regex.findall(tc.PATTERN, r.text or ""))
        assert got[r.doc_id].n_tokens == sum(n for n, _ in each) and got[r.doc_id].n_pretokens == len(each)


def test_empty_table(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
