import collections
import math
import zlib

import numpy as np

from tableguard.llm import language_model as lm


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000, None), (10_001, ""), (None, "the the"), (3, "again and again"), (10_002, "neverseen " * 3)], "doc_id long, text string")
    rows = docs.union(extra)
    got = lm.score_texts(rows, ~lm.held_out(rows["doc_id"])).collect()
    texts = [tuple(r) for r in rows.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in texts if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in texts:
        w = tokens(t)
        want.setdefault(i, []).append((out(i), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    assert len(got) == len(texts)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4] and abs(r.base_score - x[4]) < 1e-6 for x in want[r.doc_id])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def plain_model(texts, trains):
    """The same model in plain dictionaries: base-10 log probability of each text.

    Only the draw of a cell's tables, which has tests of its own, is shared.
    """
    c, pair = collections.Counter(), collections.Counter()
    for t, own in zip(texts, trains):
        if own:
            w = tokens(t)
            c.update(w)
            pair.update(zip([b""] + w, w))
    every = {x for t in texts for x in tokens(t)}
    number = {x: k for k, x in enumerate(sorted(every, key=lambda x: (-c[x], x)))}
    n, v, once = sum(c.values()), max(1, len(c)), sum(k == 1 for k in c.values())
    unseen = max(1, len(every) - len(c), once * (once - 1) // (2 * (sum(k == 2 for k in c.values()) + 1)))
    d2 = lm._discount(sum(k == 1 for k in pair.values()), sum(k == 2 for k in pair.values()))
    cells = sorted(pair)
    keys = np.array([number[u] << 32 | number[w] for u, w in cells], dtype=np.uint64)
    t, t_parent, kept = np.ones(len(cells), dtype=int), float(v), []
    for sweep in range(lm.BURN + lm.KEEP + 1):
        tu, n0 = collections.Counter(), collections.Counter()
        for (u, w), k in zip(cells, t):
            tu[u] += int(k)
            n0[w] += int(k)
        total, d0 = sum(n0.values()), lm._discount(sum(k == 1 for k in n0.values()), sum(k == 2 for k in n0.values()))
        names = list(n0)
        t0 = dict(zip(names, lm.draw_tables(np.array([n0[w] for w in names]), np.full(len(names), (lm.STRENGTH + d0 * t_parent) / v), d0, lm.chances(np.array([number[w] for w in names]), 1000 + sweep)))) if names else {}
        t_parent = float(sum(t0.values()))
        escape, leave = (lm.STRENGTH + d0 * t_parent) / (lm.STRENGTH + total), {u: (lm.STRENGTH + d2 * tu[u]) / (lm.STRENGTH + c[u]) for u in c}
        left = min(1.0, sum(lm.STRENGTH + d2 * tu[u] for u in c) / n) if n else 1.0
        unknown = min(0.99, max(0.01, once / max(1, n) / (left * escape)))
        p = {w: max(n0[w] - d0 * t0[w], 0) / (lm.STRENGTH + total) + escape * (1 - unknown) / v if c[w] else escape * unknown / unseen for w in every}
        if sweep > lm.BURN:
            kept.append((dict(zip(cells, t)), p, leave))
        mass = np.array([(lm.STRENGTH + d2 * tu[u]) * p[w] for u, w in cells])
        if len(cells):
            t = lm.draw_tables(np.array([pair[x] for x in cells]), mass, d2, lm.chances(keys, sweep))

    def log_p(u, w):
        each = []
        for s, x, left in kept:
            own = (pair[u, w] - d2 * s[u, w]) / (lm.STRENGTH + c[u]) if pair[u, w] else 0
            each.append(own + left.get(u, 1.0) * x[w])
        return math.log10(np.mean(each))

    return [sum(log_p(u, w) for u, w in zip([b""] + tokens(t), tokens(t))) for t in texts], lambda u, w: 10 ** log_p(u, w), every, unseen - (len(every) - len(c))


def test_against_plain_model(spark, data, monkeypatch):
    """Scores are those of the plain model, however rows lie, and parts and blocks are cut."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10_000, None), (10_001, "the the"), (10_002, "neverseen " * 3)]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    want = dict(zip([i for i, _ in rows], plain_model([t for _, t in rows], [not x for x in out])[0]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for k, (block, part) in enumerate([(lm.BLOCK_TOKENS, lm.PART_TOKENS), (3000, 5000)]):
        monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
        monkeypatch.setattr(lm, "PART_TOKENS", part)
        got[k] = {r.doc_id: r.score for r in lm.score_texts(frame.repartition(1 + 6 * k), ~lm.held_out(frame["doc_id"])).collect()}
        assert max(abs(got[k][i] - want[i]) / (1 + abs(want[i])) for i in want) < 1e-6
    assert max(abs(got[0][i] - got[1][i]) for i in want) < 1e-6


def test_probabilities_sum_to_one(spark, data):
    """Over known tokens, those met only in held-out texts and the rest of the unseen, in every context."""
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(25).collect()]
    _, p, every, rest = plain_model(texts, [k % 4 > 0 for k in range(len(texts))])
    new = next(w for w in every if w not in {x for k, t in enumerate(texts) if k % 4 for x in tokens(t)})
    for u in sorted(every)[:: len(every) // 8]:
        assert abs(sum(p(u, w) for w in every) + rest * p(u, new) - 1) < 0.02


def test_better_than_fixed_discounts(data):
    """Held-out texts are likelier than by interpolated bigrams with a fixed discount, for any discount.

    The plain model has the module's scores (above). Both share the unseen words' mass alike.
    """
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    scores, *_ = plain_model([t for _, t in rows], [not x for x in out])
    c, pair, held = collections.Counter(), collections.Counter(), []
    for (_, t), x in zip(rows, out):
        w = tokens(t)
        if x:
            held += zip([b""] + w, w)
        else:
            c.update(w)
            pair.update(zip([b""] + w, w))
    follow, n, once = collections.Counter(u for u, _ in pair), sum(c.values()), sum(k == 1 for k in c.values())
    unseen = max(len({w for _, w in held} - c.keys()), once * (once - 1) // (2 * (sum(k == 2 for k in c.values()) + 1)))
    base = lambda w: (1 - once / n) * c[w] / n if c[w] else once / n / unseen
    model = sum(s for s, x in zip(scores, out) if x)
    for d in (0.5, 0.65, 0.75, 0.85, 0.95):
        fixed = sum(math.log10((max(pair[u, w] - d, 0) + d * follow[u] * base(w)) / c[u] if c[u] else base(w)) for u, w in held)
        assert model > fixed, d


def gibbs(customers: np.ndarray, mass: np.ndarray, discount: float, steps: int, rng, state=None):
    """Tables of each cell after ``steps`` customers of each have been seated anew, one by one."""
    many = np.flatnonzero(customers > 1)
    c, m = customers[many].astype(np.float64), np.maximum(mass[many], 1e-300)
    tables = np.ones(len(customers), dtype=np.int64)
    if not len(many):
        return tables, state
    if state is None:
        n = np.clip(np.rint(m * np.log1p(c / m)), 1, c).astype(np.int64)
        each = customers[many] // n
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        sizes = np.repeat(each, n) + (within < np.repeat(customers[many] - each * n, n))
    else:
        n, sizes = state
    base = np.cumsum(c) - c
    for _ in range(steps):
        # One customer of each cell leaves; tables of a cell lie together, in order of cells.
        gone = np.searchsorted(np.cumsum(sizes), base + np.floor(rng.random(len(c)) * c), side="right")
        sizes[gone] -= 1
        empty = sizes[gone] == 0
        new = rng.random(len(c)) * (c - 1 - discount * (n - empty) + m) < m
        # Others join a table of their cell with probability in proportion to its size less the discount.
        sums, left = np.cumsum(sizes), np.flatnonzero(~new)
        joined = np.full(len(c), -1)
        for go in range(30):
            if not len(left):
                break
            at = np.searchsorted(sums, base[left] - left + np.floor(rng.random(len(left)) * (c[left] - 1)), side="right")
            ok = (rng.random(len(left)) * sizes[at] < sizes[at] - discount) | (go == 29)
            joined[left[ok]] = at[ok]
            left = left[~ok]
        sizes[joined[~new]] += 1
        sizes[gone[new & empty]] = 1
        ends = np.cumsum(n)
        opened = np.flatnonzero(new & ~empty)
        closed = gone[~new & empty]
        n = n + (new & ~empty) - (~new & empty)
        keep = np.ones(len(sizes), dtype=bool)
        keep[closed] = False
        sizes = np.insert(sizes, ends[opened], 1)[np.insert(keep, ends[opened], True)]
    tables[many] = n
    return tables, (n, sizes)


def test_gibbs_keeps_customers_and_its_distribution():
    """Two customers sit apart in proportion mass to 1 - discount."""
    c = np.full(4000, 2)
    t, state = gibbs(c, np.full(4000, 0.6), 0.4, 40, np.random.default_rng(1))
    assert abs((t == 2).mean() - 0.5) < 0.03 and state[1].sum() == c.sum()
    c = np.array([1, 7, 1000, 3, 2])
    t, (n, sizes) = gibbs(c, np.array([0.1, 5.0, 30.0, 1e-9, 0.0]), 0.5, 50, np.random.default_rng(2))
    assert sizes.sum() == 1012 and (sizes > 0).all() and n.sum() == len(sizes) and (t <= c).all() and t[0] == 1 and 1 < t[2] < 300


def test_empty_and_all_held_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(docs, ~lm.held_out(docs["doc_id"])).count() == 0
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(rows, F.lit(False)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score)


def test_very_long_text_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 50)
    rows = spark.createDataFrame([(k, f"w{k % 7} common words w{k}") for k in range(300)] + [(999, "long " * 300_000)], "doc_id long, text string").repartition(3)
    got = lm.score_texts(rows, ~lm.held_out(rows["doc_id"])).collect()
    assert len(got) == 301 and max(r.n_tokens for r in got) == 300_001


def test_context_is_the_word_before(spark):
    """A word always followed by one other is told from a frequent word without that habit."""
    lines = [f"{a}{k} {b}{k}" for k in range(60) for a, b in (("left", "right"),)] * 20
    docs = spark.createDataFrame([(k, x, True) for k, x in enumerate(lines)] + [(-1, "left7 right7", False), (-2, "left7 right8", False)], "doc_id long, text string, trains boolean").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_texts(docs, docs["trains"]).where("doc_id < 0").collect()}
    assert got[-1] - got[-2] > 2


def test_unknown_words_share_their_mass(spark):
    """All unknown words of a corpus, and the known ones, have at most one between them."""
    seen = [f"known{k % 40} once{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, x, True) for k, x in enumerate(seen)] + [(-1 - k, f"new{k}", False) for k in range(500)], "doc_id long, text string, trains boolean")
    got = [r for r in lm.score_texts(docs, docs["trains"]).collect() if not r.held_out]
    new = lm.score_texts(docs, docs["trains"]).where("held_out").collect()
    assert got and sum(10 ** r.score for r in new) < 1


def test_all_customers_are_drawn():
    """Tables of a cell of any size follow the exact distribution; so do long Gibbs runs."""
    rng, d = np.random.default_rng(3), 0.6
    for c, m in ((2, 0.6), (7, 3.0), (20, 9.0)):
        t = lm.draw_tables(np.full(4000, c), np.full(4000, m), d, lm.chances(np.arange(4000), c))
        by_steps, _ = gibbs(np.full(4000, c), np.full(4000, m), d, 20 * c, rng)
        assert abs(t.mean() - by_steps.mean()) < 0.15 * max(1, by_steps.std())
    for c, m in ((300, 0.01), (1500, 40.0), (2000, 900.0), (2000, 9000.0)):
        s = lm._stirling(c, d)[c, :c] + np.log(m) * np.arange(1, c + 1)
        want = np.exp(s - s.max())
        low, p = lm._tables_of_large(c, m, d)
        got = np.zeros(c)
        got[low - 1 : low - 1 + len(p)] = p[: c - low + 1]
        assert np.abs(got / got.sum() - want / want.sum()).max() < 1e-9


def test_columns_of_any_name_are_left_alone(spark):
    """Names that the job uses itself, in either case, change nothing."""
    rows = [(k, f"a b c{k % 3} a b") for k in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([(*r, "x", 1, 2.0, None, 3) for r in rows], "doc_id long, text string, word string, at int, Score double, _key string, block int")
    score = lambda df: sorted(map(tuple, lm.score_texts(df, ~lm.held_out(df["doc_id"])).collect()))
    assert score(more) == score(plain)


def test_keys_places_and_ranges_come_back():
    """What is packed for parts and ranges is unpacked as it was, whatever is empty."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        key = np.unique(rng.integers(0, 40, n).astype(np.uint64) << np.uint64(32) | rng.integers(0, 2**32, n).astype(np.uint64))
        got, c = lm._unpack_keys(lm._pack_keys(key, np.arange(len(key))))
        assert (got == key).all() and (c == np.arange(len(key))).all()
        ids = rng.permutation(3 * n + 1)[:n]
        dealt = lm._dealt(ids, 7)
        assert sorted(x for r, (_, place) in dealt.items() for x in place * 7 + r) == sorted(ids)
        assert all((ids[which] == lm._places(lm._steps(place)) * 7 + r).all() for r, (which, place) in dealt.items())
    for n in (1, 5, 600_000):
        token = rng.integers(0, 5, n).astype(np.int32)
        pairs = np.concatenate([x for _, x in lm._pairs(token)])
        assert (pairs & lm.LOW == token).all() and (pairs >> np.uint64(32) == np.roll(token, 1)).all()
        asked = lm._Asked(token, np.array([9, 4, 7, 0, 2]), np.ones(5, dtype=np.int64), 3, 5)
        assert asked.counts(np.ones(n, dtype=bool)).sum() == n and (np.diff(asked.part) >= 0).all()
        place = np.concatenate([x for _, x in asked.places()])
        assert (asked.last[place] == token).all() and (asked.before[place] == np.roll(token, 1)).all()


def test_many_ranges_and_no_row_for_each_cell(spark, data, monkeypatch):
    """Ranges of few numbers give the same scores; sweeps write a row for each part and range, not for each cell."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(150)
    rows = [tuple(r) for r in docs.collect()] + [(10_000, None), (10_001, "the the"), (10_002, "neverseen " * 3)]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    want = dict(zip([i for i, _ in rows], plain_model([t for _, t in rows], [not x for x in out])[0]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known, write = len({w for i, t in rows for w in tokens(t)}), lm.materialize
    for ids, block in ((1 + known // 9, 4000), (10**6, lm.BLOCK_TOKENS)):
        sizes = []
        monkeypatch.setattr(lm, "materialize", lambda df, *a: (x := write(df, *a), sizes.append((x.columns, x.count())))[0])
        monkeypatch.setattr(lm, "RANGE_IDS", ids, raising=False)
        monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
        monkeypatch.setattr(lm, "PART_TOKENS", 5000)
        got = {r.doc_id: r.score for r in lm.score_texts(frame, ~lm.held_out(frame["doc_id"])).collect()}
        assert max(abs(got[i] - want[i]) / (1 + abs(want[i])) for i in want) < 1e-6
        assert all(n < known / 2 for columns, n in sizes if "word" not in columns), sizes
