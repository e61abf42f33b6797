import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tableguard.llm import simhash


def plain(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, bits):
    """Brute force: the smallest id reachable over links."""
    label = dict.fromkeys(range(len(ids)))
    for i in label:
        if label[i] is None:
            queue, found = [i], {i}
            while queue:
                x = queue.pop()
                near = {j for j in range(len(ids)) if j not in found and bin(prints[x] ^ prints[j]).count("1") <= bits}
                found |= near
                queue += near
            low = min((ids[j] for j in found if ids[j] is not None), default=None)
            for j in found:
                label[j] = low
    return label


@given(st.text(), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text, words):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text, words) == plain(text, words)


def test_documents(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ÄÖ one two three"]
    for _ in range(25):
        words = list(rng.choice(vocabulary, 400))
        for _ in range(6):
            texts.append(" ".join(words))
            words = words.copy()
            words[rng.integers(400)] = "changed"
    texts.append("z " * 200_000)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], None), (None, texts[20], "s"), (None, "all alone here", "s")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [plain(t) for _, t, _ in rows]
    label = classes([r[0] for r in rows], prints, 2)
    want = sorted(repr((rows[i][0], prints[i], label[i])) for i in label)
    assert sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in got) == want
    assert len(set(label.values())) < len(rows) - 30


def test_bit_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 16, 17, 33, 1000):
        h = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
        want = [sum(int(x) >> 63 - b & 1 for x in h[:, k]) for k in range(2) for b in range(64)]
        assert simhash.bit_counts(h).tolist() == want


def labels_of(fp, bits):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("bits", "share", "hot"), [(2, 16384, 1 << 18), (2, 100, 1 << 18), (3, 200, 50), (1, 64, 10)])
def test_links_find_every_pair(spark, bits, share, hot):
    """However points are dealt, also where many agree on a piece and are dealt again."""
    rng = np.random.default_rng(bits)
    fp = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for _ in range(4):
        fp = np.unique(np.concatenate([fp, fp[rng.integers(0, len(fp), 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))]))
    prints = spark.createDataFrame([(0, int(x), 0, int(x)) for x in fp.view(np.int64)], "series int, value long, check long, id long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints, bits, share=share, hot=hot)).collect()}
    got = [roots.get(int(x), int(x)) for x in fp.view(np.int64)]
    label = labels_of(fp, bits)
    assert len(set(zip(got, label))) == len(set(got)) == len(set(label))


def test_links_come_out_of_the_index(spark, data):
    """Shares are large, and the pairs that the Gray-order search yields make every link of the documents."""
    prints = np.unique([simhash.fingerprint(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]).astype(np.uint64)
    points = spark.createDataFrame([(0, int(x), 0, int(x)) for x in prints.view(np.int64)], "series int, value long, check long, id long")
    sizes = [r["count"] for r in simhash.filed(points, 2, 64).groupBy("group").count().collect()]
    assert sizes == [len(prints)] * 3
    n = range(len(prints))
    for bits in (2, 8):
        pairs = set()
        for piece in range(bits + 1):
            order, turned, shared = simhash.in_gray_order(prints, bits, piece, 64)
            pairs |= {tuple(sorted((int(order[a]), int(order[b])))) for x, y in simhash.near_pairs(turned, bits, shared) for a, b in zip(x, y)}
        assert pairs == {(i, j) for i in n for j in n if i < j and bin(int(prints[i]) ^ int(prints[j])).count("1") <= bits}
    assert pairs


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80, unique=True), st.integers(0, 6))
@settings(max_examples=60, deadline=None)
def test_index_pairs(values, bits):
    fp = np.array(values, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp ^ np.uint64(5), fp ^ np.uint64(1 << 40)]))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    got = {(int(a), int(b)) for x, y in simhash.near_pairs(fp, bits) for a, b in zip(x, y)}
    n = range(len(fp))
    assert got == {(i, j) for i in n for j in n if i < j and bin(int(fp[i]) ^ int(fp[j])).count("1") <= bits}


def test_gray_rank():
    rank = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(rank ^ rank >> np.uint64(1)) == rank).all()


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, k) for k in range(1001, 1400)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1400)} == {1000} and len(got) == 701


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
