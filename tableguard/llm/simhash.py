"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made once per document and then kept apart from the texts.
Distinct fingerprints are linked, never documents: copies share a fingerprint.

The index is dealt over the cluster in shares of about ``SHARE`` fingerprints.
A fingerprint's bits are cut into bits + 1 pieces: two that differ in at most
``bits`` places agree on a whole piece, so each is filed once for every piece,
into the share that a hash of that piece's bits names, and every pair to be
linked meets in some share. Within a share fingerprints are turned so that the
piece comes first and sorted by Gray rank; a node's pattern is what all below it
share, a search adds up the differences on the way down, and a group whose sum
exceeds the limit is pruned whole (``near_pairs``). Every link of the result
comes out of that search.

A piece that more than ``HOT`` fingerprints have in common is dealt once more
under choices of four of bits + 4 pieces, which fix at least 40 of 64 bits for
bits = 2: such a share holds at most 2**24 fingerprints, however large the
corpus. Each share gives links of a spanning forest, at most one for each
fingerprint. Components are then joined by rounds of star contraction on
tables, cut by checkpoints; no links or fingerprints go to the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, table

FAN = 8
QUERIES = 2048
#: Entries of a search that are held at once.
HELD = 1 << 20
SHARE = 16_384
HOT = 1 << 18


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the rows of h (n, k), unsigned longs, set each of their 64 k bits.

    Rows are added two by two with all bits side by side, as numbers whose
    digits lie in separate planes, and only the last few are counted singly.
    """
    total = np.zeros(h.shape[1] * 64, dtype=np.int64)
    planes = [h]

    def count(part: np.ndarray, digit: int) -> None:
        bits = np.unpackbits(np.ascontiguousarray(part).astype(">u8").view(np.uint8).reshape(len(part), 8 * part.shape[1]), axis=1)
        total[:] += bits.sum(axis=0, dtype=np.int64) << digit

    while len(planes[0]) > 16:
        if len(planes[0]) % 2:
            for digit, p in enumerate(planes):
                count(p[-1:], digit)
            planes = [p[:-1] for p in planes]
        carry, above = None, []
        for p in planes:
            a, b = p[0::2], p[1::2]
            both = a ^ b
            if carry is None:
                above.append(both)
                carry = a & b
            else:
                above.append(both ^ carry)
                carry = (a & b) | (carry & both)
        planes = [*above, carry]
    for digit, p in enumerate(planes):
        count(p, digit)
    return total


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: A-Z lower-cased, words are runs without
    ASCII white space. A text with fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(w) - words + 1)
    whole = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(w)) - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """For each column of h one number whose bits are set in over half the rows; zero without rows."""
    bits = (bit_counts(h) * 2 > len(h)).reshape(-1, 64)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash over word shingles, repeats included; zero without words."""
    return int(majority(shingle_hashes(text, words)[:, None])[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """The kept columns of every row, and its fingerprint as a signed long, ``fp``."""
    import pyarrow as pa
    from pyspark.sql import types as T

    body = fresh("text", keep)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                prints = np.array([fingerprint(x, words) for x in part.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(prints)], names=[*keep, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])
    return docs.select(F.col(text).alias(body), *keep).mapInArrow(run, schema)


def cuts(width: int, n: int) -> list[tuple[int, int]]:
    """(low, high) of n pieces of about equal length of so many bits."""
    at = np.linspace(0, width, n + 1).round().astype(int).tolist()
    return list(zip(at, at[1:]))


def pieces(width: int, bits: int, agree: int) -> list[int]:
    """Masks of the choices of ``agree`` of bits + agree pieces."""
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in cuts(width, bits + agree)]
    return [sum(c) for c in combinations(each, agree)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray code."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def near_pairs(fp: np.ndarray, bits: int, shared: int = 0):
    """Pairs (i, j), i < j, of distinct fingerprints in Gray order that differ in
    at most ``bits`` places and in none that ``shared`` masks.

    Level by level from the root, (query, node) entries carry the differences
    so far; a node adds those on bits that all below it share and that its
    parent did not fix. Parts of the search that hold too many entries are cut
    in two. Yields arrays for blocks of queries.
    """
    levels = [(fp, ~np.zeros_like(fp))]
    while len(levels[-1][0]) > FAN:
        value, fixed = levels[-1]
        starts = np.arange(0, len(value), FAN)
        ones = np.bitwise_and.reduceat(value & fixed, starts)
        zeros = np.bitwise_and.reduceat(~value & fixed, starts)
        levels.append((ones, ones | zeros))
    alike = np.uint64(shared)
    for at in range(0, len(fp), QUERIES):
        q = np.arange(at, min(at + QUERIES, len(fp)))
        top = len(levels[-1][0])
        parts = [(len(levels) - 1, np.repeat(q, top), np.tile(np.arange(top), len(q)), np.zeros(len(q) * top, dtype=np.uint8))]
        while parts:
            depth, who, node, sums = parts.pop()
            if len(who) > HELD // FAN:
                half = len(who) // 2
                parts += [(depth, who[half:], node[half:], sums[half:]), (depth, who[:half], node[:half], sums[:half])]
                continue
            # Only what comes after the query is looked for.
            later = (node + 1) * FAN**depth > who + 1
            who, node, sums = who[later], node[later], sums[later]
            value, fixed = levels[depth]
            own = fixed[node] if depth + 1 == len(levels) else fixed[node] & ~levels[depth + 1][1][node // FAN]
            apart = (fp[who] ^ value[node]) & own
            sums = sums + np.bitwise_count(apart)
            keep = (sums <= bits) & (apart & alike == 0)
            if depth == 0:
                keep &= who < node
            who, node, sums = who[keep], node[keep], sums[keep]
            if depth == 0:
                yield who, node
            elif len(who):
                who, sums = np.repeat(who, FAN), np.repeat(sums, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(levels[depth - 1][0])
                parts.append((depth - 1, who[real], node[real], sums[real]))


def _roots(n: int, links) -> np.ndarray:
    """Smallest member of each of n nodes' components, links coming in blocks."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def in_gray_order(value: np.ndarray, bits: int, piece: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The order by Gray rank of values turned so that a piece comes first, the
    turned values in that order, and a mask of the piece."""
    low, high = cuts(width, bits + 1)[piece]
    full = np.uint64((1 << width) - 1)
    turned = ((value << np.uint64(width - high)) | (value >> np.uint64(high))) & full if high < width else value
    order = np.argsort(gray_rank(turned), kind="stable")
    return order, turned[order], ((1 << (high - low)) - 1) << (width - high + low)


def forest(value: np.ndarray, check: np.ndarray, bits: int, piece: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a share, as pairs of places."""
    order, turned, shared = in_gray_order(value, bits, piece, width)
    root = _roots(len(value), near_pairs(turned, bits, shared))
    own = root != np.arange(len(root))
    return order[own], order[root[own]]


def filed(points: DataFrame, bits: int, width: int, share: int = SHARE, hot: int = HOT) -> DataFrame:
    """points (series, value, ...) once for every share: with ``group`` and ``piece``.

    Values of a series are distinct and have ``width`` bits.
    """
    signed = lambda m: F.lit(m - (1 << 64) if m >= 1 << 63 else m)
    most = points.groupBy("series").count().agg(F.max("count")).first()[0] or 0
    shares = 1 << max(0, (most - 1) // share).bit_length()
    masks = F.array(*map(signed, pieces(width, bits, 1)))
    each = points.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("pattern", F.col("value").bitwiseAND(F.element_at(masks, F.col("piece") + 1)))
    name = F.xxhash64("series", "piece", F.pmod(F.xxhash64("pattern"), F.lit(shares)))
    by = ["series", "piece", "pattern"]
    if most <= hot:  # no pattern can be hot
        return each.withColumn("group", name).drop("pattern")
    # At most (bits + 1) / hot patterns for each point.
    heavy = materialize(each.groupBy(by).count().where(F.col("count") > hot).drop("count"))
    few = F.broadcast(heavy) if heavy.count() <= 100_000 else heavy
    marked = each.join(few.withColumn("hot", F.lit(True)), by, "left")
    deep = F.array(*map(signed, pieces(width, bits, 4)))
    again = F.when(F.col("hot"), F.transform(deep, lambda m: F.xxhash64("series", "piece", "pattern", m, F.col("value").bitwiseAND(m)))).otherwise(F.array(name))
    return marked.withColumn("group", F.explode(again)).drop("pattern", "hot")


def links(points: DataFrame, bits: int = 2, width: int = 64, find=forest, share: int = SHARE, hot: int = HOT) -> DataFrame:
    """(a, b): ids of points (series, value, check, id) that ``find`` links.

    ``find`` gets the values and checks of a share, the limit, the piece all
    its links agree on, and the width, and returns pairs of places; ``forest``
    links values of a series that differ in at most ``bits`` places.
    """
    import pyarrow as pa

    def close(parts, piece):
        value, check, name = (np.concatenate(x) for x in zip(*parts))
        a, b = find(value, check, bits, piece, width)
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(name[x[at : at + (1 << 16)]]) for x in (a, b)], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            group, piece, value, check, name = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            if not len(group):
                continue
            value, check = value.view(np.uint64), check.view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (piece[1:] != piece[:-1]))))
            for s, e in zip(starts, np.append(starts[1:], len(group))):
                if last is not None and last != (group[s], piece[s]):
                    yield from close(held, last[1])
                    held = []
                last = group[s], piece[s]
                held.append((value[s:e], check[s:e], name[s:e]))
        if held:
            yield from close(held, last[1])

    dealt = filed(points, bits, width, share, hot).select("group", "piece", "value", "check", "id").repartition("group").sortWithinPartitions("group", "piece")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: root is the component's smallest node.

    Alternating star contraction: large stars hang a node's larger neighbours
    on its smallest, small stars its smaller ones, until every edge leads to a
    root. Minima are partial aggregates and joins carry two longs a row, so a
    node with very many neighbours only makes a join that splits.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    rows = now.count()
    while True:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        first = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(first, "v")
        small = joined.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        then = materialize(small.distinct(), rows)
        # Stars are reached when no node is both above and below: each v has one u, and no u is a v.
        n, vs = then.agg(F.count("*"), F.count_distinct("v")).first()
        release(now)
        if n == vs and then.select("u").distinct().join(then.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            roots = then.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            return then.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
        now = then


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, bits: int = 2, share: int = SHARE, hot: int = HOT) -> DataFrame:
    """(key, fp, component_id) of every row: rows link if their fingerprints differ in at most ``bits`` places.

    ``component_id`` is the smallest key reachable over links, the row's own
    included. Null and empty texts have fingerprint zero. Rows with a null key
    take part, but their key is never a component's id: it is null only if a
    component has no other key. Repeated rows are returned as often as they
    come. Other columns of docs, of whatever names, take no part; ``key`` may
    have any name, but that the result's columns be distinct. No rows, no rows.
    """
    k = fresh("key", [key])
    prints = materialize(fingerprints(docs.select(F.col(key).alias(k), text), text, (k,), words))
    distinct = prints.groupBy("fp").agg(F.min(k).alias("least"))
    points = distinct.select(F.lit(0).alias("series"), F.col("fp").alias("value"), F.lit(0).cast("long").alias("check"), F.col("fp").alias("id"))
    found = components(links(points, bits, 64, forest, share, hot))
    linked = found.join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    # A table of its own: a component with very many members then makes a join that splits.
    smallest = materialize(linked.groupBy("root").agg(F.min("least").alias("smallest")), found.count())
    named = found.join(smallest, "root").select(F.col("node").alias("fp"), "smallest", F.lit(True).alias("in"))
    # Members without any key have no smallest one; others have, if only their own.
    by_print = distinct.join(named, "fp", "left").select("fp", F.when(F.col("in"), F.col("smallest")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(by_print, "fp").select(F.col(k).alias(key), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
