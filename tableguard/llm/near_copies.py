"""One of each group of near copies: an exact join by shingle similarity.

Two texts are near copies if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more; groups are what such pairs join. Every pair
is either compared exactly or lies in a group that compared pairs have joined
already. Most groups are found cheaply by SimHashes first, so that the exact
join, which misses nothing, has little left to compare.

1. Texts equal in all words are one class; what follows is about classes.
2. A text gets a sketch of ``SKETCH`` independent SimHashes, and each half of
   each of them is a series of its own under the Gray-order index of
   ``simhash``: two texts are a candidate pair if they differ in at most two of
   32 bits in some series. A value's links are those to its nearest partners, and
   to the first one, so that a group in which all are alike gives links by its
   size, not by its pairs. What this leaves out is for step 4.
3. Candidates are compared by their sets of shingles. Pairs within a component
   that is already joined need no comparison, so this goes in rounds, nearest
   first, until every one is joined or compared.
4. The rest, exactly: with all shingles in one order, two sets of similarity 0.8
   share one of the first fifth (and one more) of each, and the first one that they
   share leaves enough behind it in both to reach 0.8. Classes of different
   components that share a shingle at such places are compared in the same rounds.
   They meet by components: those that share a shingle are paired first, their
   members only where the best of them can reach 0.8, so that a large group of
   copies is one row for each of its shingles. The order is by the number of texts that have a shingle
   (counted over all texts; from ``IN_ALL`` on, at most ``LAST`` shingles), then by
   hash, so that a line that many texts share brings few together; numbers that
   are less exact change the time, never the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, release
from .language_model import _grouped, _packed, _unpacked
from .simhash import components, in_gray_order, links, majority, near_pairs, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
SKETCH = 12
#: Bits of a series' value that may differ, and of the SimHash that goes along to check it.
BITS = 2
CHECK = 21
#: Bits of a whole sketch that may differ in a candidate of step 2; 116 are expected at a similarity of 0.8, give or take 10.
DOUBTFUL = 150
PARTNERS = 2
#: Shingles that come last: those in so many of a block's texts and of all, the commonest ones.
BLOCK, IN_BLOCK, IN_ALL, LAST = 1 << 22, 1, 8, 1 << 18
#: They are counted by so many bits of their hashes, in groups of about so many.
COUNTED, GROUP = 40, 1 << 20
#: Rows of a table that is broadcast.
FEW = 100_000


def sketch(text: str | None, h: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and independent SimHashes of its set of shingles (h, if it is known)."""
    from xxhash import xxh64_intdigest

    h = np.unique(shingle_hashes(text, WORDS)) if h is None else h
    same = xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 7)
    total = np.zeros((0, SKETCH), dtype=np.uint64)
    if len(h):
        x = h[:, None] + np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        total = x ^ (x >> np.uint64(31))
    return same, majority(total)


def sketches(docs: DataFrame, text: str, key: str, body: str) -> DataFrame:
    """(key, body, same, n, sketch) of every row; ``body`` is a hash of the text, ``n`` its number of shingles."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                held = part.column(0).to_pylist()
                sets = [np.unique(shingle_hashes(x, WORDS)) for x in held]
                both = [sketch(x, h) for x, h in zip(held, sets)]
                same = np.array([s for s, _ in both], dtype=np.uint64).view(np.int64)
                flat = np.concatenate([s for _, s in both]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCH, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(same), pa.array(np.array([len(h) for h in sets], dtype=np.int64)), lists], names=["key", "body", "same", "n", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.col(body).alias("body"))
    return rows.mapInArrow(run, f"key {kind}, body long, same long, n long, sketch array<long>")


def near_partners(value: np.ndarray, check: np.ndarray, bits: int, piece: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a share: of each value to its nearest partners, and to the first one before it."""
    order, turned, shared = in_gray_order(value, bits, piece, width)
    seen, out = np.zeros(len(value), dtype=bool), []
    other = check[order]
    for a, b in near_pairs(turned, bits, shared):
        d = np.bitwise_count(other[a] ^ other[b])
        ok = d <= CHECK
        a, b, d = a[ok], b[ok], d[ok]
        by = np.lexsort((b, d, a))
        a, b = a[by], b[by]
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        first = np.zeros(len(a), dtype=bool)
        first[np.unique(b, return_index=True)[1]] = True
        keep = (place < PARTNERS) | (first & ~seen[b])
        seen[b] = True
        out.append((order[a[keep]], order[b[keep]]))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))
    return a, b


def _apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, d): candidate pairs of classes (same, sketch) and the bits in which their sketches differ, DOUBTFUL at most."""
    series = F.posexplode(F.flatten(F.transform("sketch", lambda w: F.array(F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(0xFFFFFFFF))))))
    each = classes.select("same", "sketch", series.alias("series", "value"))
    each = each.select("series", "value", F.element_at("sketch", F.expr(f"cast((series div 2 + 1) % {SKETCH} + 1 as int)")).alias("check"), F.col("same").alias("id"))
    least = F.min(F.struct(F.xxhash64("id", "series").alias("h"), "check", "id"))
    values = materialize(each.groupBy("series", "value").agg(least.alias("f"), F.count("*").alias("n")).select("series", "value", "f.check", "f.id", "n"))
    # Written apart, values that few share are small enough to spare the others a shuffle.
    common = materialize(values.where("n > 1").drop("n"))
    tied = each.alias("e").join(common.alias("v"), ["series", "value"]).where("e.id != v.id")
    tied = tied.where(F.bit_count(F.col("e.check").bitwiseXOR(F.col("v.check"))) <= CHECK).select(F.col("e.id").alias("a"), F.col("v.id").alias("b"))
    met = links(values.drop("n"), BITS, 32, near_partners)
    pairs = tied.union(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    of = lambda c, s: classes.select(F.col("same").alias(c), F.col("sketch").alias(s))
    out = materialize(pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", _apart(F.col("x"), F.col("y")).alias("d")).where(f"d <= {DOUBTFUL}"))
    release(values, common)
    return out


def common_shingles(docs: DataFrame, text: str, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles by their first bits, in order, and in how many texts they are.

    Equal texts of a block count once. ``total`` is about the number of shingles.
    """
    import pyarrow as pa

    bits = max(0, (total // GROUP).bit_length())

    def run(batches):
        sets, seen, size = [], set(), 0

        def counted():
            h, n = np.unique(np.concatenate(sets) >> np.uint64(64 - COUNTED), return_counts=True)
            h, n = h[n >= IN_BLOCK], n[n >= IN_BLOCK].astype(np.int32)
            group = (h >> np.uint64(COUNTED - bits)).astype(np.int32)
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(h) else np.zeros(0, dtype=int)
            values = [_packed(np.diff(h[i:j], prepend=np.uint64(0)), n[i:j]) for i, j in zip(cuts, np.append(cuts[1:], len(h)))]
            return pa.RecordBatch.from_arrays([pa.array(group[cuts]), pa.array(values, pa.binary())], names=["group", "value"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for x in b.column(0).slice(at, 256).to_pylist():
                    h = np.unique(shingle_hashes(x, WORDS))
                    if (same := hash(h.tobytes())) not in seen:
                        seen.add(same)
                        sets.append(h)
                        size += len(h)
                if size >= BLOCK:
                    yield counted()
                    sets, seen, size = [], set(), 0
        if sets:
            yield counted()

    def add_up(batches):
        for _, rows in _grouped(batches, 2):
            each = [_unpacked(value.as_py()) for (value,) in rows]
            h, at = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in each]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in each]), len(h)).astype(np.int64)
            for i in range(0, len(h), 1 << 16):
                some = np.flatnonzero(n[i : i + (1 << 16)] >= IN_ALL) + i
                yield pa.RecordBatch.from_arrays([pa.array(h[some].astype(np.int64)), pa.array(n[some])], names=["h", "n"])

    dealt = docs.select(text).mapInArrow(run, "group int, value binary").repartition("group").sortWithinPartitions("group")
    counts = materialize(dealt.mapInArrow(add_up, "h long, n long"))
    # The least count that leaves at most LAST.
    least, many = 1 << 62, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("many")).collect(), reverse=True):
        many += r.many
        if many > LAST:
            break
        least = r.n
    found = counts.where(F.col("n") >= least).toArrow()
    release(counts)
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order].astype(np.uint64), n[order]


def first_shingles(docs: DataFrame, text: str, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(same, n, first) of every class: its number of shingles, and those of them one of which
    every near copy shares, in their order; ``hashes`` and ``counts`` are of the commonest ones."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def first(h: np.ndarray) -> np.ndarray:
        if len(hashes) and len(h):
            bits = h >> np.uint64(64 - COUNTED)
            at = np.minimum(np.searchsorted(hashes, bits), len(hashes) - 1)
            h = h[np.argsort(np.where(hashes[at] == bits, counts[at], 0), kind="stable")]
        return h[: len(h) - int(np.ceil(SIMILARITY * len(h) * (1 - 1e-12))) + 1]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.column(0).slice(at, 256).to_pylist()
                same = [xxh64_intdigest(b" ".join((x or "").encode("utf-8", "surrogatepass").lower().split()), 7) for x in part]
                sets = [np.unique(shingle_hashes(x, WORDS)) for x in part]
                firsts = [first(h) for h in sets]
                ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(same, dtype=np.uint64).view(np.int64)), pa.array(np.array([len(h) for h in sets], dtype=np.int64)), lists], names=["same", "n", "first"])

    return docs.select(text).mapInArrow(run, "same long, n long, first array<long>").dropDuplicates(["same"])


def rest_of_pairs(firsts: DataFrame, joined: DataFrame) -> DataFrame:
    """(a, b, d): all pairs of classes of different components that can have the similarity
    asked for; d is lower the more of their first shingles they share.

    Of n shingles all but ``place`` come at or after the first one that two texts
    share, and they must share SIMILARITY / (1 + SIMILARITY) of both texts' shingles.
    """
    roots = joined.select(F.col("node").alias("same"), "root")
    each = firsts.join(roots, "same", "left").select("same", "n", F.coalesce("root", "same").alias("root"), F.posexplode("first").alias("place", "h"))
    of_h = Window.partitionBy("h")
    met = each.withColumns({"low": F.min("root").over(of_h), "high": F.max("root").over(of_h)}).where("low < high")
    shared = materialize(met.select("h", "root", "same", "n", "place"))
    # n - place >= share * (n + other) for some member only if spare >= share * other.
    share = SIMILARITY / (1 + SIMILARITY)
    spare = F.max((1 - share) * F.col("n") - F.col("place")) + 1e-6
    best = materialize(shared.groupBy("h", "root").agg(spare.alias("spare"), F.min("n").alias("least")))
    side = lambda t, x: t.select("h", *(F.col(c).alias(f"{x}_{c}") for c in t.columns if c != "h"))
    can = (F.col("a_root") < F.col("b_root")) & (F.col("a_spare") >= share * F.col("b_least")) & (F.col("b_spare") >= share * F.col("a_least"))
    groups = side(best, "a").join(side(best, "b"), "h").where(can).select("h", "a_root", "b_root")
    enough = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= share * (F.col("a_n") + F.col("b_n")) - 1e-6
    pairs = groups.join(side(shared, "a"), ["h", "a_root"]).join(side(shared, "b"), ["h", "b_root"]).where(enough)
    met = materialize(pairs.select(F.least("a_same", "b_same").alias("a"), F.greatest("a_same", "b_same").alias("b")).distinct())
    release(shared, best)
    # All of their first shingles: of the text whose ones end earlier, all that are shared are among the other's.
    asked = _small(materialize(_classes_of(met)))
    of = lambda c, x: firsts.join(asked, "same", "left_semi").select(F.col("same").alias(c), F.col("n").alias(f"n{x}"), F.col("first").alias(x))
    k = F.size(F.array_intersect("x", "y"))
    behind = F.greatest(F.col("nx") - F.size("x"), F.col("ny") - F.size("y"))
    counted = met.join(of("a", "x"), "a").join(of("b", "y"), "b").where((1 + SIMILARITY) * (k + behind) >= SIMILARITY * (F.col("nx") + F.col("ny")) - 1e-6)
    out = materialize(counted.select("a", "b", (-k).alias("d")))
    release(met, asked)
    return out


def _small(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small: what it is joined to then stays where it is."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("same")).union(pairs.select(F.col("b").alias("same"))).distinct()


def _sets(pairs: DataFrame, texts) -> DataFrame:
    """(same, set): the shingles of all classes of pairs (a, b); ``texts`` returns (same, text) of the classes it is given."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [np.unique(shingle_hashes(x, WORDS)).view(np.int64) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["same", "set"])

    return materialize(texts(_classes_of(pairs)).mapInArrow(run, "same long, set array<long>"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity asked for."""
    now = sets.join(_classes_of(pairs), "same", "left_semi")
    of = lambda c, s: now.select(F.col("same").alias(c), F.col("set").alias(s))
    met = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").withColumn("met", met)
    return materialize(joined.where(F.col("met") >= SIMILARITY * (F.size("x") + F.size("y") - F.col("met"))).select("a", "b"))


def _compared(pairs: DataFrame, texts, joined: DataFrame) -> DataFrame:
    """joined (node, root) after all pairs (a, b, d) of different components have been
    compared, each class with its nearest ones first."""
    free = pairs.sparkSession.sparkContext._jvm.System.gc  # frees the files of shuffles that are done with
    free()
    sets = _sets(pairs, texts)
    left, many = pairs, 1
    while True:
        root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        place = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("d", "a", "b"))
        apart = left.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        ranked = materialize(apart.select("a", "b", "d", F.least(place("a"), place("b")).alias("r")))
        release(left)
        now = ranked.where(f"r <= {many}")
        if now.isEmpty():
            release(ranked, sets)
            return joined
        more = _similar(now.select("a", "b"), sets)
        joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        left, many = materialize(ranked.where(f"r > {many}").select("a", "b", "d")), many * 4
        release(ranked, more)
        del apart, now, more
        free()


def near_links(classes: DataFrame, texts, firsts: DataFrame) -> DataFrame:
    """(node, root) of every class that is a near copy of another one."""
    free = classes.sparkSession.sparkContext._jvm.System.gc
    found = candidates(classes)
    none = found.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    joined = _compared(found, texts, materialize(none, 0))
    free()
    return _compared(rest_of_pairs(firsts, joined), texts, joined)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest
    key, nulls last, then the smallest hash of its text.

    Groups are joined by all pairs of a similarity of 0.8 or more, and by texts equal
    in all words. A text of fewer than five words is one shingle. Null and empty
    texts are equal, without shingles. Rows equal in key and text are one. All
    columns of docs pass through, whatever their names. No rows, no rows.
    """
    body = fresh("body", docs.columns)
    marked = docs.withColumn(body, F.xxhash64(text))
    prints = materialize(sketches(marked, text, key, body))
    first = F.struct(F.col("key").isNull().alias("none"), "key", "body")
    classes = materialize(prints.groupBy("same").agg(F.min(first).alias("first"), F.first("sketch").alias("sketch"), F.first("n").alias("n")))
    release(prints)
    # A text of each class, found by the key and hash of its first row.
    by = ["_none", "_key", "_body"]
    parts = lambda k, h: [k.isNull().alias("_none"), F.coalesce(k.cast("string"), F.lit("")).alias("_key"), h.alias("_body")]
    named = classes.select("same", *parts(F.col("first.key"), F.col("first.body")))
    bodies = marked.select(F.col(text).alias("text"), *parts(F.col(key), F.col(body)))

    def texts(asked: DataFrame) -> DataFrame:
        wanted = _small(materialize(named.join(asked, "same", "left_semi")))
        return bodies.join(wanted, by).select("same", "text").dropDuplicates(["same"])

    total = classes.agg(F.sum("n")).first()[0] or 0
    firsts = materialize(first_shingles(docs, text, *common_shingles(docs, text, total)))
    joined = near_links(classes.select("same", "sketch"), texts, firsts)
    release(firsts)
    roots = joined.select(F.col("node").alias("same"), "root")
    kept = classes.join(roots, "same", "left").groupBy(F.coalesce("root", "same").alias("root")).agg(F.min("first").alias("first"))
    # Join and removal of repeated rows go by the same columns, so texts move once.
    own = [fresh(n, [*docs.columns, body]) for n in ("none", "key")]
    rows = marked.withColumns(dict(zip(own, parts(F.col(key), F.col(body)))))
    wanted = kept.select(*(c.alias(n) for c, n in zip(parts(F.col("first.key"), F.col("first.body")), [*own, body])))
    return rows.join(wanted, [*own, body], "left_semi").dropDuplicates([*own, body]).drop(*own, body)
