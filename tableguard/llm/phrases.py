"""Collocations of each language, counted by suffix-sigma.

Every word of a piece of text begins a suffix, cut off after ``max_n`` words.
Suffixes are dealt by language and first word, sorted in reverse lexicographic
order, and read once: a stack that holds the prefixes of the current suffix
counts each prefix when it is left. Counts of a phrase's parts are joined to it
afterwards, and all arithmetic is on whole numbers.

Before that a first pass finds heavy prefixes. A prefix with more than one part in
``PARTS`` of all suffixes has at least half that share in some block of text, so
blocks report what is heavy there; what their sums confirm is at most twice
``PARTS`` prefixes of each length, whatever the corpus. Suffixes that begin
with a heavy word are dealt by two words, with a heavy pair by three, and so on:
no task gets more than a small share of all suffixes in one group. Only the heavy
prefixes themselves are then counted in several tasks, and added up.

Blocks of text are numbered and counted in arrays. A block's different suffixes
travel as one row for each group, lines and counts, which shuffles several times
less than a row for each would; Spark sorts them as single rows again, and spills.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

MAX_N = 3
LEAST = 10
CONTAINED = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"
PARTS = 4096
BLOCK_BYTES = 3 << 20
SUFFIXES_A_TASK = 4_000_000
BUCKETS = 64
#: What ends a piece of text, as an upper-case letter is lower-cased, in one translation of bytes.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_ENDS))


def _pieces(text: bytes, most: int):
    """A translated text in parts of about ``most`` bytes, cut where pieces end."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def _blocks(batches, most: int):
    """(language, texts) of the rows of (language, bytes), a block of one language at a time."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            for part in _pieces(text.as_buffer().to_pybytes().translate(_PLAIN), most):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if size[lang] >= most or sum(size.values()) >= 2 * most:
                    full = max(size, key=size.get)
                    size.pop(full)
                    yield full, held.pop(full)
    yield from held.items()


def suffixes(texts: list[bytes], max_n: int):
    """Different suffixes of translated texts, in order.

    Returns words in order, the empty one first, then a row of ``max_n`` numbers of
    words for each suffix, 0 where the piece has ended, and how often it comes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    a = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    end = a == 10
    inside = ~end & (a != 32) & (a != 9)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return None
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(1, len(order) + 1)
    ids = place[coded.indices.to_numpy()]
    piece = np.searchsorted(np.flatnonzero(end), starts)
    columns, code, top = [ids], ids, len(order) + 1
    most = top
    for k in range(1, max_n):
        following = np.zeros_like(ids)
        following[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        columns.append(following)
        if most * top >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            most = len(ids)
        code, most = code * top + following, most * top
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    words = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.take(pa.array(order))])
    return words, np.stack([c[first] for c in columns], axis=1), counts


def _joined(words, ids: np.ndarray):
    """Words of each row of numbers, with spaces between."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not ids.shape[1]:
        return pa.array([b""] * len(ids), pa.binary())
    return pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in ids.T), b" ")


def _common(ids: np.ndarray) -> np.ndarray:
    """How many first words a suffix shares with the one before it."""
    same = np.logical_and.accumulate(ids[1:] == ids[:-1], axis=1).sum(axis=1)
    return np.concatenate(([0], same))


def _heavy(texts: DataFrame, max_n: int, parts: int) -> tuple[int, set[bytes]]:
    """The number of all suffixes, and heavy prefixes as ``language newline words``."""

    def run(batches):
        import pyarrow as pa

        total = 0
        for lang, block in _blocks(batches, BLOCK_BYTES):
            found = suffixes(block, max_n)
            if found:
                words, ids, counts = found
                total += counts.sum()
                common = _common(ids)
                for n in range(1, max_n):
                    at = np.flatnonzero(common < n)
                    sums = np.add.reduceat(counts, at)
                    keep = (sums * 2 * parts >= counts.sum()) & (ids[at, n - 1] > 0)
                    names = [lang.encode() + b"\n" + w for w in _joined(words, ids[at[keep], :n]).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums[keep], pa.int64())], names=["prefix", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([total], pa.int64())], names=["prefix", "n"])

    found = materialize(texts.mapInArrow(run, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n")))
    total = found.where(F.col("prefix").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return total, {bytes(r[0]) for r in found.where(F.col("prefix").isNotNull() & (F.col("n") * 2 * parts >= total)).select("prefix").collect()}


def _listed(heavy: set[bytes], max_n: int) -> list:
    """Heavy prefixes by their number of words."""
    import pyarrow as pa

    return [pa.array(sorted(h for h in heavy if h.partition(b"\n")[2].count(b" ") == n), pa.binary()) for n in range(max_n - 1)]


def _is_heavy(names, listed) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.is_in(names, value_set=listed).to_numpy(zero_copy_only=False)


def _packed(texts: DataFrame, max_n: int, heavy: set[bytes]) -> DataFrame:
    """(lang, key, deal, lines, n): a block's suffixes of one key, which is their first ``deal`` words."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        listed = _listed(heavy, max_n)
        for lang, block in _blocks(batches, BLOCK_BYTES):
            found = suffixes(block, max_n)
            if not found:
                continue
            words, ids, counts = found
            common, mark = _common(ids), pa.scalar(lang.encode() + b"\n", pa.binary())
            deal = np.ones(len(ids), dtype=np.int64)
            for n in range(1, max_n):
                at = np.flatnonzero(common < n)
                hot = np.zeros(len(at), dtype=bool)
                ask = np.flatnonzero(deal[at] == n)
                if len(ask) and len(listed[n - 1]):
                    names = pc.binary_join_element_wise(mark, _joined(words, ids[at[ask], :n]), b"")
                    hot[ask] = _is_heavy(names, listed[n - 1])
                deal += np.repeat(hot, np.diff(np.append(at, len(ids))))
            for d in np.unique(deal):
                mine = np.flatnonzero(deal == d)
                new = np.flatnonzero(common[mine] < d)
                cut = pa.array(np.append(new, len(mine)), pa.int32())
                lines = pc.binary_join(pa.ListArray.from_arrays(cut, _joined(words, ids[mine, d:])), b"\n")
                n = pa.ListArray.from_arrays(cut, pa.array(counts[mine], pa.int32()))
                out = [pa.array([lang] * len(new)), _joined(words, ids[mine[new], :d]), pa.array(np.full(len(new), d), pa.int32()), lines, n]
                yield pa.RecordBatch.from_arrays(out, names=["lang", "key", "deal", "lines", "n"])

    return texts.mapInArrow(run, "lang string, key binary, deal int, lines binary, n array<int>")


def _unpacked(packed: DataFrame, max_n: int) -> DataFrame:
    """(lang, w1, w2, ..., n): a row for each suffix of each block."""
    names = [f"w{k}" for k in range(1, max_n + 1)]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            deals = b.column(2).to_numpy()
            for d in np.unique(deals):
                lang, key, _, lines, n = b.filter(pa.array(deals == d)).columns
                rest = pc.split_pattern(lines, b"\n")
                of = pa.array(np.repeat(np.arange(len(lines)), pc.list_value_length(rest).to_numpy()))
                cells = [pc.split_pattern(key, b" ").flatten().take(pa.array(np.arange(k, d * len(lines), d))).take(of) for k in range(d)]
                if d < max_n:
                    after, m = pc.split_pattern(rest.flatten(), b" ").flatten(), max_n - d
                    cells += [after.take(pa.array(np.arange(k, m * len(of), m))) for k in range(m)]
                out = pa.RecordBatch.from_arrays([lang.take(of), *cells, n.flatten()], names=["lang", *names, "n"])
                for at in range(0, len(of), 1 << 16):
                    yield out.slice(at, 1 << 16)

    return packed.mapInArrow(run, "lang string, " + ", ".join(f"{w} binary" for w in names) + ", n int")


def _counted(ordered: DataFrame, max_n: int, heavy: set[bytes], least: int) -> DataFrame:
    """(lang, words, phrase, f, whole) from suffixes in order.

    Phrases of fewer than ``least`` go, but heavy prefixes, which other tasks have
    too (``whole`` is false). A row without words has the language's suffixes here.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        listed = _listed(heavy, max_n)
        # The stack: the suffix that is open, and the count of each of its prefixes so far.
        top, counts = None, [0] * (max_n + 1)

        def closed(n, columns, sums):
            """Rows of prefixes of n words that are left; columns: language and words."""
            if not n:
                return columns[0], pa.array([b""] * len(sums), pa.binary()), sums, np.zeros(len(sums), dtype=bool)
            there = pc.not_equal(columns[n], b"").to_numpy(zero_copy_only=False)
            hot = there.copy() if n < max_n else np.zeros(len(sums), dtype=bool)
            for k in range(1, n + 1 if n < max_n else 1):
                ask = np.flatnonzero(hot)
                some = [c.take(pa.array(ask)) for c in columns[: k + 1]]
                names = pc.binary_join_element_wise(some[0].cast(pa.binary()), pc.binary_join_element_wise(*some[1:], b" "), b"\n")
                hot[ask] = _is_heavy(names, listed[k - 1])
            keep = np.flatnonzero(there & (hot | (sums >= least)))
            some = [c.take(pa.array(keep)) for c in columns[: n + 1]]
            return some[0], pc.binary_join_element_wise(*some[1:], b" "), sums[keep], ~hot[keep]

        def batch(n, columns, sums):
            lang, phrase, f, whole = closed(n, columns, sums)
            return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(f), n), pa.int32()), phrase, pa.array(f, pa.int64()), pa.array(whole)], names=["lang", "words", "phrase", "f", "whole"])

        def single(values):
            return [pa.array([v], pa.string() if not k else pa.binary()) for k, v in enumerate(values)]

        for b in batches:
            if not b.num_rows:
                continue
            columns, n = b.columns[:-1], b.columns[-1].to_numpy().astype(np.int64)
            first = [c[0].as_py() for c in columns]
            new = np.zeros(len(n), dtype=bool)
            for k, c in enumerate(columns):
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
                new[0] |= top is None or first[k] != top[k]
                at = np.flatnonzero(new)
                if not len(at):
                    counts[k] += n.sum()
                    continue
                if top is not None:
                    yield batch(k, single(top), np.array([counts[k] + n[: at[0]].sum()]))
                sums = np.add.reduceat(n, at)
                counts[k] = sums[-1]
                if len(at) > 1:
                    yield batch(k, [c.take(pa.array(at[:-1])) for c in columns], sums[:-1])
            top = [c[len(n) - 1].as_py() for c in columns]
        if top is not None:
            for k in range(max_n + 1):
                yield batch(k, single(top), np.array([counts[k]]))

    return ordered.mapInArrow(run, "lang string, words int, phrase binary, f long, whole boolean")


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", *, max_n: int = MAX_N, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """(lang, words, phrase, f) of phrases of 1 to max_n words that come at least ``least`` times in a language.

    The row of 0 words has the number of all words of the language. The table is written.
    """
    spark = docs.sparkSession
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    c = lambda name: F.col(names[docs.columns.index(name)])
    texts = docs.toDF(*names).select(F.coalesce(c(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(c(text), F.lit("")).cast("binary").alias("text"))
    total, heavy = _heavy(texts, max_n, parts or max(PARTS, 2 * deals))
    dealt = _packed(texts, max_n, heavy).repartition(max(deals, 1 + total // SUFFIXES_A_TASK), "lang", "key")
    order = [F.col(n).desc() for n in ("lang", *(f"w{k}" for k in range(1, max_n + 1)))]
    # Few rows, and each is needed twice: whole counts, and parts of counts that are still to be added up.
    found = materialize(_counted(_unpacked(dealt, max_n).sortWithinPartitions(*order), max_n, heavy, least))
    added = found.where(~F.col("whole")).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    return materialize(found.where("whole").drop("whole").unionByName(added).withColumn("phrase", F.col("phrase").cast("string")))


def _part(words: Column, start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", *, max_n: int = MAX_N, least: int = LEAST, contained: int = CONTAINED, top: int = TOP, parts: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to max_n words of each language.

    Texts are lower-cased (A-Z), null ones are empty, and languages that are
    null are ``und``. Rows that are equal count as often as they come. Scores
    are whole numbers below or equal to ``SCALE``; ties of a language go to the more
    frequent phrase, then to the smaller one in byte order. An empty table has no
    phrases, and further columns, whatever their names, are not looked at.
    """
    counts = count_phrases(docs, text, lang, max_n=max_n, least=least, parts=parts)
    candidates = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    plain = counts.where("words >= 1").select("lang", "phrase", "f")
    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left, right = plain.toDF("lang", "first", "l"), plain.toDF("lang", "rest", "r")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"({SCALE}BD * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = candidates.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = longer.groupBy("lang", _part(F.col("w"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < contained * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("b.score").alias("score"), F.col("b.l").alias("l"), F.col("b.r").alias("r"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").cast("binary")]
    # The best of each bucket first, so that a language's last sort has few rows however many tasks there are.
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("bucket")
    kept = kept.select("*", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of two and three words of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """Every phrase counted one by one."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p FROM i WHERE i + {k - 1} <= len(w)" for k in range(1, MAX_N + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, p, f, {n} AS k, {cut} AS cut, array_to_string(string_split(p, ' ')[:{cut}], ' ') AS x, array_to_string(string_split(p, ' ')[{cut + 1}:], ' ') AS y FROM c WHERE k = {n}" for n in range(2, MAX_N + 1) for cut in range(1, n))
    inner = " UNION ALL ".join(f"SELECT lang, f, array_to_string(string_split(p, ' ')[{at}:{at + size - 1}], ' ') AS p FROM c WHERE k = {n}" for n in range(3, MAX_N + 1) for size in range(2, n) for at in range(1, n - size + 2))
    return rf"""WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(t, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    g AS ({grams}),
    n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
    s AS (SELECT u.lang, u.p, u.f, u.cut, l.f AS l, r.f AS r, ({SCALE} * u.f::HUGEINT * u.f::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score FROM ({cuts}) u JOIN c l ON l.lang = u.lang AND l.p = u.x JOIN c r ON r.lang = u.lang AND r.p = u.y),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
    o AS (SELECT lang, p, max(f) AS f FROM ({inner}) GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.f DESC, b.p) AS rank, b.p AS phrase, b.f AS a, b.l, b.r, n.n, b.score
    FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.p = b.p WHERE o.f IS NULL OR 100 * o.f < {CONTAINED} * b.f QUALIFY rank <= {TOP}"""
