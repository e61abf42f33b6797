"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: a token's context is the token before it (the end of a text is
also the start of the next). Each context has a restaurant of its own; they
share one parent, the restaurant of tokens without context, whose base gives
each known token the same weight. A customer opens a table or joins one by the
Chinese-restaurant rule, and each table is a customer of the restaurant above.
Unknown tokens get about the mass of tokens seen once, in equal shares for an
estimated number of unseen tokens.

Seating: a sweep draws the number of tables of every cell anew, for all of its
customers at once, from its exact distribution given the customers, the mass
that speaks for a new table and the discount (``draw_tables``); then the parent
is drawn, given its customers and its own tables of the sweep before. Cells
begin with one table each. After ``BURN`` sweeps, each of ``KEEP`` more gives a
token's probability (its context's own share, and what that leaves times the
parent's), and these are averaged. A draw's chance comes from a hash of its cell
and sweep, so scores do not depend on how rows lie.

Data flow: texts are read once, in blocks of about ``BLOCK_TOKENS`` tokens that
keep their tokens packed. Distinct tokens are counted, numbered by frequency and
sent back. A block then sends its distinct pairs of numbers, packed, to
parts of about ``PART_TOKENS`` tokens, where pairs are summed to cells; a very
common context is spread over several parts. A part keeps of each block's pairs
only their places among its cells. Numbers are dealt to ranges of about
``RANGE_IDS``, which hold the parent. A cell of one customer has one table
whatever is drawn, so only cells of more take part in sweeps: parts send ranges
their sums by context and by token, packed, and are sent what the parent has for
these. In the end parts and ranges answer the blocks in the order they asked.
Nothing but sums goes to the driver; tables that are used up are deleted on the
way.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, table

BLOCK_TOKENS = 2_000_000
PART_TOKENS = 3_000_000
RANGE_IDS = 131_072
BURN, KEEP = 1, 2
#: Cells of up to so many customers are drawn from one table of Stirling numbers.
SMALL = 1024
STRENGTH = 0.2
END = b""
LOW = np.uint64(0xFFFFFFFF)
#: Kinds of rows in a part or range, in the order they are read.
CELLS, TABLES, ASKS, SEVERAL, SUMS, WANTS, REPLIES = range(7)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of the same place lie together."""
    import zstandard as z

    out = [np.array([len(arrays)], dtype=np.int64).tobytes()]
    for x in arrays:
        out += [x.dtype.str.encode().ljust(8), np.array([len(x)], dtype=np.int64).tobytes(), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""]
    return z.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(value: bytes) -> list[np.ndarray]:
    import zstandard as z

    raw, out, at = z.ZstdDecompressor().decompress(value), [], 8
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        kind = np.dtype(raw[at : at + 8].decode().strip())
        n = int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        at += 16
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chances(cell: np.ndarray, sweep: int) -> np.ndarray:
    """For each cell a number between 0 and 1, by hash."""
    x = _mixed(cell.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (sweep + 1)) & (2**64 - 1)))
    return (_mixed(x ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)) * 2.0**-53


def _pairs(token: np.ndarray, step: int = 1 << 18):
    """For runs of tokens, where they begin and each with the one before it, as one number; a block begins after an end."""
    for a in range(0, len(token), step):
        # Each text ends with the end token, so a block's last is one.
        before = np.concatenate((token[a - 1 : a] if a else token[-1:], token[a : a + step - 1])).astype(np.uint64)
        yield a, before[: len(token) - a] << np.uint64(32) | token[a : a + step].astype(np.uint64)


def _blocks(docs: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    """Rows of blocks: one with the packed texts (at = -1), then one for each
    distinct token, with its training count."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType

    kind = docs.schema[key].dataType.simpleString()
    keys_type = to_arrow_type(ArrayType(docs.schema[key].dataType))

    def pack(number, keys, held, ids, lengths, words):
        names, token, length = list(words), np.concatenate(ids), np.array(lengths, dtype=np.int32)
        trains = np.repeat(~np.array(held, dtype=bool), length)

        def rows(size, **columns):
            kinds = {"block": pa.int64(), "at": pa.int32(), "word": pa.binary(), "n": pa.int32(), "keys": keys_type, "texts": pa.binary()}
            columns["block"] = np.full(size, number)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

        yield rows(1, at=[-1], keys=[keys], texts=[_packed(length, np.array(held, dtype=np.uint8), token)])
        n = np.bincount(token[trains], minlength=len(names))
        for a in range(0, len(names), 65536):
            part = names[a : a + 65536]
            yield rows(len(part), at=np.arange(a, a + len(part)), word=part, n=n[a : a + 65536])

    def run(batches):
        from collections import defaultdict

        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            return [], [], [], [], words

        keys, held, ids, lengths, words = fresh()
        tokens = 0
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                for k, t, out in zip(*(c.to_pylist() for c in part.columns)):
                    row = (t or "").encode("utf-8", "surrogatepass").lower().split()
                    row.append(END)
                    ids.append(np.fromiter(map(words.__getitem__, row), np.int32, len(row)))
                    keys.append(k)
                    held.append(out)
                    lengths.append(len(row))
                    tokens += len(row)
                    if tokens >= BLOCK_TOKENS:
                        yield from pack(number, keys, held, ids, lengths, words)
                        words.default_factory = None  # else the numbering keeps itself alive
                        keys, held, ids, lengths, words = fresh()
                        number, tokens = number + 1, 0
        if keys:
            yield from pack(number, keys, held, ids, lengths, words)
        words.default_factory = None

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (~training).alias("_held"))
    return rows.mapInArrow(run, f"block long, at int, word binary, n int, keys array<{kind}>, texts binary")


def _stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t - 1] weighs t tables of c customers."""
    out = np.full((most + 1, most), -np.inf)
    out[1, 0] = 0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            out[c + 1, : c + 1] = out[c, : c + 1] + np.log(np.maximum(c - discount * t[: c + 1], 0))
            out[c + 1, 1 : c + 1] = np.logaddexp(out[c + 1, 1 : c + 1], out[c, :c])
    return out


def _tables_of_large(c: int, mass: float, discount: float) -> tuple[int, np.ndarray]:
    """Distribution of the number of tables of a cell of very many customers: its first place, and weights.

    Weights are coefficients of z ** c in (mass * (1 - (1 - z) ** d) / d) ** t / t!,
    taken as a contour integral through the saddle point of the likeliest t: on
    a parabola around the cut of w = 1 - z, or on a circle around z = 0 where
    that is nearer, the trapezoid rule is exact up to rounding.
    """
    d = discount
    x = np.log((c + 1) / mass)
    low, high = -700.0, -1e-12
    for _ in range(80):  # the saddle point, by its logarithm
        mid = (low + high) / 2
        low, high = (mid, high) if (d - 1) * mid + np.log1p(-np.exp(mid)) > x else (low, mid)
    w = float(np.exp(high))
    likely = mass * (1 - w**d) / d
    if w > 0.05:
        phi = np.linspace(0, np.pi, 16 * int(np.sqrt(c)) + 64)
        path = 1 - (1 - w) * np.exp(1j * phi)
        rest, ends = -1j * c * phi, (0, np.pi)
    else:
        w = max(w, 3 / c)
        bend = (c + 1) / (1 - w) ** 2 + likely * (d * (1 - d) * w ** (d - 2) / (1 - w**d) - d * d * w ** (2 * d - 2) / (1 - w**d) ** 2)
        far = 1 / np.sqrt(2 * c * w)
        h = min(far / 4, 1 / 6, 1 / np.sqrt(bend) / (8 * w) if bend > 0 else 1)
        phi = h * np.arange(int(9 * far / h) + 2)
        path = w * (1 + 1j * phi) ** 2
        rest, ends = np.log(1 + 1j * phi) - (c + 1) * np.log(1 - path), (0,)
    log_g = np.log((1 - path**d) / d)
    near = int(np.clip(round(likely), 1, c))
    top = near * log_g + rest
    use = top.real > top.real.max() - 45
    g, start = np.exp(log_g[use]) * mass, np.exp(top[use] - top.real.max()) * np.where(np.isin(phi[use], ends), 1.0, 2.0)
    # From the likeliest t both ways, until weights are lost in rounding.
    up, down = [start.real.sum()], []
    v, t = start, near
    while t < c and up[-1] > 1e-15 * up[0]:
        t += 1
        v = v * (g / t)
        up.append(v.real.sum())
    v, t, over = start, near, 1 / g
    while t > 1 and (not down or down[-1] > 1e-15 * up[0]):
        v = v * (over * t)
        t -= 1
        down.append(v.real.sum())
    return t, np.maximum(down[::-1] + up, 0)


def draw_tables(customers: np.ndarray, mass: np.ndarray, discount: float, chance: np.ndarray, made: dict | None = None) -> np.ndarray:
    """Tables of each cell, drawn given that all its customers sit down anew.

    The chance of t tables of c customers is in proportion to mass ** t times a
    generalised Stirling number. ``mass`` is what speaks for a new table: (strength
    + discount * tables of the restaurant) * parent's probability, and fixed.
    ``chance``, between 0 and 1, picks from the distribution. ``made`` keeps tables of
    Stirling numbers from one call to the next, for a task that makes many.
    """
    made = {} if made is None else made
    tables = np.ones(len(customers), dtype=np.int64)
    m = np.maximum(mass, 1e-300)
    order = np.argsort(customers, kind="stable")
    order = order[np.searchsorted(customers[order], 2) :]
    values, starts = np.unique(customers[order], return_index=True)
    small = values[values <= SMALL]
    # Few sizes, so that a task makes each table once.
    log_s = None
    if len(small):
        which = 1 << (int(small[-1]) - 1).bit_length(), discount
        log_s = made[which] = made[which] if which in made else _stirling(*which)
    for c, cells in zip(values.tolist(), np.split(order, starts[1:]) if len(order) else ()):
        for at in range(0, len(cells), max(1, 2**20 // c)) if c <= SMALL else ():
            some = cells[at : at + max(1, 2**20 // c)]
            x = log_s[c, :c] + np.log(m[some])[:, None] * np.arange(1, c + 1)
            sums = np.exp(x - x.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[some] = 1 + (sums < (chance[some] * sums[:, -1])[:, None]).sum(axis=1)
        for cell in cells if c > SMALL else ():
            low, p = _tables_of_large(c, float(m[cell]), discount)
            sums = p.cumsum()
            tables[cell] = low + np.searchsorted(sums, chance[cell] * sums[-1], side="right")
    return tables


def _discount(once: int, twice: int) -> float:
    return round(float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95)), 6)


def _numbered(words: DataFrame) -> DataFrame:
    """words (word, c) with ``id``, materialized: places by falling count, then by word."""
    by = [F.desc("c"), F.asc("word")]
    held = materialize(words.repartitionByRange(*by).sortWithinPartitions(*by).select("word", "c", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    # A row for each partition.
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    placed = held.withColumn("part", part).join(F.broadcast(starts), "part")
    out = materialize(placed.select("word", "c", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")))
    release(held)
    return out


def _parts_of(u: np.ndarray, w: np.ndarray, cu: np.ndarray, parts: int, train_tokens: int) -> np.ndarray:
    """The part of each pair; a context with more than a quarter of a part's tokens is spread over several."""
    pieces = (1 + 4 * parts * cu.astype(np.float64) / max(1, train_tokens)).astype(np.uint64)
    return ((_mixed(u) + _mixed(w + np.uint64(7)) % pieces) % np.uint64(parts)).astype(np.int32)


class _Asked:
    """A block's distinct pairs of numbers in order of part and key.

    ``part`` and ``cu``, the context's count, are by pair; ``before`` and ``last`` are
    its tokens within the block. Pairs of tokens are made run by run: a block's are
    most of what a task holds.
    """

    def __init__(self, token: np.ndarray, ids: np.ndarray, c: np.ndarray, parts: int, train_tokens: int):
        self.token = token
        self.pair, _ = self._distinct()
        n = len(self.pair)
        key, part = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.int32)
        for a in range(0, n, 1 << 18):
            some = self.pair[a : a + (1 << 18)]
            before = (some >> np.uint64(32)).astype(np.int32)
            u, w = ids[before].astype(np.uint64), ids[(some & LOW).astype(np.int32)].astype(np.uint64)
            key[a : a + len(some)], part[a : a + len(some)] = u << np.uint64(32) | w, _parts_of(u, w, c[before], parts, train_tokens)
        order = np.lexsort((key, part)).astype(np.int32)
        self.part, self.key = part[order], key[order]
        del part, key
        self.before, self.last = (self.pair >> np.uint64(32)).astype(np.int32)[order], (self.pair & LOW).astype(np.int32)[order]
        self.place = np.empty(n, dtype=np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)

    def _distinct(self, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the tokens to use, and where each begins among all in order."""
        out = np.empty(len(self.token) if use is None else int(use.sum()), dtype=np.uint64)
        at = 0
        for a, some in _pairs(self.token):
            some = some if use is None else some[use[a : a + len(some)]]
            out[at : at + len(some)] = some
            at += len(some)
        out.sort()
        starts = np.flatnonzero(_changes(out))
        return out[starts], np.append(starts, len(out))

    def places(self):
        """For each run of tokens, the places of their pairs."""
        for a, some in _pairs(self.token):
            yield a, self.place[np.searchsorted(self.pair, some)]

    def counts(self, use: np.ndarray) -> np.ndarray:
        """How often each pair comes among the tokens to use."""
        some, starts = self._distinct(use)
        n = np.zeros(len(self.part), dtype=np.int32)
        n[self.place[np.searchsorted(self.pair, some)]] = np.diff(starts)
        return n


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=bool)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cuts = np.flatnonzero(_changes(x))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)]))


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.uint32)


def _places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def _pack_keys(key: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys: contexts, with their numbers of pairs, and steps between the tokens of each."""
    u, w = (key >> np.uint64(32)).astype(np.uint32), (key & LOW).astype(np.uint32)
    starts = np.flatnonzero(_changes(u))
    steps = np.diff(w, prepend=np.uint32(0))
    steps[starts] = w[starts]
    return _packed(np.diff(u[starts], prepend=np.uint32(0)), np.diff(np.append(starts, len(u))).astype(np.uint32), steps, *more)


def _unpack_keys(value: bytes):
    contexts, sizes, steps, *more = _unpacked(value)
    u, w = np.repeat(np.cumsum(contexts, dtype=np.uint64), sizes), np.cumsum(steps, dtype=np.uint64)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    w -= np.repeat(w[starts] - steps[starts], sizes)
    return u << np.uint64(32) | w, *more


def _sides(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The contexts of keys, then their tokens: distinct numbers, and the place of each key's among them."""
    return [np.unique(x.astype(np.int64), return_inverse=True) for x in (key >> np.uint64(32), key & LOW)]


def _dealt(ids: np.ndarray, ranges: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each range, which of the distinct numbers are its own, and their places in it."""
    r = ids % ranges
    order = np.lexsort((ids, r))
    return {int(r[order[a]]): (order[a:e], ids[order[a:e]] // ranges) for a, e in _runs(r[order])}


def _messages(sides, ranges: int, *columns):
    """(range, value) for each range with numbers of either side: places of contexts with their columns, then of tokens."""
    deals, none = [_dealt(ids, ranges) for ids, _ in sides], np.zeros(0, dtype=np.int64)
    for r in sorted(deals[0].keys() | deals[1].keys()):
        out = []
        for k, deal in enumerate(deals):
            which, place = deal.get(r, (none, none))
            out += [_steps(place), *(x[k][which] for x in columns)]
        yield r, _packed(*out)


def _tallies(key: np.ndarray, tables: np.ndarray | None, ranges: int):
    """(range, value) of the tables of each context and of each token; one a key if none are given."""
    if tables is None:
        sides = [np.unique(x.astype(np.int64), return_counts=True) for x in (key >> np.uint64(32), key & LOW)]
        return _messages(sides, ranges, [n for _, n in sides])
    sides = _sides(key)
    return _messages(sides, ranges, [np.bincount(at, weights=tables, minlength=len(ids)).astype(np.int64) for ids, at in sides])


def _row(part: int, kind: int, block: int, value: bytes, **sums: int):
    """A row for a part or range."""
    import pyarrow as pa

    kinds = {"part": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "value": pa.binary()}
    columns = {"part": part, "kind": kind, "block": block, "value": value, **sums}
    return pa.RecordBatch.from_arrays([pa.array([x], kinds.get(c, pa.int64())) for c, x in columns.items()], names=list(columns))


def _to_block(block: int, at: int, value: bytes):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int32()), pa.array([value], pa.binary())], names=["block", "at", "texts"])


def _grouped(batches, columns: int):
    """(value of the first column, rows) for each run of equal values, rows as lists of the others."""
    from pyarrow.types import is_binary

    now, rows = None, []
    for b in batches:
        for key, *rest in zip(*(c if is_binary(c.type) else c.to_pylist() for c in b.columns[:columns])):
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(rest)
    if rows:
        yield now, rows


def score_texts(docs: DataFrame, training: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    The model and the base learn from rows where ``training`` holds; all rows
    are scored. Null texts are empty: one end token. Rows with null or repeated
    keys are scored like others, equal texts alike. Scores do not depend on the
    order or partitions of docs, but for rounding. If no row trains, every token
    is unknown. Other columns take no part; no rows, no rows.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    keys_type = to_arrow_type(docs.schema[key].dataType)
    free = spark.sparkContext._jvm.System.gc  # frees the files of shuffles that are done with

    blocks = materialize(_blocks(docs, key, text, training))
    tokens, texts = blocks.where("at >= 0").select("block", "at", "word", "n"), blocks.where("at < 0").select("block", "at", "keys", "texts")
    words = _numbered(tokens.groupBy("word").agg(F.sum("n").alias("c")))
    free()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("V"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), F.count_if(F.col("c") == 0).alias("new")).first()
    train_tokens, known = seen.n, max(1, seen.V)
    # Unseen tokens: a lower bound from those seen once and twice, and those that are met here.
    unseen = max(1, seen.new, seen.once * (seen.once - 1) // (2 * (seen.twice + 1)))
    parts, ranges, total = max(1, -(-train_tokens // PART_TOKENS)), max(1, -(-(seen.V + seen.new) // RANGE_IDS)), seen.V + seen.new
    of_part, of_block = "part int, kind int, block long, value binary", "block long, at int, texts binary"

    def at(number: int, *tables: DataFrame) -> DataFrame:
        """Rows of so many parts, or ranges, one part after another; their few bytes hold much work."""
        out = tables[0].select("part", "kind", "block", "value")
        for t in tables[1:]:
            out = out.unionByName(t.select("part", "kind", "block", "value"))
        return out.repartition(2 * number, "part").sortWithinPartitions("part", "kind", "block")

    def at_blocks(*answers: DataFrame) -> DataFrame:
        """Blocks one after another: texts first, then what was answered."""
        out = texts
        for a in answers:
            out = out.unionByName(a, allowMissingColumns=True)
        return out.select("block", "at", "texts", "keys").repartition(2 * max(1, several), "block").sortWithinPartitions("block", "at")

    def pack_numbers(batches):
        """For each block one row with its share of this partition."""
        held = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
        if held:
            block, at, ids, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, block))
            block, at, ids, c = block[order], at[order], ids[order], c[order]
            for a, e in _runs(block):
                yield _to_block(int(block[a]), 0, _packed(_steps(at[a:e]), ids[a:e], c[a:e]))

    def number(batches):
        """For each block one row: numbers and counts of its tokens, in their order there."""
        for block, rows in _grouped(batches, 3):
            at, ids, c = (np.concatenate(x) for x in zip(*((_places(steps), *more) for steps, *more in (_unpacked(value.as_py()) for _, value in rows))))
            order = np.argsort(at)
            yield _to_block(block, 0, _packed(ids[order], c[order]))

    packed = tokens.join(words, "word").select("block", "at", "id", "c").mapInArrow(pack_numbers, of_block)
    numbered = materialize(packed.repartition("block").sortWithinPartitions("block").mapInArrow(number, of_block))
    several = numbered.count()
    free()

    def ask(batches):
        for block, rows in _grouped(batches, 4):
            length, held, token = _unpacked(rows[0][1].as_py())
            pairs = _Asked(token, *_unpacked(rows[1][1].as_py()), parts, train_tokens)
            n = pairs.counts(np.repeat(held == 0, length))
            for a, e in _runs(pairs.part):
                yield _row(int(pairs.part[a]), ASKS, block, _pack_keys(pairs.key[a:e], n[a:e]))

    def add_up(batches):
        """Of each part: places of asked pairs among its cells, pairs that training saw; customers of
        cells; cells of more than one customer, with a table each; tables of the others, for ranges."""
        for part, rows in _grouped(batches, 4):
            asked = [(block, *_unpack_keys(value.as_py())) for _, block, value in rows]
            k = np.concatenate([k[n > 0] for _, k, n in asked])
            order = np.argsort(k).astype(np.int32)
            k = k[order]
            starts = np.flatnonzero(_changes(k))
            cells = k[starts]
            del k
            n = np.concatenate([n[n > 0] for *_, n in asked])[order]
            c = np.add.reduceat(n, starts, dtype=np.int64) if len(n) else np.zeros(0, dtype=np.int64)
            del n, order, starts
            many = c > 1
            yield _row(part, CELLS, -1, _packed(c), twice=int((c == 2).sum()))
            yield _row(part, SEVERAL, -1, _pack_keys(cells[many], c[many], np.ones(many.sum(), dtype=np.int32), np.zeros(many.sum(), dtype=np.int32)), twice=0)
            for r, value in _tallies(cells[~many], None, ranges):
                yield _row(r, SUMS, part, value, twice=0)
            while asked:
                block, k, _ = asked.pop()
                at = np.searchsorted(cells, k)
                met = cells[np.minimum(at, len(cells) - 1)] == k if len(cells) else np.zeros(len(k), dtype=bool)
                yield _row(part, ASKS, block, _packed(_steps(at[met]), np.packbits(met), np.array([len(k)])), twice=0)

    asks = at_blocks(numbered).mapInArrow(ask, of_part)
    parted = materialize(at(parts, asks).mapInArrow(add_up, f"{of_part}, twice long"))
    free()
    d2_twice = parted.agg(F.coalesce(F.sum("twice"), F.lit(0))).first()[0]

    def deal(batches):
        """Counts of tokens, for ranges."""
        held = [[b.column(k).to_numpy() for k in range(2)] for b in batches if b.num_rows]
        if held:
            ids, c = (np.concatenate(x) for x in zip(*held))
            for r, (which, place) in _dealt(ids, ranges).items():
                yield _row(r, CELLS, -1, _packed(_steps(place), c[which]))

    def begin(batches):
        """Of each range: counts of tokens, tables of cells of one customer by context and by token."""
        for r, rows in _grouped(batches, 4):
            c, tu, tw = (np.zeros(-(-(total - r) // ranges), dtype=np.int64) for _ in range(3))
            for kind, _, value in rows:
                if kind == CELLS:
                    place, x = _unpacked(value.as_py())
                    c[_places(place)] = x
                else:
                    u, of_u, w, of_w = _unpacked(value.as_py())
                    tu[_places(u)] += of_u
                    tw[_places(w)] += of_w
            yield _row(r, CELLS, -1, _packed(c, tu, tw), once=int(tu.sum()))

    entries = materialize(at(ranges, words.select("id", "c").mapInArrow(deal, of_part), parted.where(F.col("kind") == SUMS)).mapInArrow(begin, f"{of_part}, once long"))
    d2 = _discount(entries.agg(F.coalesce(F.sum("once"), F.lit(0))).first()[0], d2_twice)
    release(words)
    free()

    def tally(batches):
        for b in batches:
            for part, value in zip(b.column(0).to_pylist(), b.column(3)):
                k, _, t, _ = _unpack_keys(value.as_py())
                for r, x in _tallies(k, t, ranges):
                    yield _row(r, SUMS, part, x)

    def add_tables(batches):
        """Tables of each context, and customers of the parent: one for each table of a cell."""
        for r, rows in _grouped(batches, 4):
            c, tu, n0 = (x.copy() for x in _unpacked(rows[0][2].as_py()))
            for *_, value in rows[1:]:
                u, of_u, w, of_w = _unpacked(value.as_py())
                tu[_places(u)] += of_u
                n0[_places(w)] += of_w
            yield _row(r, CELLS, -1, _packed(c, tu, n0), n=int(n0.sum()), once=int((n0 == 1).sum()), twice=int((n0 == 2).sum()), tu=int(tu.sum()), contexts=int((c > 0).sum()))

    def want(batches):
        """What each part needs of each range: tables of contexts, seating of tokens."""
        for b in batches:
            for part, value in zip(b.column(0).to_pylist(), b.column(3)):
                for r, x in _messages(_sides(_unpack_keys(value.as_py())[0]), ranges):
                    yield _row(r, WANTS, part, x)

    def serve(batches):
        for r, rows in _grouped(batches, 4):
            _, tu, n0, t0 = _unpacked(rows[0][2].as_py())
            for _, part, value in rows[1:]:
                u, w = map(_places, _unpacked(value.as_py()))
                yield _row(part, REPLIES, r, _packed(tu[u], n0[w], t0[w]))

    now, tables0 = parted.where(F.col("kind") == SEVERAL), float(known)
    kept: list[DataFrame] = []
    levels: list[tuple[float, float, float, float]] = []
    for sweep in range(BURN + KEEP + 1):
        upper = materialize(at(ranges, entries, now.select("part", "kind", "block", "value").mapInArrow(tally, of_part)).mapInArrow(add_tables, f"{of_part}, n long, once long, twice long, tu long, contexts long"))
        sums = upper.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "once", "twice", "tu", "contexts"))).first()
        d0 = _discount(sums.once, sums.twice)

        def seat(batches, mass=(STRENGTH + d0 * tables0) / known, d0=d0, sweep=sweep):
            made: dict = {}
            for b in batches:
                for r, value in zip(b.column(0).to_pylist(), b.column(3)):
                    c, tu, n0 = _unpacked(value.as_py())
                    t = draw_tables(n0, np.full(len(n0), mass), d0, chances(np.arange(len(n0)) * ranges + r, 1000 + sweep), made) * (n0 > 0)
                    yield _row(r, CELLS, sweep, _packed(c, tu, n0, t), tables=int(t.sum()))

        seated = materialize(upper.select("part", "kind", "block", "value").mapInArrow(seat, f"{of_part}, tables long"))
        tables0 = float(seated.agg(F.coalesce(F.sum("tables"), F.lit(0))).first()[0])
        escape = (STRENGTH + d0 * tables0) / (STRENGTH + sums.n)
        leave = min(1.0, (STRENGTH * sums.contexts + d2 * sums.tu) / max(1, train_tokens) if train_tokens else 1.0)
        # Unknown tokens together get about the share of tokens seen once.
        unknown = float(np.clip(seen.once / max(1, train_tokens) / max(1e-9, leave * escape), 0.01, 0.99))
        level = d0, STRENGTH + sums.n, escape * (1 - unknown) / known, escape * unknown / unseen
        release(upper)
        if sweep > BURN:
            kept.append(seated)
            levels.append(level)
        if sweep == BURN + KEEP:
            break

        def draw(batches, sweep=sweep, level=level):
            made: dict = {}
            d0, guests, base, _ = level
            for part, rows in _grouped(batches, 4):
                k, c, _, ts = _unpack_keys(rows[0][2].as_py())
                (u, at_u), (w, at_w) = _sides(k)
                of_u, of_w = _dealt(u, ranges), _dealt(w, ranges)
                mass, p = np.zeros(len(u)), np.zeros(len(w))
                for _, r, value in rows[1:]:
                    tu, n0, t0 = _unpacked(value.as_py())
                    if r in of_u:
                        mass[of_u[r][0]] = STRENGTH + d2 * tu
                    if r in of_w:
                        p[of_w[r][0]] = np.maximum(n0 - d0 * t0, 0) / guests + base
                t = draw_tables(c, mass[at_u] * p[at_w], d2, chances(k, sweep), made)
                yield _row(part, SEVERAL, -1, _pack_keys(k, c, t.astype(np.int32), (ts + t * (sweep >= BURN)).astype(np.int32)))

        replies = at(ranges, now.select("part", "kind", "block", "value").mapInArrow(want, of_part), seated).mapInArrow(serve, of_part)
        then = materialize(at(parts, now, replies).mapInArrow(draw, of_part))
        release(*([now] if sweep else []), *([seated] if sweep <= BURN else []))
        now = then
        free()
    release(entries)
    free()

    def tables_only(batches):
        for b in batches:
            for part, value in zip(b.column(0).to_pylist(), b.column(3)):
                yield _row(part, TABLES, -1, _packed(_unpack_keys(value.as_py())[3]))

    def answer(batches):
        """Customers and kept tables of each pair, in the order of the ask: whole numbers, which pack well."""
        for part, rows in _grouped(batches, 4):
            c = tables = np.zeros(0, dtype=np.int64)
            for kind, block, value in rows:
                if kind == CELLS:
                    (c,) = _unpacked(value.as_py())
                    tables = np.full(len(c), KEEP, dtype=np.int32)
                elif kind == TABLES:
                    (tables[c > 1],) = _unpacked(value.as_py())
                else:
                    steps, bits, size = _unpacked(value.as_py())
                    met, at = np.unpackbits(bits, count=int(size[0])).astype(bool), _places(steps)
                    got = np.zeros(len(met), dtype=np.int64), np.zeros(len(met), dtype=np.int32)
                    got[0][met], got[1][met] = c[at], tables[at]
                    yield _to_block(block, 1 + ranges + part, _packed(*got))

    def want_words(batches):
        for b in batches:
            for block, value in zip(b.column(0).to_pylist(), b.column(2)):
                for r, (_, place) in _dealt(_unpacked(value.as_py())[0], ranges).items():
                    yield _row(r, WANTS, block, _packed(_steps(place)))

    def serve_words(batches):
        """Seating of a block's tokens in each kept sample: whole numbers too."""
        for r, rows in _grouped(batches, 4):
            held = [x for _, _, value in rows[:KEEP] for x in _unpacked(value.as_py())[1:]]
            for _, block, value in rows[KEEP:]:
                place = _places(_unpacked(value.as_py())[0])
                yield _to_block(block, 1 + r, _packed(*(x[place] for x in held)))

    cells = parted.where(F.col("kind").isin(CELLS, ASKS))
    of_pairs = at(parts, cells, now.select("part", "kind", "block", "value").mapInArrow(tables_only, of_part)).mapInArrow(answer, of_block)
    of_tokens = at(ranges, *kept, numbered.mapInArrow(want_words, of_part)).mapInArrow(serve_words, of_block)
    denominator = train_tokens + seen.V + 1

    def finish(batches):
        for _, rows in _grouped(batches, 4):
            length, held, token = _unpacked(rows[0][1].as_py())
            ids, c = _unpacked(rows[1][1].as_py())
            pairs, dealt = _Asked(token, ids, c, parts, train_tokens), _dealt(ids, ranges)
            by_pair, seated = np.zeros(len(pairs.part)), [np.zeros(len(ids), dtype=np.int64) for _ in range(3 * KEEP)]
            for at, value, _ in rows[2:]:
                got = _unpacked(value.as_py())
                if at <= ranges:
                    for x, y in zip(seated, got):
                        x[dealt[at - 1][0]] = y
                else:
                    customers, tables = got
                    where = slice(*np.searchsorted(pairs.part, (at - 1 - ranges, at - ranges)))
                    # Linear in tables, so their sum gives the sum over samples.
                    by_pair[where] = (KEEP * customers - d2 * tables) / (STRENGTH + c[pairs.before[where]])
            for (d0, guests, base, new), tu, n0, t0 in zip(levels, seated[0::3], seated[1::3], seated[2::3]):
                p = np.where(c > 0, np.maximum(n0 - d0 * t0, 0) / guests + base, new)
                leave = np.where(c > 0, (STRENGTH + d2 * tu) / (STRENGTH + c), 1.0)
                for a in range(0, len(by_pair), 1 << 18):
                    some = slice(a, a + (1 << 18))
                    by_pair[some] += leave[pairs.before[some]] * p[pairs.last[some]]
            by_pair /= KEEP
            np.log10(np.maximum(by_pair, 1e-300, out=by_pair), out=by_pair)
            log_p = np.empty(len(token))
            for a, place in pairs.places():
                log_p[a : a + len(place)] = by_pair[place]
            del pairs, by_pair, seated
            starts = np.cumsum(length, dtype=np.int64) - length
            sums = lambda x: np.add.reduceat(x, starts)
            columns = [
                pa.array(rows[0][2], keys_type), pa.array(held > 0), pa.array(length.astype(np.int64)), pa.array(sums((c > 0).astype(np.int64)[token])), pa.array(np.full(len(length), train_tokens, dtype=np.int64)),
                pa.array(sums(np.log10((c + 1) / denominator)[token])), pa.array(sums(log_p)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = at_blocks(numbered, of_tokens, of_pairs).mapInArrow(finish, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Score of each document by the model and by the base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, ~held_out(F.col("doc_id")))

