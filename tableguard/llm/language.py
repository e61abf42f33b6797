"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; one binary classifier for each bit reads
hashed character n-grams (one to three, lower-cased letters, word ends marked)
and predicts the bit. A text's bits are decoded to the codeword of least
loss-weighted distance: each bit costs the logistic loss of its margin, weighted
by how reliable its classifier was on training rows. The score is how much the
nearest codeword stands out from the others, from 0 to 1, and a text whose best
two codewords cost nearly the same is flagged ambiguous.

Classifiers are fitted on the driver from a bounded sample: at most
``PER_LANGUAGE`` different texts of each of the ``LANGUAGES`` commonest languages,
``SAMPLE`` in all, those with the smallest hashes of key and text, each reduced
to ``DIM`` counts on the executors. Prediction reads every whole text, batch by
batch, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

DIM = 4096
PER_LANGUAGE = 600
SAMPLE = 12_000
LANGUAGES = 600
EPOCHS = 60
AMBIGUOUS = 0.05
UNKNOWN = "und"
_STEP = 1 << 20


def _code_points(text: str) -> np.ndarray:
    """Lower-cased letters of a text, runs of all else as one space each, and one at both ends."""
    import re

    plain = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Numbers that are no digits count as word characters too.
    numbers = [] if plain.isascii() else [ord(x) for x in set(plain) if x.isnumeric() and not x.isalpha() and not x.isdecimal()]
    if numbers:
        c = np.where(np.isin(c, np.array(numbers, dtype=np.uint32)), np.uint32(32), c)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    return c


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Square-rooted, length-normalised n-gram counts of texts, and their letters.

    Runs of other characters than letters count as one space. Long texts are
    read in pieces that overlap by two characters, so memory stays bounded.
    """
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    letters = np.zeros(len(texts), dtype=np.int64)
    for row, text in enumerate(texts):
        c = _code_points(text or "")
        letters[row] = np.count_nonzero(c != 32)
        if not letters[row]:
            continue
        c = c.astype(np.uint64)
        total = np.zeros(DIM, dtype=np.int64)
        for at in range(0, len(c), _STEP):
            p = c[at : at + _STEP + 2]
            own = min(_STEP, len(p))
            h = p * np.uint64(0x9E3779B97F4A7C15)
            two = (h[:-1] ^ (p[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))[:own]
            three = (two[: max(0, len(p) - 2)] ^ (p[2:] * np.uint64(0x165667B19E3779F9)))[:own]
            for k, x in enumerate((h[:own], two, three)):
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                total += np.bincount((x >> np.uint64(52)).astype(np.int64), minlength=DIM)
        x = np.sqrt(total.astype(np.float32))
        out[row] = x / np.linalg.norm(x)
    return out, letters


def codewords(n: int) -> np.ndarray:
    """n distinct codewords of -1 and 1, by row: all splits of up to 6 classes,
    else as many random bits as keep them far apart."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 6:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(n)], dtype=np.float32)
    rng, best = np.random.default_rng(5), None
    width = int(10 * np.ceil(np.log2(n))) + 5
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.float32), size=(n, width))
        gap = (width - (m @ m.T - 2 * width * np.eye(n, dtype=np.float32)).max()) / 2
        if best is None or gap > best[0]:
            best = gap, m
    return best[1]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Cost of each codeword (column) for each row."""
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * code) * self.trust).sum(axis=1) for code in self.codes], axis=1)

    def unsure(self, x: np.ndarray) -> np.ndarray:
        """Whether the best two codewords of each row cost nearly the same: the
        best one's share of the two probabilities is below a half and AMBIGUOUS."""
        if len(self.codes) < 2:
            return np.zeros(len(x), dtype=bool)
        two = np.partition(self.costs(x), 1, axis=1)
        return 1 / (1 + np.exp(two[:, 0] - two[:, 1])) < 0.5 + AMBIGUOUS

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword for each row, and the score."""
        cost = self.costs(x)
        p = np.exp(cost.min(axis=1, keepdims=True) - cost)
        return cost.argmin(axis=1), p.max(axis=1) / p.sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """One logistic classifier for each code bit, by full-batch gradient steps."""
    codes = codewords(len(languages))
    want = codes[y]
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    each = (1 / share[y] / len(languages))[:, None]
    w, b = np.zeros((x.shape[1], codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    for _ in range(EPOCHS):
        slope = -want * each / (1 + np.exp(np.clip(want * (x @ w + b), -30, 30)))
        w -= 20.0 * (x.T @ slope + 1e-5 * w)
        b -= 2.0 * slope.sum(axis=0)
    right = ((x @ w + b) * want > 0).astype(np.float32)
    trust = np.clip((right * each).sum(axis=0), 0.5, 1) - 0.49
    return Model(languages, codes, w, b, (trust / trust.mean()).astype(np.float32))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows with a text, a language and letters.

    The rows of a language are the different ones with the smallest hashes of
    key and text; rows repeated with both are one, null keys are keys like
    others. The number of different rows, estimated for all of a language, tells
    below which hash there will be a few more than are wanted; just these are
    reduced to counts, and those sent are cut on the executors to at most
    ``per_language`` of a language and ``SAMPLE`` in all. Of more than
    ``LANGUAGES`` languages the commonest are learned. Without any row to learn
    from the model knows no language.
    """
    spread = F.xxhash64(F.lit("sample"), F.col(key), F.col(text))
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), spread.alias("h"))
    counts = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.03).alias("n"), F.count("*").alias("all")).orderBy(F.desc("all"), "l").limit(LANGUAGES).collect()
    each = min(per_language, SAMPLE // max(1, len(counts)))
    bounds = [(r.l, min(2**63 - 1, int(min(1.0, (1.4 * each + 50) / max(1, r.n)) * 2**64) - 2**63)) for r in counts]
    limit = docs.sparkSession.createDataFrame(bounds, "l string, bound long")
    chosen = rows.join(F.broadcast(limit), "l").where("h <= bound").select("l", "t", "h")

    def run(batches):
        import pyarrow as pa

        seen = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                new = [k for k, x in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())) if not (x in seen or seen.add(x))]
                part = part.take(pa.array(new, pa.int64()))
                x, n = features(part.column(1).to_pylist())
                keep = np.flatnonzero(n)
                some = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(2).take(some), pa.array([x[i].astype(np.float16).tobytes() for i in keep], pa.binary())], names=["l", "h", "x"])

    # A few more than are wanted: a language, and a row that comes often, are small here.
    sample = chosen.mapInArrow(run, "l string, h long, x binary").groupBy("l", "h").agg(F.min("x").alias("x"))
    first = Window.partitionBy("l").orderBy("h")
    got = sorted(sample.withColumn("r", F.row_number().over(first)).where(F.col("r") <= each).collect(), key=lambda r: (r.l, r.h))
    languages = sorted({r.l for r in got})
    if not languages:
        return Model([], codewords(0), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in got], dtype=np.float32)
    return fit(x, np.array([languages.index(r.l) for r in got]), languages)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous.

    A null text, or one without letters, is ``und`` with score 0, and ambiguous;
    so is every text if the model knows no language. Texts of any length are
    read whole. Rows are handled one by one, so ties and repeated rows are rows
    like others. Other columns pass through; those three names are replaced.
    """
    from pyspark.sql import types as T

    base = docs.drop("lang_pred", "score", "ambiguous")
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        m = model
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                x, n = features(part.column(at).to_pylist())
                best, score = m.decode(x) if m.languages else (np.zeros(len(x), int), np.zeros(len(x)))
                known = (n > 0) & bool(m.languages)
                unsure = known & (m.unsure(x) if m.languages else False)
                names = [m.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
                new = [pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64()), pa.array(unsure | ~known, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return base.mapInArrow(run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of each document; learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
