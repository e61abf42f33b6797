import zlib

import numpy as np

from tableguard.llm import language as lang


def test_held_out_accuracy(spark, data):
    got = lang.op8_language_id(spark, data).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_labels_and_names_are_no_input(spark, data):
    """Predictions stay when the labels of held-out rows change."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = lang.train(docs.where(~lang.held_out(F.col("doc_id"))))
    a = lang.identify(docs, model).select("doc_id", "lang_pred").collect()
    b = lang.identify(docs.withColumn("lang", F.lit("xx")).repartition(3), model).select("doc_id", "lang_pred").collect()
    assert sorted(a) == sorted(b)


def test_edge_texts(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("aaa bab abba", "a"), ("ccc dcd cddc", "c"), ("abab", "a"), ("cdcd", "c"), ("nothing", None)])]
    model = lang.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "c"]
    tried = [(1, None), (2, ""), (3, "123 !? 45"), (4, "abba"), (None, "cddc"), (5, "CDC " * 300_000), (5, "cdc"), (6, "퟿ é")]
    got = lang.identify(spark.createDataFrame([(a, b, 0.5) for a, b in tried], "doc_id long, text string, score double"), model).collect()
    assert [r.lang_pred for r in got][:7] == ["und", "und", "und", "a", "c", "c", "c"]
    assert all(r.score == 0 and r.ambiguous for r in got[:3]) and got[0].text is None


def test_no_or_one_language(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "x")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lang.identify(docs, lang.train(docs)).collect()] == ["und", "und"]
    one = spark.createDataFrame([(1, "abc", "x"), (2, "123", "x")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lang.identify(one, lang.train(one)).collect()] == ["x", "und"]
    assert lang.identify(one.where("false"), lang.train(one)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'some text here' AS text", "if(id % 5 = 0, 'x', 'y') AS lang")
    seen = []
    real = lang.fit
    lang.fit = lambda x, y, names: seen.append(np.bincount(y).tolist()) or real(x, y, names)
    try:
        lang.train(docs, per_language=20)
    finally:
        lang.fit = real
    assert seen == [[20, 20]]


def sampled(monkeypatch, docs, **more):
    """How many rows of each language a fit sees."""
    seen = []
    monkeypatch.setattr(lang, "fit", lambda x, y, names: seen.append(dict(zip(names, np.bincount(y).tolist()))) or names)
    lang.train(docs, **more)
    return seen[0]


def test_sample_of_null_and_equal_keys(spark, monkeypatch):
    """Rows count by key and text: neither missing nor equal keys take a language away or send all."""
    texts = spark.range(3000).selectExpr("'text of ' || translate(id, '0123456789', 'abcdefghij') AS text", "if(id % 3 = 0, 'x', 'y') AS lang")
    for key in ("cast(null AS long)", "7L", "if(lang = 'x', null, 1L)"):
        assert sampled(monkeypatch, texts.selectExpr("*", f"{key} AS doc_id"), per_language=50) == {"x": 50, "y": 50}
    same = spark.range(5000).selectExpr("1L AS doc_id", "'one text' AS text", "'x' AS lang").union(spark.createDataFrame([(2, "another", "x")], "doc_id long, text string, lang string"))
    assert sampled(monkeypatch, same) == {"x": 2}


def test_sample_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lang, "SAMPLE", 100)
    monkeypatch.setattr(lang, "LANGUAGES", 20)
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text", "'l' || (id % 500) AS lang").union(spark.range(50).selectExpr("-id", "'more text'", "'common'"))
    got = sampled(monkeypatch, docs)
    assert len(got) == 20 and "common" in got and set(got.values()) == {5}


def test_letters():
    """Numbers that are no decimal digits are no letters; letters of any script are."""
    _, n = lang.features(["½ ² ① Ⅷ", "٣ 12_3", "é", "漢字 かな", "a²b", "x" * 3])
    assert n.tolist() == [0, 0, 1, 4, 2, 3]


def test_codewords_differ():
    for n in (2, 3, 5, 6, 7, 30):
        c = lang.codewords(n)
        assert len({tuple(r) for r in c}) == n
        gap = min((a != b).sum() for i, a in enumerate(c) for b in c[:i])
        assert n <= 3 or gap >= 3


def test_ambiguous_text():
    """Features between two languages cost their codewords the same."""
    x = np.eye(lang.DIM, dtype=np.float32)[[0, 1] * 20]
    model = lang.fit(x, np.array([0, 1] * 20), ["a", "b"])
    best, score = model.decode(np.stack([x[0], x[1], (x[0] + x[1]) / 2]))
    assert list(best[:2]) == [0, 1] and score[2] < 0.5 + lang.AMBIGUOUS < score[0]


def test_ambiguous_text_among_four_languages():
    """A text between two of four languages is ambiguous, one of a single language is not."""
    x = np.eye(lang.DIM, dtype=np.float32)[[0, 1, 2, 3] * 20]
    model = lang.fit(x, np.array([0, 1, 2, 3] * 20), list("abcd"))
    tried = np.stack([x[0], x[3], (x[0] + x[1]) / 2, (x[1] + x[3]) / np.sqrt(2)])
    assert model.unsure(tried).tolist() == [False, False, True, True]


def plain_features(text: str) -> list[float]:
    """Square roots of hashed counts of letters, pairs and triples, by plain loops."""
    import math
    import re

    letters = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    letters = re.sub(r"\s+", " ", "".join(" " if c.isnumeric() and not c.isalpha() else c for c in letters))
    p, mask, counts = [ord(c) for c in letters], (1 << 64) - 1, [0] * lang.DIM
    for i in range(len(p)):
        one = p[i] * 0x9E3779B97F4A7C15 & mask
        grams = [one]
        if i + 1 < len(p):
            grams.append(one ^ p[i + 1] * 0xC2B2AE3D27D4EB4F & mask)
        if i + 2 < len(p):
            grams.append(grams[1] ^ p[i + 2] * 0x165667B19E3779F9 & mask)
        for k, x in enumerate(grams):
            counts[((x ^ x >> 29) * (0xBF58476D1CE4E5B9 + 2 * k) & mask) >> 52] += 1
    norm = math.sqrt(sum(counts))
    return [math.sqrt(c) / norm for c in counts]


def test_predictions_equal_a_plain_decoder(spark, data):
    """Each text's bits, their losses against every codeword, and the nearest one, one by one."""
    import math

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = lang.train(docs.where(~lang.held_out(docs["doc_id"])))
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 1500").limit(40).collect()] + [(-1, "½ Ⅷ straße ² १२"), (-2, "İzmir ÇA\nLI")]
    got = {r.doc_id: r for r in lang.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    weights, bias, codes, trust = (np.asarray(a, dtype=np.float64).tolist() for a in (model.weights, model.bias, model.codes, model.trust))
    for key, text in rows:
        x = [(k, v) for k, v in enumerate(plain_features(text)) if v]
        margins = [bias[j] + sum(v * weights[k][j] for k, v in x) for j in range(len(bias))]
        costs = [sum(math.log1p(math.exp(-m * bit)) * t for m, bit, t in zip(margins, code, trust)) for code in codes]
        shares = [math.exp(min(costs) - c) for c in costs]
        best, second = sorted(costs)[:2]
        assert got[key].lang_pred == model.languages[costs.index(best)] and abs(got[key].score - max(shares) / sum(shares)) < 1e-4
        assert got[key].ambiguous == (1 / (1 + math.exp(best - second)) < 0.5 + lang.AMBIGUOUS)
