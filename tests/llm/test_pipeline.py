import re
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tableguard.llm import decontamination, language, near_copies, queries, secret_scan, simhash  # noqa: E402
from tableguard.llm.common import materialize  # noqa: E402

from .test_decontamination import brute as leaks  # noqa: E402
from .test_mixing import fill  # noqa: E402
from .test_secret_scan import base  # noqa: E402
from .test_near_copies import groups  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, data):
    """What goes into and comes out of each stage, on the smallest tables and some odd rows."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = [(9001, None, "en", "src0", None), (9002, "", "en", None, 0), (9003, "12 34", None, "src1", 5), (None, "The of and that is in this from with", "en", None, 40), (5, "The of and to in that with for was this is", "en", "src1", 40), (9004, "The of and this is token = abcdefgh12345", "en", "src2", 41)]
    now, out = materialize(docs.union(spark.createDataFrame(odd, docs.schema))), {}
    for name, stage in corpus_pipeline.STAGES:
        then = materialize(stage(spark, now, data))
        out[name] = now.collect(), then.collect(), docs.columns, then.columns
        now = then
    return out


def ids(rows):
    return Counter(repr((r.doc_id, r.text)) for r in rows)


def test_schema(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (_, _, want, have) in stages.items():
        assert have == want or name == "mix"


def test_language_keeps_all_with_letters(stages):
    before, after, *_ = stages["language"]
    assert ids(after) == ids(r for r in before if re.search(r"[^\W\d_]", r.text or ""))


def test_near_copies(stages):
    """One document of each group of texts with a five-word shingle similarity of 0.8 or more."""
    before, after, *_ = stages["near_copies"]
    label = groups([r.text for r in before])
    members = defaultdict(set)
    for r, root in zip(before, label):
        members[root].add(repr((r.doc_id, r.text)))
    kept = ids(after)
    assert all(len(g & kept.keys()) == 1 for g in members.values()) and len(after) == len(members)


def test_benchmark(spark, data, stages):
    before, after, *_ = stages["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    seeds = {w for _, t in items for w in zip(*(re.findall(r"[^\W_]+", t.lower())[k:] for k in range(4)))}
    # A leak holds four equal tokens in a row somewhere; others need no full comparison.
    near = [(k, r.text) for k, r in enumerate(before) if seeds & set(zip(*(re.findall(r"[^\W_]+", r.text.lower())[k:] for k in range(4))))]
    bad = {k for k, _ in leaks(near, items)}
    assert ids(after) == ids(r for k, r in enumerate(before) if k not in bad) and bad


def test_secrets(stages):
    before, after, *_ = stages["secrets"]
    texts = {repr((r.doc_id, r.source, r.lang)): r.text for r in after}
    changed = 0
    for r in before:
        new = texts[repr((r.doc_id, r.source, r.lang))]
        if base(r.text):
            assert "[SECRET]" in new and not base(new)
            changed += 1
        elif not re.search("PRIVATE KEY|gh[pousr]_|xox|eyJ", r.text):
            assert new == r.text
    assert changed and len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)


def test_mix(stages):
    before, after, *_ = stages["mix"]
    sizes, got = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in after:
        got[r.source] += r.words
        assert r.copy in (0, 1) and 0 < r.words <= r.size and r.source_size == sizes[r.source]
    for s, target in fill(sizes).items():
        assert abs(got[s] - target) <= 0.51
    assert ids(after).keys() <= ids(before).keys()


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 0 and {"doc_id", "text", "copy", "shard", "words"} <= set(got.columns)


def test_empty_documents_and_names_that_clash(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = docs.where("doc_id < 60").selectExpr("*", *(f"cast(doc_id AS int) AS {n}" for n in ("_key", "_own", "_h", "score", "ambiguous", "fp", "_row")))
    for now in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            then = materialize(stage(spark, now, data))
            assert name == "mix" or then.columns == now.columns
            if now is not odd and docs.columns == now.columns:
                assert then.count() == 0
            elif name != "mix":
                assert all(r._key == r._own == r._h == r.score == r.ambiguous == r.fp == r._row == r.doc_id for r in then.collect())
            now = then


def test_corpus_without_labels_stays(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, docs, data).count() == 20


def test_registered():
    names = queries.queries()
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)]
    assert queries.oracle_sql().keys() <= names.keys()
    assert all(m.__doc__ for m in (decontamination, language, near_copies, secret_scan, simhash))
