"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents. Null texts count as empty ones, null and repeated
keys are keys like others, further columns pass through whatever their names,
and an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableguard.llm import decontamination, language, mixing, near_copies, secret_scan
from tableguard.llm.common import materialize, release, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters or of ambiguous language; the model learns from lang.

    If no row has a text and a language nothing can be ambiguous: all texts with
    letters stay. Null and empty texts go. An empty table stays empty. Columns
    of docs are passed through as they are, whatever their names.
    """
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    names = [f"c{k}" for k in range(len(docs.columns))]
    found = language.identify(docs.toDF(*names), model, text=names[docs.columns.index("text")])
    return found.where(~F.col("ambiguous")).select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest key stays, null only where there is no other; rows equal in key
    and text are one, and so are all texts without words.
    """
    return near_copies.keep_one(docs).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark; rows without tokens stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; n_chars follows the text, and stays where that is null."""
    clean = secret_scan.redact(secret_scan.scan_secrets(docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mix: a row for each copy of a document, with its shard; texts without words draw nothing.

    The columns that it adds (size, source_size, target, taken, copy, shard,
    words) replace any of those names.
    """
    planned = mixing.plan_mix(docs.withColumn("size", mixing.n_words(F.col("text"))), "size")
    return mixing.draw_mix(planned)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        # A written stage needs nothing of the one before; the tables of sf_dir stay.
        release(before)
    return docs


#: Learned weights and hash-driven draws have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None
