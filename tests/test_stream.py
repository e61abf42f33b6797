import math

import pytest

from tableguard import ErrorReportConfig, SchemaModel, default_registry, stateful_checks, validate_stream

UNIQUE = {"key": {"dtype": "Int64", "synonyms": ["k"], "nullable": True, "parsers": [{"name": "strip"}], "checks": [{"name": "unique"}]}, "big": {"dtype": "Int64", "nullable": True, "checks": [{"name": "unique"}, {"name": "positive"}]}}
MODEL = SchemaModel.from_dict({"profile": "clean", "columns": UNIQUE})
#: By batch: (k, big, other)
BATCHES = [
    [("1", 2**62 + 1, "a"), (" 2", 5, None), ("3", 6, "c"), ("3 ", 7, "d")],
    [("2 ", 8, "e"), ("4", 2**62 + 1, "f"), (None, 9, "g")],
    [("5", 10, "h"), (None, 9, "i"), ("4", 11, "j")],
]


def results(spark, tmp_path, remember, model=MODEL, seconds=60, **more):
    """What the sink was given: by batch, failures by column and check, and data."""
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, "k string, big long, other string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("k string, big long, other string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = {}

    def sink(result, n):
        if result.report.rows_processed:
            seen[len(seen)] = {(r.column, r.check): r["count"] for r in result.errors.collect()}, sorted(map(tuple, result.data.collect()), key=repr), result.data.columns

    writer = validate_stream(stream, model, default_registry(), sink, coerce_strategy="null_on_failure", remember=remember, **more)
    query = writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(seconds)
    query.stop()
    return seen


def test_without_memory_each_batch_is_alone(spark, tmp_path):
    got = results(spark, tmp_path, None)
    assert [got[n][0] for n in range(3)] == [{("key", "unique"): 2}, {}, {}]


def test_a_repeat_in_a_later_batch_fails(spark, tmp_path):
    """Parsed values are remembered, nulls too, large numbers exactly, each column for itself."""
    got = results(spark, tmp_path, math.inf)
    assert [got[n][0] for n in range(3)] == [{("key", "unique"): 2}, {("key", "unique"): 1, ("big", "unique"): 1}, {("key", "unique"): 2, ("big", "unique"): 1}]
    assert got[1][1] == sorted([(None, 8, "e"), (4, None, "f"), (None, 9, "g")], key=repr) and got[2][1] == sorted([(5, 10, "h"), (None, None, "i"), (None, 11, "j")], key=repr)
    assert all(names == ["key", "big", "other"] for _, _, names in got.values())


def test_row_numbers_of_a_remembering_stream(spark, tmp_path):
    got = results(spark, tmp_path, math.inf, error_report=ErrorReportConfig(mode="rows"))
    assert got[1][0] == {("key", "unique"): 1, ("big", "unique"): 1}


def test_values_are_forgotten_in_time(spark, tmp_path):
    """A millisecond's memory is over before the next batch."""
    got = results(spark, tmp_path, 0.001, seconds=25)
    assert [got[n][0] for n in range(3)] == [{("key", "unique"): 2}, {}, {}]


def test_what_has_state(spark):
    assert stateful_checks(MODEL, default_registry()) == [("key", "unique"), ("big", "unique")]
    stream = spark.readStream.format("rate").load()
    bad = SchemaModel.from_dict({"columns": {"value": UNIQUE["big"]}, "frame_parsers": [{"name": "strip_all_strings"}]})
    with pytest.raises(ValueError, match="frame parsers"):
        validate_stream(stream, bad, default_registry(), print, remember=1)
    plain = SchemaModel.from_dict({"columns": {"value": {"dtype": "Int64", "nullable": True, "checks": [{"name": "positive"}]}}})
    assert stateful_checks(plain, default_registry()) == [] and validate_stream(stream, plain, default_registry(), print, remember=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "x")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            validate_stream(stream, plain, default_registry(), print, remember=1)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
