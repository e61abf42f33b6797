"""What validations leave behind, how often they read, and how reports hold up with many partitions."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableguard import ErrorReportConfig, FrameShapeError, NullabilityError, SchemaModel, default_registry, kept, read_csv, read_result, validate, validate_into, write_result
from tableguard.operators import errors, rowindex

POSITIVE = {"dtype": "Int64", "nullable": True, "checks": [{"name": "positive"}]}
MODEL = SchemaModel.from_dict({"profile": "clean", "columns": {"v": POSITIVE}})


def run(df, model=MODEL, **config):
    return validate(df, model, default_registry(), error_report=ErrorReportConfig(**config))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(spark, group, f):
    """Jobs that f starts, and its result."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def counted(spark, tmp_path):
    """A table, and how many of its rows have been read so far."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    spark.range(1000).selectExpr("id - 200 AS v").write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t").mapInArrow(look, "v long"), seen


@pytest.mark.parametrize("mode", ["rows", "cells"])
def test_limit_over_2000_partitions_is_taken_in_two_steps(spark, mode):
    df = spark.range(0, 20_000, 1, 2000).selectExpr("id % 50 - 10 AS v", "id")
    got = run(df, mode=mode, limit=13).errors
    assert "Coalesce" not in plan(got) and plan(got).count("WindowGroupLimit") >= 3
    want = [k for k in range(20_000) if k % 50 - 10 <= 0][:13]
    if mode == "rows":
        assert [(r["count"], r.row_indices) for r in got.collect()] == [(13, want)]
    else:
        assert [r.row_index for r in got.collect()] == want


@pytest.mark.parametrize("partitions", [7, 700])
@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_first_rows_of_each_check(spark, limit, partitions):
    rows = [(c, k, r, None) for c in "ab" for k in ("x", "y") for r in range(0, 3000, 3 if c == "a" else 7)]
    df = spark.createDataFrame(rows, "column string, check string, row_index long, value string").repartition(7)
    got = {}
    for r in errors._first(df, limit, 3000, partitions).collect():
        got.setdefault((r.column, r.check), []).append(r.row_index)
    assert {k: sorted(v) for k, v in got.items()} == {(c, k): list(range(0, 3000, 3 if c == "a" else 7))[:limit] for c in "ab" for k in ("x", "y")}


def test_pages_of_runs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(errors, "PAGE_ROWS", 100)
    df = spark.range(0, 1000, 1, 7).selectExpr("CASE WHEN id BETWEEN 95 AND 349 OR id % 10 = 3 THEN -1 ELSE id + 1 END AS v")
    found = run(df, mode="rows", row_lists="pages").errors
    pages = found.collect()
    want = [k for k in range(1000) if 95 <= k <= 349 or k % 10 == 3]
    assert [r.row_index for r in errors.rows_of_pages(found).orderBy("row_index").collect()] == want
    assert [p.page for p in pages] == list(range(10)) and max(len(p.runs) for p in pages) <= 50 and sum(p["count"] for p in pages) == len(want)
    assert [tuple(r) for r in pages[1].runs] == [(100, 100)] and [tuple(r) for r in pages[3].runs][0] == (300, 50)
    limited = run(df, mode="rows", row_lists="pages", limit=20).errors
    assert [r.row_index for r in errors.rows_of_pages(limited).orderBy("row_index").collect()] == want[:20]
    assert run(df, mode="rows", row_lists="pages", limit=0).errors.count() == 0


def test_a_check_that_always_fails_has_one_run_a_page(spark):
    found = run(spark.range(0, 3_000_000, 1, 8).selectExpr("-id AS v"), mode="rows", row_lists="pages").errors.collect()
    assert len(found) == 46 and all(len(p.runs) == 1 for p in found) and sum(p.runs[0].length for p in found) == 3_000_000


def test_counts_take_one_aggregate(spark):
    df = spark.range(100).selectExpr("id - 50 AS v")
    result, jobs = scans(spark, "counts", lambda: run(df))
    assert jobs <= 2 and result.report.rows_valid == 49


def test_last_frame_function_needs_no_count_of_its_own(spark):
    model = SchemaModel.from_dict({"profile": "clean", "columns": {"v": POSITIVE}, "frame_parsers": [{"name": "fill_nulls", "args": {"column": "v", "value": 1}}], "frame_checks": [{"name": "min_rows", "args": {"count": 1}}]})
    df = spark.range(0, 100, 1, 4).selectExpr("CASE WHEN id > 5 THEN id END AS v")
    result, jobs = scans(spark, "functions", lambda: run(df, model))
    # Rows and nulls before the parser, rows before the check, its own look, all other counts.
    assert result.report.columns["v"].original_null_count == 6 and result.report.rows_valid == 100 and jobs <= 8
    registry = default_registry()

    @registry.frame_parser
    def half(df: DataFrame) -> DataFrame:
        return df.where("v % 2 = 0")

    for more in ([], [{"name": "fill_nulls", "args": {"column": "v", "value": 1}}]):
        bad = model.model_copy(update={"frame_parsers": [*SchemaModel.from_dict({"columns": {}, "frame_parsers": [{"name": "half"}, *more]}).frame_parsers]})
        with pytest.raises(FrameShapeError, match="half: rows changed from 100 to"):
            validate(df, bad, registry)





def test_frame_checks_that_change_the_frame_keep_the_counts_before_them(spark):
    registry = default_registry()

    @registry.frame_check
    def zeros(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.col("v") * 0)

    model = SchemaModel.from_dict({"columns": {"v": {"dtype": "Int64", "nullable": True, "checks": [{"name": "positive"}]}}, "frame_checks": [{"name": "zeros"}, {"name": "min_rows", "args": {"count": 2}}]})
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    report = validate(df, model, registry, coerce_strategy="null_on_failure").report.columns["v"]
    assert (report.original_null_count, report.coercion_failures, report.check_failures) == (1, 1, 3)


@pytest.mark.parametrize(("mode", "limit", "reads"), [("summary", None, 1), ("rows", 5, 3), ("cells", 5, 3)])
def test_written_in_one_pass(spark, tmp_path, counted, mode, limit, reads):
    """A summary reads the input once; details number rows and look once more at what fails."""
    df, seen = counted
    result = validate_into(df, MODEL, default_registry(), tmp_path / "out", error_report=ErrorReportConfig(mode=mode, limit=limit))
    assert seen.value == reads * 1000
    plain = validate(spark.read.parquet(f"{tmp_path}/t"), MODEL, default_registry(), error_report=ErrorReportConfig(mode=mode, limit=limit))
    assert result.report == plain.report and sorted(map(tuple, result.errors.collect())) == sorted(map(tuple, plain.errors.collect()))
    assert sorted(map(repr, result.data.collect())) == sorted(map(repr, plain.data.collect()))


@pytest.mark.parametrize("write", [True, False])
def test_sink_leaves_all_or_nothing(spark, tmp_path, monkeypatch, write):
    """A crash after the data are written leaves neither a new folder nor a changed one."""
    df = spark.range(10).selectExpr("id - 5 AS v")
    put = (lambda mode: write_result(run(df), tmp_path / "out", mode=mode)) if write else (lambda mode: validate_into(df, MODEL, default_registry(), tmp_path / "out", mode=mode))
    from tableguard.plans import validate as plans
    from tableguard.sources import writers

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(writers if write else plans, "write_report", crash)
        with pytest.raises(RuntimeError, match="lost"):
            put("errorifexists")
    assert not list(tmp_path.glob("*out*")) and not list(tmp_path.glob(".*out*"))
    put("errorifexists")
    before = sorted(p.name for p in (tmp_path / "out" / "data").iterdir())
    with monkeypatch.context() as m:
        m.setattr(writers if write else plans, "write_report", crash)
        with pytest.raises(RuntimeError, match="lost"):
            put("overwrite")
    assert sorted(p.name for p in (tmp_path / "out" / "data").iterdir()) == before
    with pytest.raises(FileExistsError):
        put("errorifexists")
    put("ignore")
    assert sorted(p.name for p in (tmp_path / "out" / "data").iterdir()) == before
    put("overwrite")
    assert sorted(p.name for p in (tmp_path / "out" / "data").iterdir()) != before
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and read_result(spark, tmp_path / "out").report.rows_processed == 10
    with pytest.raises(ValueError, match="mode"):
        put("append")


def test_sink_writes_nothing_where_nulls_are_left(spark, tmp_path):
    model = SchemaModel.from_dict({"columns": {"v": {"dtype": "Int64"}}})
    with pytest.raises(NullabilityError) as e:
        validate_into(spark.createDataFrame([(1,), (None,)], "v long"), model, default_registry(), tmp_path / "out")
    assert e.value.report.columns["v"].final_null_count == 1 and e.value.errors.collect()[0]["count"] == 1 and not list(tmp_path.iterdir())


def test_eager_frames_end_with_their_block(spark, tmp_path):
    (tmp_path / "f.csv").write_text("v\n1\n-2\n")
    storage = spark.sparkContext._jsc.getPersistentRDDs
    before = storage().size()
    with kept(read_csv(tmp_path / "f.csv", MODEL, lazy=False)) as df, validate(df, MODEL, default_registry(), lazy=False) as result:
        assert df.is_cached and result.data.is_cached and storage().size() == before + 2
        assert result.data.where("v IS NULL").count() == 1
    assert storage().size() == before and not result.data.is_cached and result.data.count() == 2


def test_numbers_stay_when_cached_blocks_are_lost(spark, monkeypatch, tmp_path):
    """Shuffled rows are numbered from a written copy, in a folder of this machine's own only if Spark runs on it alone."""
    from types import SimpleNamespace

    unset = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=unset, master="spark://a:7077"), conf=SimpleNamespace(get=lambda *_: None))
    monkeypatch.setattr(rowindex, "_nodes", lambda df: ["ShuffleExchangeExec"])
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        rowindex.settled(SimpleNamespace(sparkSession=cluster))
    numbered = rowindex.with_row_index(rowindex.settled(spark.range(1000).repartition(5).withColumn("r", F.rand())))
    first = sorted(map(tuple, numbered.collect()))
    spark.catalog.clearCache()
    for r in list(spark.sparkContext._jsc.getPersistentRDDs().values()):
        r.unpersist()
    assert sorted(map(tuple, numbered.collect())) == first


def test_broadcast_joins_are_no_reason_to_write(spark):
    small = spark.createDataFrame([(k, k) for k in range(5)], "v long, w long")
    joined = spark.range(100).selectExpr("id % 5 AS v").join(F.broadcast(small), "v")
    assert "BroadcastExchange" in plan(joined) and rowindex.settled(joined) is joined


@pytest.mark.parametrize("name", ["_ragged", "b"])
def test_rows_longer_than_the_header(spark, tmp_path, name):
    path = tmp_path / "f.csv"
    path.write_text(f'a,{name}\n1,2\n3\n4,5,\n"x,y","q""u",7,8\n"l, m",n\n,\n')
    model = SchemaModel.from_dict({"columns": {}})
    for use in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select(name).collect()):
        with pytest.raises(Exception, match="MALFORMED_CSV_RECORD: more than 2 fields"):
            use(read_csv(path, model))
    rows = [("1", "2", None), ("3", None, None), ("4", "5", "4,5,"), ("x,y", 'q"u', '"x,y","q""u",7,8'), ("l, m", "n", None), (None, None, None)]
    got = read_csv(path, model, ragged="report")
    assert [tuple(r) for r in got.collect()] == rows and got.columns[2] == ("_ragged_" if name == "_ragged" else "_ragged")
    assert [tuple(r) for r in read_csv(path, model, ragged="cut").collect()] == [r[:2] for r in rows]
    path.write_text("a,b\n1,2\n3\n")
    assert read_csv(path, model).count() == 2
    with pytest.raises(ValueError, match="ragged"):
        read_csv(path, model, ragged="never")
