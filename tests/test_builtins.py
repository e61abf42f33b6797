import pytest
from pyspark.sql import functions as F

from tableguard.functions import builtins as b


@pytest.mark.parametrize(
    ("func", "args", "values", "want"),
    [
        (b.strip, {}, [" \t a b\n ", None, ""], ["a b", None, ""]), (b.lower, {}, ["ÀB"], ["àb"]), (b.upper, {}, ["straße"], ["STRASSE"]), (b.replace_text, {"old": "a+", "new": "$1"}, ["caab aa", None, "x"], ["c$1b aa", None, "x"]),
        (b.non_null, {}, ["x", None], [True, False]), (b.positive, {}, [1, 0, None], [True, False, None]), (b.min_zero, {}, [0, -1], [True, False]), (b.between, {"min": 1, "max": 2}, [1, 2, 3], [True, True, False]),
        (b.in_range, {"min_val": 1, "max_val": 2}, [0, 2], [False, True]), (b.in_list, {"values": ["a"]}, ["a", "b", None], [True, False, None]), (b.matches, {"pattern": "b$"}, ["ab", "ba"], [True, False]), (b.email_format, {}, ["a@b.c", "a@b"], [True, False]), (b.min_length, {"length": 2}, ["éé", "é"], [True, False]),
        (b.unique, {}, ["a", "a", "b", None], [False, False, True, True]), (b.to_int, {}, ["12", None], [12, None]), (b.to_float, {}, ["1e2", None], [100.0, None]),
    ],
)
def test_column_functions(spark, func, args, values, want):
    kind = "long" if isinstance(values[0], int) else "string"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    assert [r.x for r in df.select("i", func(F.col("v"), **args).alias("x")).orderBy("i").collect()] == want


def test_normalize_and_dates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert sorted(r[0] for r in df.select(b.normalize(F.col("v"))).collect()) == [-1.0, 0.0, 1.0]
    days = spark.sql("SELECT explode(array(TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-02')) AS v")
    assert sorted(r[0] for r in days.select(b.after_date(F.col("v"), "2024-01-01")).collect()) == [False, True]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def validated(df, columns, **more):
    from tableguard import SchemaModel, default_registry, validate

    return validate(df, SchemaModel.from_dict({"coerce": False, "columns": columns} | more), default_registry())


def test_normalize_in_a_validation_needs_no_single_partition(spark):
    df = spark.range(1000).selectExpr("cast(id AS double) AS v")
    got = validated(df, {"v": {"dtype": "Float64", "parsers": [{"name": "normalize"}]}}).data
    assert "SinglePartition" not in plan_of(got) and "Window" not in plan_of(got)
    want = df.select(b.normalize(F.col("v")).alias("v"))
    assert [round(r.v, 9) for r in got.orderBy("v").collect()] == [round(r.v, 9) for r in want.orderBy("v").collect()]
    for odd in ([], [(None,)], [(1.0,)]):  # no deviation to divide by
        few = spark.createDataFrame(odd, "v double")
        assert [r.v for r in validated(few, {"v": {"dtype": "Float64", "nullable": True, "parsers": [{"name": "normalize"}]}}).data.collect()] == [None] * len(odd)


def test_unique_in_a_validation_counts_before_it_shuffles(spark):
    values = ["a"] * 500 + [None, None, "b", "c"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rule = {"v": {"dtype": "Utf8", "nullable": True, "checks": [{"name": "unique"}]}}
    got = validated(df, rule, profile="clean")
    assert [tuple(r) for r in got.errors.collect()] == [("v", "unique", 502)]
    assert "Window" not in plan_of(got.data) and got.data.columns == ["i", "v"]
    assert {r.i: r.v for r in got.data.collect()} == {i: v if v in ("b", "c") else None for i, v in enumerate(values)}
    once = validated(spark.createDataFrame([("x",), (None,)], "v string"), rule)
    assert once.errors.count() == 0 and once.report.rows_valid == 2
