from typing import Annotated

import pytest
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard import ColumnPurityError, FrameShapeError, FunctionRegistry, RegistryError, default_registry


def good(c: Column, low: int = 0, note="x") -> Column:
    """Greater."""
    return c > low


def test_decorators_and_names():
    r = FunctionRegistry()

    @r.column_check
    def one(c: Column) -> Column:
        return c > 0

    @r.column_check()
    def two(c: Annotated[Column, "any"]) -> Column:
        return c > 0

    @r.column_check(name="three")
    def other(c: Column) -> Column:
        return c > 0

    r.register_column_parser(one)
    assert list(r.column_checks) == ["one", "two", "three"] and list(r.column_parsers) == ["one"]
    with pytest.raises(RegistryError):
        r.register_column_check(good, name="one")
    with pytest.raises(RegistryError):
        r.register_column_check(good, name="")
    assert r.register_column_check(good).__doc__ == "Greater."


def star(c: Column, *more) -> Column: ...
def keywords(c: Column, **more) -> Column: ...
def second(c: Column, d: Column) -> Column: ...
def frame_second(c: Column, d: DataFrame) -> Column: ...
def no_hint(c) -> Column: ...
def no_return(c: Column): ...
def wrong(c: int) -> Column: ...
def wrong_return(c: Column) -> bool: ...
def keyword_only(*, c: Column) -> Column: ...
def bad_default(c: Column, d=object()) -> Column: ...
def unresolved(c: "Nowhere") -> Column: ...  # noqa: F821
def nothing() -> Column: ...


@pytest.mark.parametrize("func", [star, keywords, second, frame_second, no_hint, no_return, wrong, wrong_return, keyword_only, bad_default, unresolved, nothing, 5])
def test_signatures(func):
    with pytest.raises(RegistryError):
        FunctionRegistry().register_column_check(func, name="f")


def test_kinds_are_apart():
    with pytest.raises(RegistryError):
        FunctionRegistry().register_frame_parser(good)
    assert issubclass(ColumnPurityError, RegistryError) and issubclass(FrameShapeError, RegistryError) and issubclass(RegistryError, ValueError)


@pytest.mark.parametrize(
    ("make", "error"),
    [
        (lambda c: F.col("other") > 0, ColumnPurityError), (lambda c: c > F.col("other"), ColumnPurityError), (lambda c: F.lit(True), ColumnPurityError), (lambda c: True, RegistryError), (lambda c: F.max(c) > 0, RegistryError),
        (lambda c: F.max(c).over(Window.partitionBy()) >= c, None), (lambda c: c.isNotNull(), None),
    ],
)
def test_purity(spark, make, error):
    def f(c: Column) -> Column:
        return make(c)

    wrapper = FunctionRegistry().register_column_check(f)
    field = T.StructField("a", T.LongType())
    if error:
        with pytest.raises(error):
            wrapper.on(F.col("a"), field, spark)
    else:
        assert wrapper.on(F.col("a"), field, spark)[1] == T.BooleanType()
    with pytest.raises(ColumnPurityError):
        wrapper("a")


def test_frame_shape(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "x long, y string")
    cases = {
        "drop rows": lambda d: d.where("x > 1"), "drop column": lambda d: d.select("x"), "reorder": lambda d: d.select("y", "x"), "not a frame": lambda d: 1, "dedup": lambda d: d.dropDuplicates(),
    }
    for name, change in cases.items():

        def f(d: DataFrame, change=None) -> DataFrame:
            return cases[name](d)

        with pytest.raises(FrameShapeError):
            FunctionRegistry().register_frame_parser(f)(df)

    def same(d: DataFrame) -> DataFrame:
        return d.withColumn("x", F.col("x").cast("string"))

    wrapper = FunctionRegistry().register_frame_check(same)
    assert wrapper(df).count() == 2
    with pytest.raises(FrameShapeError):
        wrapper(5)


def test_default_registry_is_new_each_time():
    a, b = default_registry(), default_registry()
    a.register_column_check(good)
    assert "good" not in b.column_checks and {"strip", "to_int"} <= b.column_parsers.keys() and {"min_rows", "no_duplicate_ids"} == b.frame_checks.keys()


def test_positional_arguments(spark):
    r = default_registry()
    df = spark.createDataFrame([(5,), (15,)], "v long")
    assert [x.ok for x in df.select(r.column_checks["between"](F.col("v"), 0, 10).alias("ok")).collect()] == [True, False]
    assert r.frame_checks["min_rows"](df, 2) is df


def test_functions_of_one_name_keep_their_own_types(spark):
    """Expressions that are written alike are remembered by function."""
    source = T.StructField("v", T.LongType())
    kinds = []
    for kind in ("string", "long"):
        registry = FunctionRegistry()
        udf = F.udf(lambda x: x, kind)

        def same(c: Column) -> Column:
            return udf(c)  # noqa: B023

        kinds.append(registry.register_column_parser(same).on(F.col("v"), source, spark)[1])
    assert kinds == [T.StringType(), T.LongType()]


def test_frame_functions_may_not_lose_rows(spark):
    registry = FunctionRegistry()

    @registry.frame_parser
    def more(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.col("v") + 1)

    @registry.frame_parser
    def fewer(df: DataFrame) -> DataFrame:
        return df.where("v > 5")

    df = spark.createDataFrame([(5,), (15,)], "v long")
    assert [r.v for r in registry.frame_parsers["more"](df).collect()] == [6, 16]
    assert registry.frame_parsers["fewer"].applied(df).columns == ["v"]
    with pytest.raises(FrameShapeError, match="from 2 to 1"):
        registry.frame_parsers["fewer"](df)
