"""Parsers and checks that come with the package, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes
from .registry import FunctionRegistry

#: The row index that frames carry while row numbers are reported; see operators.rowindex.
ROW_INDEX = "__row_index__"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def to_int(c: Column) -> Column:
    """Texts of integers as integers; anything else raises, whatever the strategy."""
    return dtypes.strict(dtypes.resolve("Int64"), c.cast("string"), T.StringType(), "to_int")


def to_float(c: Column) -> Column:
    """Texts of numbers as doubles; anything else raises, whatever the strategy."""
    return dtypes.strict(dtypes.resolve("Float64"), c.cast("string"), T.StringType(), "to_float")


def replace_text(c: Column, old: str, new: str) -> Column:
    """The first match of a pattern replaced; ``new`` is taken as it is."""
    return F.when(c.isNotNull(), F.concat_ws(new, F.split(c, old, 2)))


def normalize(c: Column, mean: float | None = None, deviation: float | None = None) -> Column:
    """Distance from the mean in sample standard deviations.

    A validation aggregates ``statistics`` beforehand and passes them; without
    them, as in a plain select, a window over the whole frame finds them.
    """
    if mean is None and deviation is None:
        whole = Window.partitionBy()
        return (c - F.avg(c).over(whole)) / F.stddev_samp(c).over(whole)
    return (c - F.lit(mean)) / F.lit(deviation)


normalize.statistics = {"mean": F.avg, "deviation": F.stddev_samp}


def non_null(c: Column) -> Column:
    return c.isNotNull()


def positive(c: Column) -> Column:
    return c > 0


def min_zero(c: Column) -> Column:
    return c >= 0


def between(c: Column, min, max) -> Column:
    """Both ends included."""
    return c.between(F.lit(min), F.lit(max))


def in_range(c: Column, min_val, max_val) -> Column:
    """Both ends included."""
    return between(c, min_val, max_val)


def in_list(c: Column, values: list) -> Column:
    return c.isin(list(values))


def unique(c: Column) -> Column:
    """Whether no other row has the value; null is a value.

    A validation counts values instead (``marked``): counts are summed before
    they are shuffled, and the join with values that come more than once splits
    where one of them is very common.
    """
    return F.count(F.lit(1)).over(Window.partitionBy(c)) == 1


def _marked_unique(df: DataFrame, column: str, name: str) -> DataFrame:
    c = F.col("`" + column.replace("`", "``") + "`")
    twice = df.groupBy(c.alias(f"{name}v")).agg(F.count(F.lit(1)).alias(f"{name}n")).where(F.col(f"{name}n") > 1)
    return df.join(twice, c.eqNullSafe(F.col(f"{name}v")), "left").withColumn(name, F.col(f"{name}n").isNull()).drop(f"{name}v", f"{name}n")


unique.marked = _marked_unique
#: Fails for a value that came before, so a stream may remember values across batches.
unique.repeats = True


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return c.rlike(pattern)


def email_format(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def min_length(c: Column, length: int) -> Column:
    return F.char_length(c) >= length


def after_date(c: Column, date: str) -> Column:
    return c > F.lit(date).cast("timestamp_ntz")


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def strip_all_strings(df: DataFrame) -> DataFrame:
    """Every text column stripped."""
    return df.withColumns({c: strip(df[c]) for c in _texts(df)})


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def fill_nulls(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def deduplicate(df: DataFrame) -> DataFrame:
    """Without repeated rows; as rows must stay, a frame that has any is an error."""
    return df.dropDuplicates([c for c in df.columns if c != ROW_INDEX])


def min_rows(df: DataFrame, count: int) -> DataFrame:
    """Raise unless there are so many rows; reads no more than that."""
    found = df.limit(count).count()
    if found < count:
        raise ValueError(f"Expected at least {count} rows, found {found}")
    return df


def no_duplicate_ids(df: DataFrame, column: str = "patient_id") -> DataFrame:
    """Raise if a value of the column comes more than once; names the first hundred."""
    twice = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(column).orderBy(column)
    found = [r[0] for r in twice.take(100)]
    if found:
        raise ValueError(f"Duplicate {column} values: {found}")
    return df


COLUMN_PARSERS = {"strip": strip, "trim_whitespace": strip, "lower": lower, "upper": upper, "uppercase": upper, "to_int": to_int, "to_float": to_float, "replace_text": replace_text, "normalize": normalize}
COLUMN_CHECKS = {
    "non_null": non_null, "positive": positive, "min_zero": min_zero, "between": between, "in_range": in_range, "in_list": in_list, "unique": unique,
    "matches": matches, "email_format": email_format, "min_length": min_length, "after_date": after_date,
}
FRAME_PARSERS = {"strip_all_strings": strip_all_strings, "strip_strings": strip_all_strings, "sort_by": sort_by, "sort_by_date": sort_by, "fill_nulls": fill_nulls, "deduplicate": deduplicate}
FRAME_CHECKS = {"min_rows": min_rows, "no_duplicate_ids": no_duplicate_ids}


def default_registry() -> FunctionRegistry:
    """A new registry with all of these."""
    registry = FunctionRegistry()
    for functions, register in ((COLUMN_PARSERS, registry.register_column_parser), (COLUMN_CHECKS, registry.register_column_check), (FRAME_PARSERS, registry.register_frame_parser), (FRAME_CHECKS, registry.register_frame_check)):
        for name, func in functions.items():
            register(func, name=name)
    return registry
