"""Dtype names of schemas, their Spark types, and guarded casts.

Spark's own casts are more lenient than a schema asks for: they trim, take a
trailing ``d`` for a double, a bare year for a date, and ``yes`` for true. The
guards here say which values a cast may take; everything else is a failure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dtype:
    """``low``/``high`` bound integers that Spark holds in a wider type; a
    ``shape`` dtype only asserts that a column already is of that kind."""

    name: str
    spark: T.DataType | None
    low: int | None = None
    high: int | None = None
    shape: type | None = None


def _unsigned(name: str, bits: int, spark: T.DataType) -> Dtype:
    return Dtype(name, spark, 0, min((1 << bits) - 1, 10**38 - 1))


# The dtype names that schemas may use.
_ALL = [
    Dtype("Int8", T.ByteType()), Dtype("Int16", T.ShortType()), Dtype("Int32", T.IntegerType()), Dtype("Int64", T.LongType()), Dtype("Int128", T.DecimalType(38, 0)),
    _unsigned("UInt8", 8, T.ShortType()), _unsigned("UInt16", 16, T.IntegerType()), _unsigned("UInt32", 32, T.LongType()), _unsigned("UInt64", 64, T.DecimalType(20, 0)), _unsigned("UInt128", 128, T.DecimalType(38, 0)),
    Dtype("Float16", T.FloatType()), Dtype("Float32", T.FloatType()), Dtype("Float64", T.DoubleType()), Dtype("Decimal", T.DecimalType(38, 0)), Dtype("Boolean", T.BooleanType()),
    Dtype("String", T.StringType()), Dtype("Utf8", T.StringType()), Dtype("Categorical", T.StringType()), Dtype("Binary", T.BinaryType()),
    Dtype("Date", T.DateType()), Dtype("Datetime", T.TimestampNTZType()), Dtype("Duration", T.DayTimeIntervalType()), Dtype("Null", T.NullType()),
    Dtype("List", None, shape=T.ArrayType), Dtype("Array", None, shape=T.ArrayType), Dtype("Struct", None, shape=T.StructType),
]
DTYPES = {d.name: d for d in _ALL}
#: Names that say too little for Spark to cast to.
REJECTED = {
    "Enum": "an Enum has no categories here; use Categorical",
    "Time": "Spark has no time of day by default; use Utf8",
    "Object": "values of any kind have no Spark type",
    "Unknown": "a column needs a known type",
    "DataType": "a column needs a concrete type",
}

INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?$"
BOOLEAN = r"^(true|false)$"


def resolve(name: str) -> Dtype:
    """The dtype of a name; ValueError if it is none or cannot be a column's."""
    if name in REJECTED:
        raise ValueError(f"Unsupported dtype {name!r}: {REJECTED[name]}")
    try:
        return DTYPES[name]
    except (KeyError, TypeError):
        raise ValueError(f"Unknown dtype: {name!r}") from None


def same(dtype: Dtype, have: T.DataType) -> bool:
    """Whether a column needs no cast (though its values may need a bound)."""
    if dtype.shape is not None:
        return isinstance(have, dtype.shape)
    return have == dtype.spark or isinstance(dtype.spark, T.StringType) and isinstance(have, T.StringType)


def _text_guard(dtype: Dtype) -> str | None:
    kind = dtype.spark
    if isinstance(kind, T.DecimalType) and dtype.name == "Decimal":
        return NUMBER
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return INTEGER
    if isinstance(kind, T.FractionalType):
        return NUMBER
    return {T.DateType: DATE, T.TimestampNTZType: DATETIME, T.BooleanType: BOOLEAN}.get(type(kind))


def lenient(dtype: Dtype, c: Column, have: T.DataType) -> Column:
    """The cast value, null where the value does not fit."""
    if same(dtype, have):
        out = c
    elif isinstance(have, T.StringType) and (guard := _text_guard(dtype)):
        out = F.when(c.rlike(guard), c.try_cast(dtype.spark))
    else:
        out = c.try_cast(dtype.spark)
    return out if dtype.low is None else F.when(out.between(F.lit(dtype.low), F.lit(dtype.high)), out)


def strict(dtype: Dtype, c: Column, have: T.DataType, name: str) -> Column:
    """The cast value; a value that does not fit raises when it is computed."""
    if same(dtype, have) and dtype.low is None:
        return c
    fit = lenient(dtype, c, have)
    said = F.concat(F.lit(f"{COERCION_MARK} column {name!r} to {dtype.name}: "), F.coalesce(c.try_cast("string"), F.lit("?")))
    return F.when(c.isNull() | fit.isNotNull(), fit).otherwise(F.raise_error(said).cast(dtype.spark or have))


COERCION_MARK = "TABLEGUARD_COERCION"
