"""Coercion of schema columns to their dtypes."""

from __future__ import annotations

from typing import Literal

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .. import dtypes
from ..schema import SchemaModel

Strategy = Literal["strict", "null_on_failure"]


class CoercionError(ValueError):
    """A value or a column does not fit its dtype."""


def coerced(c: Column, have: T.DataType, name: str, dtype_name: str, strategy: Strategy) -> Column:
    """The column cast: strict raises for values that do not fit, else they are null."""
    dtype = dtypes.resolve(dtype_name)
    if dtype.shape is not None and not dtypes.same(dtype, have):
        raise CoercionError(f"column {name!r}: {have.simpleString()} is no {dtype_name}")
    if strategy == "strict":
        return dtypes.strict(dtype, c, have, name)
    if strategy == "null_on_failure":
        return dtypes.lenient(dtype, c, have)
    raise ValueError(f"Unknown coerce strategy: {strategy!r}")


def mismatch(frame: DataFrame, schema: SchemaModel, cause: Exception) -> CoercionError:
    """What each column is and should be, and what might help."""
    have = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    lines = [f"  {name}: current {have[name]}, expected {c.dtype}" for name, c in schema.columns.items() if name in have]
    hints = ["add a parser that prepares the values", "use coerce_strategy='null_on_failure'", "change the dtype in the schema"]
    return CoercionError("\n".join([f"Dtype mismatch: {cause}", *lines, "Suggestions:", *(f"  - {h}" for h in hints)]))


def raised_by_cast(e: PySparkException) -> CoercionError | None:
    """A strict cast's error, out of what Spark raises when an action runs."""
    text = str(e)
    if dtypes.COERCION_MARK in text:
        said = text.split(dtypes.COERCION_MARK, 1)[1].strip().splitlines()[0]
        return CoercionError(f"Cannot coerce {said}")
    if "CAST_INVALID_INPUT" in text or "CAST_OVERFLOW" in text:
        return CoercionError(text.splitlines()[0])
    return None

