"""Check masks: where a check of a column fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import FunctionRegistry, RegistryError
from ..schema import SchemaModel
from .rowindex import _quoted

NON_NULL = "non_null"


def with_marks(df: DataFrame, schema: SchemaModel, registry: FunctionRegistry) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """df with what checks about a whole column have to say of each row, by column and check.

    Such a check's function has ``marked(df, column, name)``, which returns df
    with one more column of that name, true where the check holds.
    """
    out: dict[tuple[str, str], Column] = {}
    for name, column in schema.columns.items():
        for check in column.checks:
            marked = getattr(getattr(registry.column_checks.get(check.name), "func", None), "marked", None)
            if marked and name in df.columns and (name, check.name) not in out:
                mark = f"__tableguard_mark{len(out)}__"
                df, out[name, check.name] = marked(df, name, mark), F.col(mark)
    return df, out


def masks(df: DataFrame, schema: SchemaModel, registry: FunctionRegistry, marks: dict[tuple[str, str], Column] | None = None) -> list[tuple[str, str, Column]]:
    """(column, check, failed) in the order of the schema.

    Failed means not true, so a null result fails. Columns that may not be null
    have a non_null check before their own. Checks with the same name on one
    column are one check, which fails where any of them does.
    """
    spark = df.sparkSession
    fields = {f.name: f for f in df.schema.fields}
    found: dict[tuple[str, str], list[Column]] = {}
    for name, column in schema.columns.items():
        if name not in fields:
            continue
        c = F.col(_quoted(name))
        if not column.nullable:
            found.setdefault((name, NON_NULL), []).append(c.isNull())
        for check in column.checks:
            if check.name not in registry.column_checks:
                raise KeyError(f"Unknown column check: {check.name!r}")
            result, kind = registry.column_checks[check.name].on(c, fields[name], spark, **check.args)
            result = (marks or {}).get((name, check.name), result)
            if not isinstance(kind, (T.BooleanType, T.NullType)):
                raise RegistryError(f"{check.name}: a check must give booleans, not {kind.simpleString()}")
            found.setdefault((name, check.name), []).append(~F.coalesce(result.cast("boolean"), F.lit(False)))
    return [(column, check, any_of(parts)) for (column, check), parts in found.items()]


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)
