"""Column resolution: synonyms to the schema's names, by exact match."""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..schema import SchemaModel

_CASE = "spark.sql.caseSensitive"


class SchemaResolutionError(ValueError):
    """Columns of a frame and of a schema cannot be matched."""


@contextmanager
def case_sensitive(spark: SparkSession):
    """Names that differ in case are different columns while plans are built."""
    before = spark.conf.get(_CASE)
    spark.conf.set(_CASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_CASE, before)


def resolve_column_names(schema: SchemaModel, df: DataFrame) -> DataFrame:
    """df with the schema's column names; a projection of names only."""
    have = df.columns
    claims: dict[str, list[str]] = defaultdict(list)
    for name, column in schema.columns.items():
        found = sorted({name, *column.synonyms}.intersection(have))
        if len(found) > 1:
            raise SchemaResolutionError(f"Ambiguous columns for {name!r}: {found}")
        if found:
            claims[found[0]].append(name)
        elif column.required:
            raise SchemaResolutionError(f"Missing required column {name!r}; tried {sorted({name, *column.synonyms})}")
    for source, names in claims.items():
        if len(names) > 1:
            raise SchemaResolutionError(f"Column {source!r} is claimed by {sorted(names)}")
    renamed = [claims[c][0] if c in claims else c for c in have]
    return df if renamed == have else df.toDF(*renamed)
