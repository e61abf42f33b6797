"""Error reports, from masks that lie in the rows they are about."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.builtins import ROW_INDEX
from .rowindex import _quoted

SCHEMAS = {
    "summary": "column string, check string, count long",
    "rows": "column string, check string, count long, row_indices array<long>",
    "cells": "column string, check string, row_index long, value string",
    "pages": "column string, check string, page long, count long, runs array<struct<start: long, length: long>>",
}
FEW_PARTITIONS = 64
FEW_ROWS = 1_000_000
PAGE_ROWS = 1 << 16


def schema_of(mode: str, include_values: bool, paged: bool = False) -> str:
    if mode == "rows" and paged:
        return SCHEMAS["pages"]
    return SCHEMAS[mode] if include_values or mode != "cells" else SCHEMAS[mode].removesuffix(", value string")


def summary(spark: SparkSession, counts: list[tuple[str, str, int]]) -> DataFrame:
    """From counts that the validation has already made; no further job."""
    return spark.createDataFrame(sorted(c for c in counts if c[2]), SCHEMAS["summary"])


def detailed(masked: DataFrame, checks: list[tuple[str, str, str]], mode: str, limit: int | None, include_values: bool, total: int, partitions: int, paged: bool = False) -> DataFrame:
    """rows or cells; checks: (column, check, name of its mask column); total and partitions: the number of rows, and of the partitions that were numbered.

    With a limit a few rows for each check are left, which one task sorts; the
    tasks before it are as many as ever. Without one, all failing rows are sorted
    by ranges, and a check's list of rows is one value unless it is ``paged``.
    """
    spark = masked.sparkSession
    if not checks:
        return spark.createDataFrame([], schema_of(mode, include_values, paged))
    values = mode == "cells" and include_values

    def cell(column: str, check: str, mask: str):
        value = F.col(_quoted(column)).try_cast("string") if values else F.lit(None).cast("string")
        return F.when(F.col(mask), F.struct(F.lit(column).alias("column"), F.lit(check).alias("check"), value.alias("value")))

    failed = masked.select(F.col(ROW_INDEX).alias("row_index"), F.explode(F.array_compact(F.array(*(cell(*c) for c in checks)))).alias("e")).select("e.column", "e.check", "row_index", "e.value")
    if limit is not None:
        failed = _first(failed, limit, total, partitions)
    few = limit is not None and limit * len(checks) <= FEW_ROWS
    in_order = lambda df, *by: df.repartition(1).sortWithinPartitions(*by) if few else df.orderBy(*by)
    if mode == "cells":
        return in_order(failed.select("column", "check", "row_index", *(["value"] if include_values else [])), "column", "check", "row_index")
    if paged:
        return in_order(_pages(failed), "column", "check", "page")
    # One row for each check.
    listed = failed.groupBy("column", "check").agg(F.sort_array(F.collect_list("row_index")).alias("row_indices"))
    return in_order(listed.select("column", "check", F.size("row_indices").cast("long").alias("count"), "row_indices"), "column", "check")


def _first(failed: DataFrame, limit: int, total: int, partitions: int) -> DataFrame:
    """The first rows of each column and check.

    Partitions of the input keep their first rows of each, which meet for one check.
    Where there are more than ``FEW_PARTITIONS``, ranges of row numbers keep the first of
    those before; there are about as many ranges as partitions in each.
    """
    steps: list[list[Column]] = [[]]
    if partitions > FEW_PARTITIONS:
        width = max(1, -(-total // math.isqrt(partitions)))
        steps.insert(0, [F.col("row_index") - F.col("row_index") % width])
    for by in steps:
        order = Window.partitionBy("column", "check", *by).orderBy("row_index")
        failed = failed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    return failed


def _pages(failed: DataFrame) -> DataFrame:
    """(column, check, page, count, runs): a page is a range of ``PAGE_ROWS`` row numbers, a run consecutive failing rows in it.

    No value has more than half as many runs, however often a check fails; runs that
    go on in the next page begin there again.
    """
    rows = failed.groupBy("column", "check", F.expr(f"row_index div {PAGE_ROWS}").alias("page")).agg(F.sort_array(F.collect_list("row_index")).alias("rows"))

    def runs(a):
        first = F.filter(a, lambda x, i: (i == 0) | (x - F.get(a, i - 1) > 1))
        last = F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1) - x > 1))
        return F.zip_with(first, last, lambda x, y: F.struct(x.alias("start"), (y - x + 1).alias("length")))

    # As a variable the sorted rows are made once, not again for each of them.
    found = F.get(F.transform(F.array("rows"), runs), F.lit(0))
    return rows.select("column", "check", "page", F.size("rows").cast("long").alias("count"), found.alias("runs"))


def rows_of_pages(pages: DataFrame) -> DataFrame:
    """(column, check, row_index) of a paged report: each failing row again."""
    runs = pages.select("column", "check", F.explode("runs").alias("r"))
    return runs.select("column", "check", F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.length") - 1)).alias("row_index"))


def rows_at_limit_zero(spark: SparkSession, counts: list[tuple[str, str, int]], paged: bool = False) -> DataFrame:
    """rows with limit 0: every failing check with an empty list, or no pages."""
    return spark.createDataFrame([] if paged else [(c, k, 0, []) for c, k, n in sorted(counts) if n], schema_of("rows", True, paged))
