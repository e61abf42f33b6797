"""A query for each operator of the engine, over whole tables, and its SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import FrameShapeError, default_registry
from ..operators.rowindex import settled, with_row_index
from ..schema import SchemaModel
from ..sources import read_csv, read_parquet
from .validate import ErrorReportConfig, NullabilityError, ValidationResult, validate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIRTY = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 13 = 0 THEN 'x' || user_id ELSE ' ' || user_id || ' ' END AS uid, event_type FROM events"""
CLEAN_UID = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))


def _dtype(kind: str) -> str:
    return {"bigint": "Int64", "int": "Int32", "double": "Float64", "string": "Utf8", "timestamp_ntz": "Datetime"}[kind]


def _run(df: DataFrame, columns: dict, *, registry=None, mode: str = "summary", limit: int | None = None, include_values: bool = True, strategy: str = "strict", lazy: bool = True, row_lists: str = "whole", **schema) -> ValidationResult:
    """Validate with the given rules; a rule without dtype keeps the column's own."""
    kinds = dict(df.dtypes)
    rules = {n: {"nullable": True, "dtype": _dtype(kinds[n]) if n in kinds else "Utf8"} | r for n, r in columns.items()}
    model = SchemaModel.from_dict({"coerce": False, "columns": rules} | schema)
    return validate(df, model, registry or default_registry(), lazy=lazy, coerce_strategy=strategy, error_report=ErrorReportConfig(mode=mode, limit=limit, include_values=include_values, row_lists=row_lists))


def query(name: str, sql: str):
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# Scans and resolution.


@query("scan_parquet_passthrough", "SELECT * FROM orders")
def scan_parquet_passthrough(spark, sf_dir):
    df = read_parquet(f"{sf_dir}/orders.parquet", SchemaModel.from_dict({"columns": {"o_orderkey": {"dtype": "Int64"}}}))
    return _run(df, {"o_orderkey": {}}).data


@query("scan_parquet_files", "SELECT * FROM nation UNION ALL SELECT * FROM nation")
def scan_parquet_files(spark, sf_dir):
    return read_parquet([f"{sf_dir}/nation.parquet"] * 2, SchemaModel.from_dict({"columns": {"n_nationkey": {"dtype": "Int32"}}}))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, or a temporary one without a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tableguard-")
    return top


def _csv(spark: SparkSession, df: DataFrame) -> str:
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path


@query("csv_untyped", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_untyped(spark, sf_dir):
    return read_csv(_csv(spark, _table(spark, sf_dir, "nation")), SchemaModel.from_dict({"columns": {"n_nationkey": {"dtype": "Int64"}}}))


@query("csv_typed", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::SMALLINT AS n_regionkey FROM nation")
def csv_typed(spark, sf_dir):
    rules = {"nation": {"dtype": "Int64", "synonyms": ["n_nationkey"]}, "n_name": {"dtype": "Utf8"}, "n_regionkey": {"dtype": "Int16"}}
    return read_csv(_csv(spark, _table(spark, sf_dir, "nation")), SchemaModel.from_dict({"columns": rules}), typed=True)


@query("csv_eager", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, true AS kept FROM nation")
def csv_eager(spark, sf_dir):
    df = read_csv(_csv(spark, _table(spark, sf_dir, "nation")), SchemaModel.from_dict({"lazy": False, "columns": {"n_nationkey": {"dtype": "Int64"}}}))
    return df.withColumn("kept", F.lit(df.storageLevel.useMemory))


@query("in_memory_frame", "SELECT CASE WHEN n_regionkey > 0 THEN n_regionkey END AS n_regionkey, n_name FROM nation")
def in_memory_frame(spark, sf_dir):
    """The smallest tables are what a driver may hold as rows of its own."""
    rows = [tuple(r) for r in _table(spark, sf_dir, "nation").select("n_regionkey", "n_name").collect()]
    df = spark.createDataFrame(rows, "n_regionkey int, n_name string")
    return _run(df, {"n_regionkey": {"checks": [{"name": "positive"}]}}, profile="clean").data


@query("resolve_case", "SELECT n_nationkey AS big, n_regionkey AS small FROM nation")
def resolve_case(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("Age"), F.col("n_regionkey").alias("age"))
    return _run(df, {"Age": {"dtype": "Int32"}, "age": {"dtype": "Int32"}}).data.toDF("big", "small")


@query("resolve_synonyms", "SELECT c_custkey AS id, c_name AS Name, c_nationkey AS nation, c_acctbal, c_mktsegment AS segment FROM customer")
def resolve_synonyms(spark, sf_dir):
    rules = {"id": {"dtype": "Int64", "synonyms": ["c_custkey", "custkey"]}, "Name": {"synonyms": ["c_name"]}, "segment": {"synonyms": ["c_mktsegment"]}, "nation": {"dtype": "Int32", "synonyms": ["c_nationkey"]}, "absent": {"required": False}}
    return _run(_table(spark, sf_dir, "customer"), rules).data


@query("row_index", "SELECT event_id, event_id AS row_index FROM events")
def row_index(spark, sf_dir):
    return with_row_index(_table(spark, sf_dir, "events")).select("event_id", F.col("__row_index__").alias("row_index"))


# Reports, as rows.


def _stats(spark: SparkSession, result: ValidationResult, *names: str) -> DataFrame:
    rows = [(c, *(getattr(s, n) for n in names)) for c, s in result.report.columns.items()]
    return spark.createDataFrame(rows, "column string, " + ", ".join(f"{n} long" for n in names))


def _count_sql(**parts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p}" for c, p in parts.items())


@query("original_nulls", _count_sql(value=f"count(*) FILTER (WHERE value IS NULL) AS original_null_count FROM ({DIRTY})", uid=f"count(*) FILTER (WHERE uid IS NULL) AS original_null_count FROM ({DIRTY})"))
def original_nulls(spark, sf_dir):
    return _stats(spark, _run(_dirty(spark, sf_dir), {"value": {}, "uid": {}}), "original_null_count")


@query("final_nulls", _count_sql(value=f"count(*) FILTER (WHERE NOT coalesce(value BETWEEN 5 AND 50, false)) AS final_null_count, count(*) FILTER (WHERE NOT coalesce(value BETWEEN 5 AND 50, false)) AS nullified FROM ({DIRTY})"))
def final_nulls(spark, sf_dir):
    return _stats(spark, _run(_dirty(spark, sf_dir), {"value": {"checks": [{"name": "between", "args": {"min": 5, "max": 50}}]}}, profile="clean"), "final_null_count", "nullified")


_UID = {"uid": {"dtype": "Int64", "parsers": [{"name": "strip"}]}}


@query("coerce_lenient", f"SELECT event_id, value, {CLEAN_UID} AS uid, event_type FROM (SELECT d.*, e.user_id FROM ({DIRTY}) d JOIN events e USING (event_id))")
def coerce_lenient(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), _UID, coerce=True, strategy="null_on_failure").data


@query("coerce_failures", f"SELECT 'uid' AS \"column\", count(*) FILTER (WHERE uid LIKE 'x%') AS coercion_failures, count(*) FILTER (WHERE uid LIKE 'x%') AS final_null_count FROM ({DIRTY})")
def coerce_failures(spark, sf_dir):
    return _stats(spark, _run(_dirty(spark, sf_dir), _UID, coerce=True, strategy="null_on_failure"), "coercion_failures", "final_null_count")


@query("coerce_strict", "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey::SMALLINT AS c_nationkey, c_acctbal::FLOAT AS c_acctbal, c_mktsegment FROM customer")
def coerce_strict(spark, sf_dir):
    return _run(_table(spark, sf_dir, "customer"), {"c_custkey": {"dtype": "Int32"}, "c_nationkey": {"dtype": "UInt8"}, "c_acctbal": {"dtype": "Float32"}}, coerce=True).data


@query("coerce_unsigned", "SELECT CASE WHEN event_id <= 255 THEN event_id::SMALLINT END AS event_id, user_id FROM events")
def coerce_unsigned(spark, sf_dir):
    return _run(_table(spark, sf_dir, "events").select("event_id", "user_id"), {"event_id": {"dtype": "UInt8"}}, coerce=True, strategy="null_on_failure").data


@query("coerce_off", f"{DIRTY}")
def coerce_off(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), {"uid": {"dtype": "Int64"}, "value": {}}).data


# Parsers.


def _parsed(name: str, sql: str, table: str, columns: list[str], column: str, *parsers: dict) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return _run(_table(spark, sf_dir, table).select(*columns), {column: {"parsers": list(parsers)}}).data


_parsed("parser_strip", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents", "documents", ["doc_id", "text"], "text", {"name": "strip"})
_parsed("parser_lower", "SELECT doc_id, lower(text) AS text FROM documents", "documents", ["doc_id", "text"], "text", {"name": "lower"})
_parsed("parser_upper", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation", "nation", ["n_nationkey", "n_name"], "n_name", {"name": "upper"})
_parsed("parser_replace_first", "SELECT p_partkey, regexp_replace(p_name, '[a-e]', '$1') AS p_name FROM part", "part", ["p_partkey", "p_name"], "p_name", {"name": "replace_text", "args": {"old": "[a-e]", "new": "$1"}})
_parsed("parser_chain", "SELECT n_nationkey, lower(replace(n_name, 'N', 'M')) AS n_name FROM nation WHERE false OR n_name NOT LIKE '%N%N%' UNION ALL SELECT n_nationkey, lower(regexp_replace(n_name, 'N', 'M')) FROM nation WHERE n_name LIKE '%N%N%'", "nation", ["n_nationkey", "n_name"], "n_name", {"name": "replace_text", "args": {"old": "N", "new": "M"}}, {"name": "lower"})


@query("parser_to_int", "SELECT event_id, user_id::BIGINT AS uid FROM events")
def parser_to_int(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("uid"))
    return _run(df, {"uid": {"parsers": [{"name": "strip"}, {"name": "to_int"}]}}).data


@query("parser_to_float", "SELECT c_custkey, c_acctbal FROM customer")
def parser_to_float(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    return _run(df, {"c_acctbal": {"parsers": [{"name": "to_float"}]}}).data


@query("parser_normalize", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z FROM lineitem")
def parser_normalize(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("z"))
    return _run(df, {"z": {"parsers": [{"name": "normalize"}]}}).data.withColumn("z", F.round("z", 6))


@query("frame_strip_all", "SELECT event_id, value, trim(uid) AS uid, event_type FROM (" + DIRTY + ")")
def frame_strip_all(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), {"uid": {}}, frame_parsers=[{"name": "strip_all_strings"}]).data


@query("frame_fill_nulls", "SELECT event_id, coalesce(value, 0.5) AS value, uid, event_type FROM (" + DIRTY + ")")
def frame_fill_nulls(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), {"value": {}}, frame_parsers=[{"name": "fill_nulls", "args": {"column": "value", "value": 0.5}}]).data


@query("frame_sort", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders")
def frame_sort(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    found = _run(df, {"o_orderkey": {}}, frame_parsers=[{"name": "sort_by", "args": {"column": "o_orderkey", "descending": True}}])
    return with_row_index(settled(found.data)).withColumnRenamed("__row_index__", "place")


def _raises(error: type[Exception], run: Callable[[], object]) -> bool:
    try:
        run()
    except error:
        return True
    return False


@query("frame_deduplicate", "SELECT 'once' AS frame, count(*) <> count(DISTINCT n_nationkey) AS raised FROM nation UNION ALL SELECT 'twice', count(*) <> count(DISTINCT n_nationkey) FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)")
def frame_deduplicate(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    run = lambda df: lambda: _run(df, {"n_name": {}}, frame_parsers=[{"name": "deduplicate"}])
    return spark.createDataFrame([("once", _raises(FrameShapeError, run(nation))), ("twice", _raises(FrameShapeError, run(nation.union(nation))))], "frame string, raised boolean")


@query("frame_rows_preserved", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) <> (SELECT count(*) FROM nation) AS raised")
def frame_rows_preserved(spark, sf_dir):
    registry = default_registry()

    @registry.frame_parser
    def one_region(df: DataFrame) -> DataFrame:
        return df.where("n_regionkey = 1")

    return spark.createDataFrame([(_raises(FrameShapeError, lambda: _run(_table(spark, sf_dir, "nation"), {"n_name": {}}, registry=registry, frame_parsers=[{"name": "one_region"}])),)], "raised boolean")


# Checks.


def _checked(name: str, table: str, columns: list[str], column: str, check: str, holds: str, **args) -> None:
    sql = f"SELECT '{column}' AS \"column\", '{check}' AS \"check\", count(*) AS count FROM {{}} WHERE NOT coalesce({holds}, false) HAVING count(*) > 0"

    @query(name, sql.format(f"({DIRTY})" if table == "dirty" else table))
    def run(spark, sf_dir):
        df = _dirty(spark, sf_dir) if table == "dirty" else _table(spark, sf_dir, table)
        return _run(df.select(*columns), {column: {"checks": [{"name": check, "args": args}]}}).errors


_checked("check_nonnull", "dirty", ["value"], "value", "non_null", "value IS NOT NULL")
_checked("check_positive", "customer", ["c_acctbal"], "c_acctbal", "positive", "c_acctbal > 0")
_checked("check_min_zero", "supplier", ["s_acctbal"], "s_acctbal", "min_zero", "s_acctbal >= 0")
_checked("check_between", "lineitem", ["l_quantity"], "l_quantity", "between", "l_quantity BETWEEN 3 AND 40", min=3, max=40)
_checked("check_in_list", "orders", ["o_orderstatus"], "o_orderstatus", "in_list", "o_orderstatus IN ('F', 'O')", values=["F", "O"])
_checked("check_regex", "part", ["p_brand"], "p_brand", "matches", "regexp_matches(p_brand, '[13]$')", pattern="[13]$")
_checked("check_min_length", "documents", ["text"], "text", "min_length", "length(text) >= 500", length=500)
_checked("check_after_date", "orders", ["o_orderdate"], "o_orderdate", "after_date", "o_orderdate > TIMESTAMP '1995-01-01'", date="1995-01-01")
_checked("check_unique", "orders", ["o_custkey"], "o_custkey", "unique", "(o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1))")
_checked("check_email", "customer", ["c_name"], "c_name", "email_format", "regexp_matches(c_name, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")


# Columns that may not be null.


def _refused(spark: SparkSession, sf_dir: str) -> NullabilityError:
    try:
        _run(_dirty(spark, sf_dir), {"value": {"nullable": False, "checks": [{"name": "positive"}]}})
    except NullabilityError as e:
        return e
    raise AssertionError("nulls were let through")


@query("check_auto_non_null", f"""SELECT 'value' AS "column", 'non_null' AS "check", count(*) AS count FROM ({DIRTY}) WHERE value IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'value', 'positive', count(*) FROM ({DIRTY}) WHERE NOT coalesce(value > 0, false) HAVING count(*) > 0""")
def check_auto_non_null(spark, sf_dir):
    return _refused(spark, sf_dir).errors


@query("nullability_error", f"SELECT 'Column ''value'' may not be null but has ' || count(*) || ' null value(s)' AS message, count(*) AS final_null_count FROM ({DIRTY}) WHERE value IS NULL")
def nullability_error(spark, sf_dir):
    e = _refused(spark, sf_dir)
    return spark.createDataFrame([(str(e), e.report.columns["value"].final_null_count)], "message string, final_null_count long")


# Error reports.

_VALUE = {"value": {"checks": [{"name": "between", "args": {"min": 5.0, "max": 50.0}}, {"name": "positive"}]}, "uid": {"checks": [{"name": "min_length", "args": {"length": 5}}]}}
_FAILS = f"""SELECT * FROM (SELECT 'value' AS "column", 'between' AS "check", event_id AS row_index, value::VARCHAR AS value FROM ({DIRTY}) WHERE NOT coalesce(value BETWEEN 5 AND 50, false)
    UNION ALL SELECT 'value', 'positive', event_id, value::VARCHAR FROM ({DIRTY}) WHERE NOT coalesce(value > 0, false)
    UNION ALL SELECT 'uid', 'min_length', event_id, uid FROM ({DIRTY}) WHERE length(uid) < 5)"""
_TOP = f"(SELECT *, row_number() OVER (PARTITION BY \"column\", \"check\" ORDER BY row_index) AS r FROM ({_FAILS}))"


@query("errors_summary", f'SELECT "column", "check", count(*) AS count FROM ({_FAILS}) GROUP BY ALL')
def errors_summary(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), _VALUE).errors


@query("errors_summary_limit", f'SELECT "column", "check", count(*) AS count FROM ({_FAILS}) GROUP BY ALL')
def errors_summary_limit(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), _VALUE, limit=1).errors


def _rows(result: ValidationResult) -> DataFrame:
    return result.errors.withColumn("row_indices", F.array_join(F.col("row_indices").cast("array<string>"), ","))


_LISTED = "SELECT \"column\", \"check\", count(*) AS count, string_agg(row_index, ',' ORDER BY row_index) AS row_indices FROM {} GROUP BY ALL"


@query("errors_rows", _LISTED.format(f"({_FAILS})"))
def errors_rows(spark, sf_dir):
    return _rows(_run(_dirty(spark, sf_dir), _VALUE, mode="rows"))


@query("errors_rows_limit", _LISTED.format(f"{_TOP} WHERE r <= 7"))
def errors_rows_limit(spark, sf_dir):
    return _rows(_run(_dirty(spark, sf_dir), _VALUE, mode="rows", limit=7))


def _cells(result: ValidationResult) -> DataFrame:
    """Numbers as such: engines write them as text in different ways."""
    of = F.col("column") == "value"
    return result.errors.select("column", "check", "row_index", F.when(~of, F.col("value")).alias("text"), F.when(of, F.col("value").cast("double")).alias("number"))


_CELLS = """SELECT "column", "check", row_index, CASE WHEN "column" <> 'value' THEN value END AS text, CASE WHEN "column" = 'value' THEN value::DOUBLE END AS number FROM {}"""


@query("errors_cells", _CELLS.format(f"({_FAILS})"))
def errors_cells(spark, sf_dir):
    return _cells(_run(_dirty(spark, sf_dir), _VALUE, mode="cells"))


@query("errors_cells_limit", _CELLS.format(f"{_TOP} WHERE r <= 9"))
def errors_cells_limit(spark, sf_dir):
    return _cells(_run(_dirty(spark, sf_dir), _VALUE, mode="cells", limit=9))


@query("errors_cells_novalue", f'SELECT "column", "check", row_index FROM ({_FAILS})')
def errors_cells_novalue(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), _VALUE, mode="cells", include_values=False).errors


@query("errors_empty", "SELECT * FROM (VALUES ('summary', 0::BIGINT), ('rows', 0), ('cells', 0)) t(mode, n)")
def errors_empty(spark, sf_dir):
    df = _table(spark, sf_dir, "region")
    modes = ("summary", "rows", "cells")
    return spark.createDataFrame([(m, _run(df, {"r_name": {"checks": [{"name": "non_null"}]}}, mode=m).errors.count()) for m in modes], "mode string, n long")


@query("errors_no_checks", """SELECT * FROM (VALUES ('summary', 0::BIGINT, 'column string, check string, count bigint'), ('rows', 0, 'column string, check string, count bigint, row_indices array<bigint>'),
    ('cells', 0, 'column string, check string, row_index bigint, value string')) t(mode, n, shape)""")
def errors_no_checks(spark, sf_dir):
    found = {m: _run(_table(spark, sf_dir, "region"), {"r_name": {}}, mode=m).errors for m in ("summary", "rows", "cells")}
    return spark.createDataFrame([(m, e.count(), ", ".join(f"{n} {t}" for n, t in e.dtypes)) for m, e in found.items()], "mode string, n long, shape string")


@query("data_after_rows", f"SELECT event_id, CASE WHEN value BETWEEN 5 AND 50 AND value > 0 THEN value END AS value, uid, event_type FROM ({DIRTY})")
def data_after_rows(spark, sf_dir):
    return _run(_dirty(spark, sf_dir), {"value": _VALUE["value"]}, mode="rows", limit=3, profile="clean").data


# Profiles, nullification, reports.


def _profiled(name: str, null: bool, **schema) -> None:
    column = "CASE WHEN value BETWEEN 5 AND 50 AND value > 0 THEN value END AS value" if null else "value"

    @query(name, f"SELECT event_id, {column}, uid, event_type FROM ({DIRTY})")
    def run(spark, sf_dir):
        rules = {"value": _VALUE["value"] | ({"on_failure": schema["on_failure"]} if "on_failure" in schema else {})}
        return _run(_dirty(spark, sf_dir), rules, **{k: v for k, v in schema.items() if k != "on_failure"}).data


_profiled("profile_strict", False, profile="strict")
_profiled("profile_clean", True, profile="clean")
_profiled("profile_audit", False, profile="audit")
_profiled("on_failure_override", True, profile="strict", on_failure="null")
_profiled("on_failure_raise", False, profile="clean", on_failure="raise")


@query("nullify_multi_check", f"""SELECT 'value' AS "column", count(*) FILTER (WHERE NOT coalesce(value BETWEEN 5 AND 50, false) OR NOT coalesce(value > 0, false)) AS nullified,
    count(*) FILTER (WHERE NOT coalesce(value BETWEEN 5 AND 50, false)) + count(*) FILTER (WHERE NOT coalesce(value > 0, false)) AS check_failures FROM ({DIRTY})""")
def nullify_multi_check(spark, sf_dir):
    return _stats(spark, _run(_dirty(spark, sf_dir), {"value": _VALUE["value"]}, profile="clean"), "nullified", "check_failures")


@query("nullify_eager", f"SELECT event_id, CASE WHEN value > 0 THEN value END AS value FROM ({DIRTY})")
def nullify_eager(spark, sf_dir):
    return _run(_dirty(spark, sf_dir).select("event_id", "value"), {"value": {"checks": [{"name": "positive"}]}}, profile="clean", lazy=False).data


_NULLS = "count(*) FILTER (WHERE value IS NULL)"


@query("report_columns", f"""SELECT 'value' AS "column", 0::BIGINT AS parse_failures, 0::BIGINT AS coercion_failures, count(*) FILTER (WHERE NOT coalesce(value > 0, false)) AS check_failures,
    count(*) FILTER (WHERE NOT coalesce(value > 0, false)) AS nullified, count(*) FILTER (WHERE NOT coalesce(value > 0, false)) AS final_null_count, {_NULLS} AS original_null_count FROM ({DIRTY})
    UNION ALL SELECT 'uid', 0, count(*) FILTER (WHERE uid LIKE 'x%'), 0, 0, count(*) FILTER (WHERE uid LIKE 'x%'), 0 FROM ({DIRTY})""")
def report_columns(spark, sf_dir):
    result = _run(_dirty(spark, sf_dir), {"value": {"checks": [{"name": "positive"}]}, **_UID}, coerce=True, strategy="null_on_failure", profile="clean")
    return _stats(spark, result, "parse_failures", "coercion_failures", "check_failures", "nullified", "final_null_count", "original_null_count")


def _valid(spark: SparkSession, result: ValidationResult) -> DataFrame:
    r = result.report
    return spark.createDataFrame([(r.rows_processed, r.rows_valid, r.rows_failed_distinct)], "rows_processed long, rows_valid long, rows_failed_distinct long")


_DISTINCT = f"(SELECT count(DISTINCT row_index) FROM ({_FAILS}))"


@query("report_rows_valid", f"SELECT (SELECT count(*) FROM events) AS rows_processed, greatest(0, (SELECT count(*) FROM events) - (SELECT count(*) FROM ({_FAILS}))) AS rows_valid, {_DISTINCT} AS rows_failed_distinct")
def report_rows_valid(spark, sf_dir):
    return _valid(spark, _run(_dirty(spark, sf_dir), _VALUE))


@query("report_rows_valid_cells", f"SELECT (SELECT count(*) FROM events) AS rows_processed, (SELECT count(*) FROM events) - {_DISTINCT} AS rows_valid, {_DISTINCT} AS rows_failed_distinct")
def report_rows_valid_cells(spark, sf_dir):
    return _valid(spark, _run(_dirty(spark, sf_dir), _VALUE, mode="cells"))


@query("report_no_errors", "SELECT count(*) AS rows_processed, count(*) AS rows_valid, 0::BIGINT AS rows_failed_distinct FROM orders")
def report_no_errors(spark, sf_dir):
    return _valid(spark, _run(_table(spark, sf_dir, "orders"), {"o_orderkey": {"checks": [{"name": "min_zero"}]}, "o_custkey": {}}))


# Frame checks.


@query("frame_check_min_rows", "SELECT least, (SELECT count(*) FROM region) < least AS raised FROM (VALUES (5::BIGINT), (6)) t(least)")
def frame_check_min_rows(spark, sf_dir):
    run = lambda n: lambda: _run(_table(spark, sf_dir, "region"), {"r_name": {}}, frame_checks=[{"name": "min_rows", "args": {"count": n}}])
    return spark.createDataFrame([(n, _raises(ValueError, run(n))) for n in (5, 6)], "least long, raised boolean")


@query("frame_check_duplicates", "SELECT o_custkey AS named FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY o_custkey LIMIT 100")
def frame_check_duplicates(spark, sf_dir):
    """The values that the error names, which are the first hundred."""
    df = _table(spark, sf_dir, "orders").select("o_custkey")
    named: list[int] = []
    try:
        _run(df, {"o_custkey": {}}, frame_checks=[{"name": "no_duplicate_ids", "args": {"column": "o_custkey"}}])
    except ValueError as e:
        named = json.loads(str(e).partition("values: ")[2])
    return spark.createDataFrame([(n,) for n in named], "named long")


def queries() -> dict[str, Query]:
    from . import cases  # noqa: F401: adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import cases  # noqa: F401

    return dict(ORACLES)
