"""Queries whose rows say what each case led to: an error's kind, or a count over the table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import FunctionRegistry, default_registry
from ..operators.errors import rows_of_pages
from ..schema import SchemaLoader, SchemaModel
from ..sources import kept, read_csv
from ..sources.readers import RAGGED
from .catalogue import _FAILS, _VALUE, DIRTY, _dirty, _run, _table, query, shared_folder
from .validate import ErrorReportConfig, validate, validate_into

Case = tuple[str, Callable[[], int]]


def _outcomes(spark: SparkSession, cases: list[Case]) -> DataFrame:
    """(case, error, n): the class of what a case raised, or its count."""
    rows = []
    for name, f in cases:
        try:
            rows.append((name, None, f()))
        except Exception as e:  # noqa: BLE001: which one it is, is the result
            rows.append((name, type(e).__name__, None))
    return spark.createDataFrame(rows, "case string, error string, n long")


def _expected(errors: dict[str, str], counts: dict[str, str]) -> str:
    """SQL for the same rows; counts by what is selected."""
    raised = (f"SELECT '{c}' AS \"case\", '{e}' AS error, NULL::BIGINT AS n" for c, e in errors.items())
    counted = (f"SELECT '{c}' AS \"case\", NULL::VARCHAR AS error, {n}" for c, n in counts.items())
    return " UNION ALL ".join((*raised, *counted))


def _failures(df: DataFrame, columns: dict, **more) -> int:
    """All failing checks."""
    return sum(s.check_failures for s in _run(df, columns, **more).report.columns.values())


_ROWS = "count(*)::BIGINT AS n FROM customer"


@query("resolution_errors", _expected({"missing": "SchemaResolutionError", "ambiguous": "SchemaResolutionError", "claimed twice": "SchemaResolutionError", "other case": "SchemaResolutionError"}, {"found": _ROWS, "optional": _ROWS}))
def resolution_errors(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = lambda columns: lambda: _run(df, columns).report.rows_processed
    return _outcomes(spark, [
        ("missing", rows({"key": {"dtype": "Int64"}})),
        ("ambiguous", rows({"key": {"dtype": "Int64", "synonyms": ["c_custkey", "c_name"]}})),
        ("claimed twice", rows({"a": {"dtype": "Utf8", "synonyms": ["c_name"]}, "b": {"dtype": "Utf8", "synonyms": ["c_name"]}})),
        ("other case", rows({"C_NAME": {"dtype": "Utf8"}})),
        ("found", rows({"key": {"dtype": "Int64", "synonyms": ["c_custkey"]}})),
        ("optional", rows({"key": {"dtype": "Int64", "required": False}})),
    ])


_UNKNOWN = {"column parser": "KeyError", "column check": "KeyError", "frame parser": "KeyError", "frame check": "KeyError", "strategy": "ValueError", "report mode": "ValidationError", "report key": "ValidationError", "negative limit": "ValidationError"}


@query("unknown_names", _expected(_UNKNOWN, {"known": "count(*) FILTER (WHERE NOT coalesce(c_acctbal > 0, false))::BIGINT AS n FROM customer"}))
def unknown_names(spark, sf_dir):
    df, nope = _table(spark, sf_dir, "customer"), [{"name": "nope"}]
    run = lambda **rules: lambda: _failures(df, {"c_acctbal": rules})
    config = lambda **more: lambda: _run(df, {"c_acctbal": {}}, **more).report.rows_processed
    return _outcomes(spark, [
        ("column parser", run(parsers=nope)), ("column check", run(checks=nope)), ("frame parser", config(frame_parsers=nope)), ("frame check", config(frame_checks=nope)),
        ("strategy", config(strategy="never")), ("report mode", config(mode="none")), ("report key", lambda: bool(ErrorReportConfig(colour="red"))), ("negative limit", config(mode="rows", limit=-1)),
        ("known", run(checks=[{"name": "positive"}])),
    ])


@query("dtype_mismatch", """SELECT 'CoercionError' AS error, count(*) AS listed, 3::BIGINT AS suggestions FROM (SELECT * FROM orders LIMIT 0) RIGHT JOIN (VALUES ('o_orderdate'), ('o_orderkey')) t(name) ON true""")
def dtype_mismatch(spark, sf_dir):
    """What a column that cannot be cast is told about: every column's types, and suggestions."""
    df = _table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    try:
        _run(df, {"o_orderdate": {"dtype": "List"}, "o_orderkey": {"dtype": "Int64"}}, coerce=True)
        row = (None, 0, 0)
    except ValueError as e:
        lines = str(e).splitlines()
        row = (type(e).__name__, sum(": current " in x and ", expected " in x for x in lines), sum(x.startswith("  - ") for x in lines))
    return spark.createDataFrame([row], "error string, listed long, suggestions long")


def _registrations() -> dict[str, Callable]:
    def no_parameter() -> Column: ...
    def no_annotation(c) -> Column: ...
    def other_annotation(c: str) -> Column: ...
    def no_return(c: Column): ...
    def other_return(c: Column) -> str: ...
    def keyword_first(*, c: Column) -> Column: ...
    def star(c: Column, *more: int) -> Column: ...
    def double_star(c: Column, **more: int) -> Column: ...
    def second_column(c: Column, d: Column) -> Column: ...
    def second_frame(c: Column, d: DataFrame) -> Column: ...
    def no_json(c: Column, d: object = object()) -> Column: ...  # noqa: B008
    def unresolved(c: "Nowhere") -> Column: ...  # noqa: F821

    cases = [no_parameter, no_annotation, other_annotation, no_return, other_return, keyword_first, star, double_star, second_column, second_frame, no_json, unresolved]
    return {f.__name__: f for f in cases} | {"not callable": 5}


_SMALL = "count(*) FILTER (WHERE NOT coalesce(c_acctbal >= {}, false))::BIGINT AS n FROM customer"


@query("registration_errors", _expected(dict.fromkeys([*_registrations(), "twice", "no name"], "RegistryError"), {"bare": _SMALL.format(10), "brackets": _SMALL.format(20), "named": _SMALL.format(30), "wrapper": _SMALL.format(10), "other kind": _SMALL.format(10)}))
def registration_errors(spark, sf_dir):
    """Functions that may not be registered, and the forms of those that may, each used on the table."""
    df, registry = _table(spark, sf_dir, "customer"), FunctionRegistry()

    @registry.column_check
    def bare(c: Column, least: float = 10) -> Column:
        return c >= least

    @registry.column_check()
    def brackets(c: Column) -> Column:
        return c >= 20

    @registry.column_check(name="named")
    def nameless(c: Column) -> Column:
        return c >= 30

    registry.register_column_check(bare, name="wrapper")
    registry.column_parser(bare)  # each kind has names of its own
    used = lambda name: lambda: _failures(df, {"c_acctbal": {"checks": [{"name": name}]}}, registry=registry)
    refused = lambda f, **more: lambda: bool(FunctionRegistry().register_column_check(f, **more))
    cases = [(name, refused(f)) for name, f in _registrations().items()]
    cases += [("twice", lambda: bool(registry.column_check(brackets))), ("no name", refused(bare.func, name=""))]
    return _outcomes(spark, cases + [(n, used(n)) for n in ("bare", "brackets", "named", "wrapper")] + [("other kind", used("bare"))])


_PURE = {"other column": "ColumnPurityError", "no column": "ColumnPurityError", "no Column in": "ColumnPurityError", "no Column out": "RegistryError", "no boolean": "RegistryError", "aggregate": "RegistryError"}
_PURE |= {"no frame in": "FrameShapeError", "no frame out": "FrameShapeError", "column added": "FrameShapeError", "columns moved": "FrameShapeError", "row lost": "FrameShapeError", "row lost in a check": "FrameShapeError"}


@query("purity_errors", _expected(_PURE, {"own column": "count(*) FILTER (WHERE NOT coalesce(length(c_name) > 3, false))::BIGINT AS n FROM customer", "dtype changed": "count(*)::BIGINT AS n FROM customer", "is ValueError": "count(*)::BIGINT AS n FROM customer"}))
def purity_errors(spark, sf_dir):
    """Column functions that use more or less than their column, and frame functions that change a frame's shape."""
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")

    def check(f: Callable) -> Callable[[], int]:
        registry = FunctionRegistry()

        def used(c: Column) -> Column:
            return f(c)

        registry.register_column_check(used)
        return lambda: _failures(df, {"c_name": {"checks": [{"name": "used"}]}}, registry=registry)

    def frame(f: Callable, kind: str = "frame_parser") -> Callable[[], int]:
        registry = FunctionRegistry()

        def used(d: DataFrame) -> DataFrame:
            return f(d)

        getattr(registry, f"register_{kind}")(used)
        return lambda: _run(df, {"c_name": {}}, registry=registry, **{f"{kind}s": [{"name": "used"}]}).report.rows_processed

    def all_are_value_errors() -> int:
        for bad in (check(lambda c: F.col("c_custkey") > 1), frame(lambda d: d.drop("c_name"))):
            try:
                bad()
                return -1
            except ValueError:
                pass
        return df.count()

    registry = default_registry()
    return _outcomes(spark, [
        ("other column", check(lambda c: c == F.col("c_custkey").cast("string"))), ("no column", check(lambda c: F.lit(True))), ("no Column in", lambda: bool(registry.column_checks["positive"](5))),
        ("no Column out", check(lambda c: True)), ("no boolean", check(lambda c: F.length(c))), ("aggregate", check(lambda c: F.max(c) == "x")),
        ("no frame in", lambda: bool(registry.frame_parsers["deduplicate"]([1]))), ("no frame out", frame(lambda d: d.columns)), ("column added", frame(lambda d: d.withColumn("x", F.lit(1)))),
        ("columns moved", frame(lambda d: d.select(*reversed(d.columns)))), ("row lost", frame(lambda d: d.where("c_custkey > 1"))), ("row lost in a check", frame(lambda d: d.where("c_custkey > 1"), "frame_check")),
        ("own column", check(lambda c: F.length(c) > 3)), ("dtype changed", frame(lambda d: d.withColumn("c_custkey", F.col("c_custkey").cast("string")))), ("is ValueError", all_are_value_errors),
    ])


# Reports as text, loaders, sinks, lifetimes.

_BAD = "count(*) FILTER (WHERE NOT coalesce(value > 0, false))"


@query("report_text", f"""SELECT 'Validation Report (Profile: clean)' || chr(10) || 'Rows: ' || greatest(0, n - bad) || '/' || n || ' valid (' || printf('%.1f', 100.0 * greatest(0, n - bad) / n) || '%)' || chr(10) || chr(10) || 'Column Issues:' || chr(10)
    || '  value:' || chr(10) || '    Check failures: ' || bad || chr(10) || '    Nullified: ' || bad || chr(10) || '    Final nulls: ' || bad AS text, '["data", "errors", "report"]' AS fields
    FROM (SELECT count(*) AS n, {_BAD} AS bad FROM ({DIRTY}))""")
def report_text(spark, sf_dir):
    result = _run(_dirty(spark, sf_dir), {"value": {"checks": [{"name": "positive"}]}, "uid": {}}, profile="clean")
    fields = ", ".join(f'"{n}"' for n in result.__dataclass_fields__)
    return spark.createDataFrame([(result.report.summary(), f"[{fields}]")], "text string, fields string")


_LOADED = {"columns": {"c_acctbal": {"dtype": "Float64", "nullable": True, "checks": [{"name": "positive"}]}}}
_JSON = '{"columns": {"c_acctbal": {"dtype": "Float64", "nullable": true, "checks": [{"name": "positive"}]}}}'
_YAML = "columns:\n  c_acctbal:\n    dtype: Float64\n    nullable: true\n    checks:\n      - name: positive\n"
_FORMS = ["dict", "python", "model", "json", "yaml", "json file", "yaml file", "file", "loader mapping", "loader json", "loader yaml file"]
_INVALID = {"bad json": "ValueError", "bad yaml": "ValueError", "no mapping": "ValueError", "no file": "ValueError", "suffix": "ValueError", "unknown key": "ValueError", "unknown dtype": "ValueError", "null where none may be": "ValueError", "loader bad json": "JSONDecodeError", "loader no file": "FileNotFoundError"}


@query("schema_loaders", _expected(_INVALID, dict.fromkeys(_FORMS, "count(*) FILTER (WHERE NOT coalesce(c_acctbal > 0, false))::BIGINT AS n FROM customer")))
def schema_loaders(spark, sf_dir):
    """One schema by every loader, used on the table, and what loaders refuse. Files are the driver's own."""
    df, loader = _table(spark, sf_dir, "customer"), SchemaLoader()
    with tempfile.TemporaryDirectory() as folder:
        paths = {name: Path(folder, name) for name in ("s.json", "s.yaml", "s.YML", "s.txt")}
        for name, path in paths.items():
            path.write_text(_JSON if name == "s.json" else _YAML)
        used = lambda load: lambda: validate(df, load(), default_registry()).report.columns["c_acctbal"].check_failures
        loads = [
            lambda: SchemaModel.from_dict(_LOADED), lambda: SchemaModel.from_python(_LOADED), lambda: SchemaModel.from_python(SchemaModel.from_dict(_LOADED)), lambda: SchemaModel.from_json(_JSON), lambda: SchemaModel.from_yaml(_YAML),
            lambda: SchemaModel.from_json_file(paths["s.json"]), lambda: SchemaModel.from_yaml_file(paths["s.yaml"]), lambda: SchemaModel.from_file(paths["s.YML"]),
            lambda: loader.from_mapping(_LOADED), lambda: loader.from_json_str(_JSON), lambda: loader.from_yaml_file(paths["s.yaml"]),
        ]
        column = lambda **rules: lambda: SchemaModel.from_dict({"columns": {"c_acctbal": rules}})
        refused = [
            lambda: SchemaModel.from_json("{"), lambda: SchemaModel.from_yaml("a: [1"), lambda: SchemaModel.from_json("[1]"), lambda: SchemaModel.from_file(f"{folder}/none.json"), lambda: SchemaModel.from_file(paths["s.txt"]),
            column(dtype="Utf8", colour="red"), column(dtype="Text"), column(dtype="Utf8", on_failure="null"), lambda: loader.from_json_str("{"), lambda: loader.from_json_file(f"{folder}/none.json"),
        ]
        return _outcomes(spark, [(n, used(f)) for n, f in zip(_FORMS, loads)] + [(n, used(f)) for n, f in zip(_INVALID, refused)])


@query("sink_one_pass", f"SELECT event_id, CASE WHEN value BETWEEN 5 AND 50 AND value > 0 THEN value END AS value, uid, event_type, (SELECT count(*) FROM ({_FAILS})) AS failures, (SELECT count(*) FROM events) AS rows_processed FROM ({DIRTY})")
def sink_one_pass(spark, sf_dir):
    """Data that came back from the sink, beside counts of its errors and report; the second write replaces the first."""
    folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    schema = SchemaModel.from_dict({"coerce": False, "profile": "clean", "columns": {n: {"nullable": True, "dtype": "Utf8"} | r for n, r in _VALUE.items()} | {"uid": {"nullable": True, "dtype": "Utf8", "on_failure": "raise"} | _VALUE["uid"]}})
    for mode in ("errorifexists", "overwrite"):
        result = validate_into(_dirty(spark, sf_dir), schema, default_registry(), folder, mode=mode, error_report=ErrorReportConfig(mode="cells"))
    return result.data.withColumns({"failures": F.lit(result.errors.count()), "rows_processed": F.lit(result.report.rows_processed).cast("long")})


@query("errors_pages", f'SELECT "column", "check", row_index FROM ({_FAILS})')
def errors_pages(spark, sf_dir):
    """Row numbers of a paged report, taken out of its runs again."""
    return rows_of_pages(_paged(spark, sf_dir))


@query("errors_page_runs", f"""SELECT "column", "check", page, sum(length)::BIGINT AS count, string_agg(start || '+' || length, ',' ORDER BY start) AS runs FROM (
    SELECT "column", "check", page, min(row_index) AS start, count(*) AS length FROM (
      SELECT *, row_index // 65536 AS page, row_index - row_number() OVER (PARTITION BY "column", "check", row_index // 65536 ORDER BY row_index) AS island FROM ({_FAILS})) GROUP BY "column", "check", page, island) GROUP BY ALL""")
def errors_page_runs(spark, sf_dir):
    runs = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit("+"), r["length"].cast("string")))
    return _paged(spark, sf_dir).select("column", "check", "page", "count", F.array_join(runs, ",").alias("runs"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(_dirty(spark, sf_dir), _VALUE, mode="rows", row_lists="pages").errors


@query("csv_ragged", f"SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey || ',' || o_orderstatus || ',more' END AS {RAGGED} FROM orders")
def csv_ragged(spark, sf_dir):
    """Orders as a file in which every seventh row has one field too many, which is reported."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    more = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_orderstatus", F.lit(",more"))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    # Whole lines, under a whole header: the writer would quote fields.
    line = F.concat_ws(",", "o_orderkey", more).alias("o_orderkey,o_orderstatus")
    _table(spark, sf_dir, "orders").select(line).write.options(header=True, sep="\x01").csv(path)
    return read_csv(path, SchemaModel.from_dict({"columns": {"o_orderkey": {"dtype": "Int64"}}}), ragged="report")


@query("eager_lifetimes", "SELECT frame, n, true AS kept, false AS after FROM (VALUES ('csv', (SELECT count(*) FROM nation)), ('result', (SELECT count(*) FROM events))) t(frame, n)")
def eager_lifetimes(spark, sf_dir):
    """What eager frames keep in a block, and after it."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    rows = []
    with kept(read_csv(path, SchemaModel.from_dict({"columns": {}}), lazy=False)) as df:
        held = (df.count(), df.is_cached)
    rows.append(("csv", *held, df.is_cached))
    with _run(_dirty(spark, sf_dir), {"value": {"checks": [{"name": "positive"}]}}, lazy=False) as result:
        held = (result.data.count(), result.data.is_cached)
    rows.append(("result", *held, result.data.is_cached))
    return spark.createDataFrame(rows, "frame string, n long, kept boolean, after boolean")
