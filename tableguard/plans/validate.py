"""The validation pipeline.

Every step is an expression over the row it is about: parsed and coerced
values, a flag for each failed coercion, a mask for each check. One aggregate
then yields all counts, errors are exploded from the masks, and data replaces
masked values; nothing is joined back. Without frame functions a validation
is one aggregate, plus what its result's data and errors are used for. ``validate_into``
observes the counts while it writes the data, and needs no pass of its own.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from typing import Literal

from pydantic import BaseModel, ConfigDict, Field
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import FrameShapeError, FunctionRegistry
from ..functions.builtins import ROW_INDEX
from ..operators import errors
from ..operators.checks import any_of, masks, with_marks
from ..operators.coerce import CoercionError, Strategy, coerced, mismatch, raised_by_cast
from ..operators.resolve import case_sensitive, resolve_column_names
from ..operators.rowindex import _quoted, numbered, settled
from ..report import ColumnValidationStats, ValidationReport
from ..schema import SchemaModel
from ..sources.writers import read_result, staged, write_report


class ErrorReportConfig(BaseModel):
    """How much detail errors have: counts, row numbers, or single cells."""

    model_config = ConfigDict(extra="forbid")

    mode: Literal["summary", "rows", "cells"] = "summary"
    limit: int | None = Field(None, ge=0)
    include_values: bool = True
    #: How ``rows`` reports list row numbers: a list for each check, or pages of runs of bounded size.
    row_lists: Literal["whole", "pages"] = "whole"


@dataclass(frozen=True)
class ValidationResult:
    """Validated data, errors, and the report.

    An eager result's data are kept by Spark until ``release``, or until the end of
    a ``with`` block.
    """

    data: DataFrame
    errors: DataFrame
    report: ValidationReport

    def release(self) -> None:
        """Give back what an eager result keeps; data are computed again if they are used later."""
        self.data.unpersist(blocking=True)

    def __enter__(self) -> ValidationResult:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class NullabilityError(ValueError):
    """Nulls are left where there may be none; carries errors and report."""

    def __init__(self, message: str, errors: DataFrame, report: ValidationReport):
        super().__init__(message)
        self.errors, self.report = errors, report


def validate(
    df: DataFrame,
    schema: SchemaModel,
    registry: FunctionRegistry,
    *,
    lazy: bool | None = None,
    coerce_strategy: Strategy = "strict",
    error_report: ErrorReportConfig | None = None,
) -> ValidationResult:
    """Validate a frame.

    In this order: column names, original nulls, frame parsers, column parsers,
    coercion, frame checks, column checks, errors, nulls for failures where the
    schema says so, nullability, report. Failing checks are reported; only nulls
    in columns that may not be null, failed strict coercions and frame functions
    raise. ``lazy`` overrides the schema's; an eager result's data are computed
    and kept until it is released. For ``rows`` and ``cells`` reports, rows are numbered
    in the order of the input; an input that comes out of a shuffle is written to the
    shared folder for that (``spark.checkpoint.dir``). Rows that the last frame
    function has added or lost are noticed by the counts of the steps after it.
    """
    with _running(df, coerce_strategy):
        return _Run(df, schema, registry, coerce_strategy, error_report or ErrorReportConfig()).result(schema.lazy if lazy is None else lazy)


def validate_into(
    df: DataFrame,
    schema: SchemaModel,
    registry: FunctionRegistry,
    folder: str | Path,
    *,
    mode: str = "errorifexists",
    coerce_strategy: Strategy = "strict",
    error_report: ErrorReportConfig | None = None,
) -> ValidationResult:
    """Validate a frame, write data, errors and report below a folder, and read them back.

    Counts are observed while data are written: a summary reads the input once.
    Detailed errors read it once more, only the columns with failing checks. All is
    written beside the folder, which appears whole at the end or, if anything
    raises, not at all. ``mode`` is errorifexists, overwrite or ignore.
    """
    with _running(df, coerce_strategy), staged(df.sparkSession, folder, mode) as at:
        if at is not None:
            _Run(df, schema, registry, coerce_strategy, error_report or ErrorReportConfig()).into(at)
    return read_result(df.sparkSession, folder)


@contextmanager
def _running(df: DataFrame, strategy: Strategy):
    if strategy not in ("strict", "null_on_failure"):
        raise ValueError(f"Unknown coerce strategy: {strategy!r}")
    with case_sensitive(df.sparkSession):
        try:
            yield
        except PySparkException as e:
            raise raised_by_cast(e) or e from e


class _Run:
    def __init__(self, df: DataFrame, schema: SchemaModel, registry: FunctionRegistry, strategy: Strategy, config: ErrorReportConfig, seen: dict[str, str] | None = None):
        self.schema, self.registry, self.strategy, self.config = schema, registry, strategy, config
        self.frame = resolve_column_names(schema, df)
        self.names = [n for n in schema.columns if n in self.frame.columns]
        #: By column, another one that is true where a stream had the value in an earlier batch.
        self.seen = seen or {}
        self.output = [c for c in self.frame.columns if c not in self.seen.values()]
        self.known: dict[str, int] = {}
        #: A frame function whose rows have not been counted, and how many they should be.
        self.pending: tuple[str, int] | None = None

    def result(self, lazy: bool) -> ValidationResult:
        self._prepare()
        self._count(self.wanted)
        found, report = self._reported()
        # Marks shuffle rows: data that does not depend on them keeps away from them.
        own = [(m, name) for (c, k, m), (_, _, name) in zip(self.checks, self.marked) if c in self.nullify]
        apart = not any((c, k) in self.marks for c, k, _ in self.checks if c in self.nullify)
        data = self._data(self.plain.select("*", *(m.alias(name) for m, name in own)) if apart else self.masked)
        if not lazy:
            data = data.persist(StorageLevel.MEMORY_AND_DISK)
            data.count()
        return ValidationResult(data, found, report)

    def into(self, folder: str) -> None:
        """Write data, errors and report; the pass that writes data makes the counts."""
        self._prepare()
        seen = Observation()
        self._data(self.masked.observe(seen, *_metrics(self.wanted.values()))).write.parquet(f"{folder}/data")
        self._known(seen.get, self.wanted)
        found, report = self._reported()
        found.write.parquet(f"{folder}/errors")
        write_report(self.frame.sparkSession, report, folder)

    def _prepare(self) -> None:
        """All steps up to the masks, and which counts are wanted over them."""
        if self.config.mode != "summary":
            self.frame, self.partitions = numbered(settled(self.frame))
        if self.schema.frame_parsers:
            self._count({f"original:{n}": F.col(_quoted(n)).isNull() for n in self.names})
            self._frame_functions(self.schema.frame_parsers, self.registry.frame_parsers, "parser")
        flags = self._parse_and_coerce()
        if self.schema.frame_checks:
            flagged, given = self.frame, self.frame.drop(*flags.values()) if flags else self.frame
            self.frame = given
            self._frame_functions(self.schema.frame_checks, self.registry.frame_checks, "check", lambda: self._count({k: F.col(c) for k, c in flags.items()}, flagged))
            # Checks mostly return what they were given; its flags are then counted with all else.
            self.frame, flags = (flagged, flags) if self.frame is given else (self.frame, {})
        self.plain = self.frame
        self.frame, self.marks = with_marks(self.frame, self.schema, self.registry)
        self.marks = {(c, k): mark & ~F.col(self.seen[c]) if c in self.seen else mark for (c, k), mark in self.marks.items()}
        self.checks = masks(self.frame, self.schema, self.registry, self.marks)
        self.marked = marked = [(column, check, f"__m{k}") for k, (column, check, _) in enumerate(self.checks)]
        self.masked = self.frame.select("*", *(m.alias(name) for (_, _, m), (_, _, name) in zip(self.checks, marked)))
        self.nullify = {n: any_of([F.col(m) for c, _, m in marked if c == n]) for n in self.names if self.schema.resolve_on_failure(n) == "null" and any(c == n for c, _, _ in marked)}
        null = lambda n: F.col(_quoted(n)).isNull()
        final = {n: null(n) | self.nullify[n] if n in self.nullify else null(n) for n in self.names}
        self.wanted = {k: F.col(c) for k, c in flags.items()} | {f"check:{m}": F.col(m) for _, _, m in marked} | {f"final:{n}": c for n, c in final.items()} | {f"nullified:{n}": c for n, c in self.nullify.items()}
        if marked:
            self.wanted["failed"] = any_of([F.col(m) for _, _, m in marked])
        self.frame = self.masked

    def _data(self, source: DataFrame) -> DataFrame:
        return source.select(*(F.when(~self.nullify[c], F.col(_quoted(c))).alias(c) if c in self.nullify else F.col(_quoted(c)) for c in self.output))

    def _reported(self) -> tuple[DataFrame, ValidationReport]:
        """Errors and report, from the counts; raises where nulls are left that may not be."""
        counts = [(column, check, self.known[f"check:{m}"]) for column, check, m in self.marked]
        found, report = self._errors(self.masked, self.marked, counts), self._report(counts)
        for n in self.names:
            if not self.schema.columns[n].nullable and self.known[f"final:{n}"]:
                raise NullabilityError(f"Column {n!r} may not be null but has {self.known[f'final:{n}']} null value(s)", found, report)
        return found, report

    def _count(self, wanted: dict[str, Column], frame: DataFrame | None = None) -> None:
        """Rows, and rows where each condition holds, in one aggregate.

        Observing them would take one job less but leave generated code at each row;
        it pays where it rides on a pass that is made anyway, as in ``into``.
        """
        self._known((self.frame if frame is None else frame).agg(*_metrics(wanted.values())).first(), wanted)

    def _known(self, row, wanted) -> None:
        if self.pending and self.pending[1] != row["n"]:
            name, before = self.pending
            raise FrameShapeError(f"{name}: rows changed from {before} to {row['n']}")
        self.pending = None
        self.known |= {"rows": row["n"]} | {k: row[f"c{i}"] for i, k in enumerate(wanted)}

    def _frame_functions(self, references, functions, what: str, before_change=None) -> None:
        """Rows were counted before the first; one that returns what it was given needs no count, and the last one's come with the next counts."""
        for r in references:
            if r.name not in functions:
                raise KeyError(f"Unknown frame {what}: {r.name!r}")
            if self.pending:
                self._count({})
            out = functions[r.name].applied(self.frame, **r.args)
            if out is not self.frame:
                if before_change:
                    before_change()
                    before_change = None
                self.frame, self.pending = out, (r.name, self.known["rows"])

    def _statistics(self, func, c: Column) -> dict:
        """What a parser asks to know of its whole column, by one aggregate."""
        asked = getattr(func, "statistics", None)
        return self.frame.agg(*(f(c).alias(k) for k, f in asked.items())).first().asDict() if asked else {}

    def _parse_and_coerce(self) -> dict[str, str]:
        """Parsed and coerced columns in place; returns flag columns by what they count."""
        spark, fields = self.frame.sparkSession, {f.name: f for f in self.frame.schema.fields}
        parsed: dict[str, Column] = {}
        kinds = {}
        for n in self.names:
            c, kinds[n] = F.col(_quoted(n)), fields[n].dataType
            for r in self.schema.columns[n].parsers:
                if r.name not in self.registry.column_parsers:
                    raise KeyError(f"Unknown column parser: {r.name!r}")
                parser = self.registry.column_parsers[r.name]
                c, kinds[n] = parser.on(c, fields[n], spark, **r.args, **self._statistics(parser.func, c))
            parsed[n] = c
        flags: dict[str, str] = {}
        extra: list[Column] = []
        if not self.schema.frame_parsers:
            for k, n in enumerate(self.names):
                flags[f"original:{n}"] = f"__o{k}"
                extra.append(F.col(_quoted(n)).isNull().alias(f"__o{k}"))
        self.values = values = parsed
        if self.schema.coerce:
            try:
                self.values = values = {n: coerced(c, kinds[n], n, self.schema.columns[n].dtype, self.strategy) for n, c in parsed.items()}
                self.frame.select(*values.values())
            except (AnalysisException, CoercionError) as e:
                raise mismatch(self.frame, self.schema, e) from e
            if self.strategy == "null_on_failure":
                for k, n in enumerate(self.names):
                    flags[f"coercion:{n}"] = f"__f{k}"
                    extra.append((parsed[n].isNotNull() & values[n].isNull()).alias(f"__f{k}"))
        self.frame = self.frame.select(*(values[c].alias(c) if c in values else F.col(_quoted(c)) for c in self.frame.columns), *extra)
        return flags

    def _errors(self, masked: DataFrame, marked, counts) -> DataFrame:
        mode, limit = self.config.mode, self.config.limit
        if mode == "summary":
            return errors.summary(masked.sparkSession, counts)
        if mode == "rows" and limit == 0:
            return errors.rows_at_limit_zero(masked.sparkSession, counts, self.config.row_lists == "pages")
        # Checks without failures need no place in the explosion.
        failing = [m for m, (_, _, n) in zip(marked, counts) if n]
        return errors.detailed(masked, failing, mode, limit, self.config.include_values, self.known["rows"], self.partitions, self.config.row_lists == "pages")

    def _report(self, counts) -> ValidationReport:
        known, total = self.known, self.known["rows"]
        failures = {n: sum(k for c, _, k in counts if c == n) for n in self.schema.columns}
        failed = known.get("failed", 0)
        columns = {
            n: ColumnValidationStats(
                column_name=n, coercion_failures=known.get(f"coercion:{n}", 0), check_failures=failures[n], nullified=known.get(f"nullified:{n}", 0), final_null_count=known.get(f"final:{n}", 0), original_null_count=known.get(f"original:{n}", 0)
            )
            for n in self.schema.columns
        }
        valid = total - failed if self.config.mode == "cells" else max(0, total - sum(failures.values()))
        return ValidationReport(rows_processed=total, rows_valid=valid, profile_used=self.schema.profile, columns=columns, rows_failed_distinct=failed)


def _metrics(conditions) -> list[Column]:
    """Rows as n, and rows where conditions hold as c0, c1, ..."""
    return [F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"c{k}") for k, c in enumerate(conditions))]


__all__ = ["ErrorReportConfig", "NullabilityError", "ROW_INDEX", "ValidationResult", "validate", "validate_into"]
