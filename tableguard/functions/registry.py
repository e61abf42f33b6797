"""Registry of parsers and checks, with strict rules for what they may be.

Column functions turn a Column into a Column and may only use the column they
are given; frame functions turn a DataFrame into a DataFrame of the same
columns and number of rows.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from contextlib import contextmanager
from typing import Annotated, Any, get_args, get_origin, get_type_hints

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

PROBE = "__tableguard_probe__"


class RegistryError(ValueError):
    """A function cannot be registered or used."""


class ColumnPurityError(RegistryError):
    """A column function does not use just its own column."""


class FrameShapeError(RegistryError):
    """A frame function changed columns or the number of rows."""


class SignatureValidator:
    """Checks a function's signature: one value of ``kind`` in, one out, and JSON defaults."""

    def __init__(self, kind: type):
        self.kind = kind

    def validate(self, func: Callable) -> None:
        if not callable(func):
            raise RegistryError(f"{func!r} is not callable")
        name = getattr(func, "__name__", repr(func))
        parameters = list(inspect.signature(func).parameters.values())
        if not parameters:
            raise RegistryError(f"{name}: needs a first parameter of type {self.kind.__name__}")
        try:
            hints = get_type_hints(func, include_extras=True)
        except Exception as e:
            raise RegistryError(f"{name}: annotations cannot be resolved: {e}") from e
        first, *rest = parameters
        if first.kind not in (first.POSITIONAL_ONLY, first.POSITIONAL_OR_KEYWORD):
            raise RegistryError(f"{name}: first parameter {first.name!r} must be positional")
        for what, key in (("first parameter", first.name), ("return value", "return")):
            if key not in hints:
                raise RegistryError(f"{name}: {what} needs the annotation {self.kind.__name__}")
            if _bare(hints[key]) is not self.kind:
                raise RegistryError(f"{name}: {what} must be annotated {self.kind.__name__}, not {hints[key]!r}")
        for p in rest:
            if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
                raise RegistryError(f"{name}: *args and **kwargs are not allowed")
            if _bare(hints.get(p.name)) in (Column, DataFrame):
                raise RegistryError(f"{name}: only the first parameter may be a Column or DataFrame, not {p.name!r}")
            if p.default is not p.empty:
                try:
                    json.dumps(p.default)
                except (TypeError, ValueError) as e:
                    raise RegistryError(f"{name}: default of {p.name!r} is not JSON: {e}") from e


def _bare(hint: Any) -> Any:
    return get_args(hint)[0] if get_origin(hint) is Annotated else hint


@contextmanager
def _quiet():
    """A probe that must fail is no error worth a log entry."""
    log = PySparkLogger.getLogger("DataFrameQueryContextLogger")
    before, log.disabled = log.disabled, True
    try:
        yield
    finally:
        log.disabled = before


class ColumnFunctionWrapper:
    """A registered column parser or check."""

    def __init__(self, func: Callable[..., Column], name: str):
        SignatureValidator(Column).validate(func)
        self.func, self.name, self.__doc__ = func, name, func.__doc__
        #: Types of this function's expressions that were found pure, by expression and source column.
        self.pure: dict[tuple[str, str], T.DataType] = {}

    def __call__(self, column: Column, *more: Any, **args: Any) -> Column:
        if not isinstance(column, Column):
            raise ColumnPurityError(f"{self.name}: input must be a Column, not {type(column).__name__}")
        out = self.func(column, *more, **args)
        if not isinstance(out, Column):
            raise RegistryError(f"{self.name}: must return a Column, not {type(out).__name__}")
        return out

    def on(self, column: Column, source: T.StructField, spark: SparkSession, **args: Any) -> tuple[Column, T.DataType]:
        """The result over an expression of ``source`` alone, and its type.

        It is resolved against an empty frame that has just the source, which
        must work, and one without it, which must not. No data is read, and an
        expression that was found pure is not tried again, as for micro-batches.
        """
        from pyspark.sql import functions as F

        out = self(column, **args)
        key = str(out), source.json()
        if key in self.pure:
            return out, self.pure[key]
        probe = F.col(f"`{source.name.replace('`', '``')}`")
        try:
            with _quiet():
                kind = spark.createDataFrame([], T.StructType([source])).select(probe, out.alias(PROBE)).schema[PROBE].dataType
        except AnalysisException as e:
            what = e.getCondition() or ""
            if what.startswith("UNRESOLVED_COLUMN"):
                raise ColumnPurityError(f"{self.name}: uses columns other than {source.name!r}: {e.getMessage()}") from e
            if what.startswith("MISSING_GROUP_BY"):
                raise RegistryError(f"{self.name}: an aggregate needs .over(...) to be a value for each row") from e
            raise
        try:
            with _quiet():
                spark.createDataFrame([], T.StructType([T.StructField(PROBE, T.StringType())])).select(out.alias("x"))
        except AnalysisException:
            if len(self.pure) >= 1024:
                self.pure.clear()
            if "..." not in key[0]:  # a shortened text may hide a difference
                self.pure[key] = kind
            return out, kind
        raise ColumnPurityError(f"{self.name}: does not use its column {source.name!r}")


class FrameFunctionWrapper:
    """A registered frame parser or check."""

    def __init__(self, func: Callable[..., DataFrame], name: str):
        SignatureValidator(DataFrame).validate(func)
        self.func, self.name, self.__doc__ = func, name, func.__doc__

    def __call__(self, frame: DataFrame, *more: Any, **args: Any) -> DataFrame:
        """The function's frame; rows are counted unless it is the one put in."""
        out = self.applied(frame, *more, **args)
        if out is not frame and (before := frame.count()) != (after := out.count()):
            raise FrameShapeError(f"{self.name}: rows changed from {before} to {after}")
        return out

    def applied(self, frame: DataFrame, *more: Any, **args: Any) -> DataFrame:
        """The function's frame, of the same columns; its rows are not counted here."""
        if not isinstance(frame, DataFrame):
            raise FrameShapeError(f"{self.name}: input must be a DataFrame, not {type(frame).__name__}")
        out = self.func(frame, *more, **args)
        if not isinstance(out, DataFrame):
            raise FrameShapeError(f"{self.name}: must return a DataFrame, not {type(out).__name__}")
        if out.columns != frame.columns:
            raise FrameShapeError(f"{self.name}: columns changed from {frame.columns} to {out.columns}")
        return out


class DecoratorAdapter:
    """Registers what it decorates: bare, with empty brackets, or with a name."""

    def __init__(self, register: Callable, **options: Any):
        self.register, self.options = register, options

    def __call__(self, func: Callable | None = None, **options: Any):
        options = self.options | {k: v for k, v in options.items() if v is not None}
        return DecoratorAdapter(self.register, **options) if func is None else self.register(func, **options)


class FunctionRegistry:
    """Named column and frame functions; each of the four kinds has names of its own."""

    def __init__(self) -> None:
        self.column_parsers: dict[str, ColumnFunctionWrapper] = {}
        self.column_checks: dict[str, ColumnFunctionWrapper] = {}
        self.frame_parsers: dict[str, FrameFunctionWrapper] = {}
        self.frame_checks: dict[str, FrameFunctionWrapper] = {}

    def register_column_parser(self, func: Callable, *, name: str | None = None) -> ColumnFunctionWrapper:
        return self._add(self.column_parsers, ColumnFunctionWrapper, func, name)

    def register_column_check(self, func: Callable, *, name: str | None = None) -> ColumnFunctionWrapper:
        return self._add(self.column_checks, ColumnFunctionWrapper, func, name)

    def register_frame_parser(self, func: Callable, *, name: str | None = None) -> FrameFunctionWrapper:
        return self._add(self.frame_parsers, FrameFunctionWrapper, func, name)

    def register_frame_check(self, func: Callable, *, name: str | None = None) -> FrameFunctionWrapper:
        return self._add(self.frame_checks, FrameFunctionWrapper, func, name)

    @staticmethod
    def _add(functions: dict, kind: type, func: Callable, name: str | None):
        func = func.func if isinstance(func, (ColumnFunctionWrapper, FrameFunctionWrapper)) else func
        name = getattr(func, "__name__", "") if name is None else name
        if not name:
            raise RegistryError("a function needs a name")
        if name in functions:
            raise RegistryError(f"{name!r} is registered already")
        functions[name] = wrapper = kind(func, name)
        return wrapper

    @property
    def column_parser(self) -> DecoratorAdapter:
        return DecoratorAdapter(self.register_column_parser)

    @property
    def column_check(self) -> DecoratorAdapter:
        return DecoratorAdapter(self.register_column_check)

    @property
    def frame_parser(self) -> DecoratorAdapter:
        return DecoratorAdapter(self.register_frame_parser)

    @property
    def frame_check(self) -> DecoratorAdapter:
        return DecoratorAdapter(self.register_frame_check)
