"""Declarative validation and sanitisation of Spark DataFrames."""

from __future__ import annotations

from .functions import ColumnPurityError, FrameShapeError, FunctionRegistry, RegistryError, default_registry
from .log import configure, configure_logging, get_logger
from .plans.validate import ErrorReportConfig, NullabilityError, ValidationResult, validate, validate_into
from .operators.coerce import CoercionError
from .operators.resolve import SchemaResolutionError, resolve_column_names
from .report import ColumnValidationStats, ValidationReport
from .schema import ColumnSchema, SchemaLoader, SchemaModel
from .sources import kept, read_csv, read_parquet, read_result, write_result
from .streaming import stateful_checks, validate_stream

configure()

__all__ = [
    "CoercionError", "ColumnPurityError", "ColumnSchema", "ColumnValidationStats", "ErrorReportConfig", "FrameShapeError", "FunctionRegistry", "NullabilityError", "RegistryError", "SchemaLoader",
    "SchemaModel", "SchemaResolutionError", "ValidationReport", "ValidationResult", "configure", "configure_logging", "default_registry", "get_logger", "kept", "read_csv", "read_parquet", "read_result", "resolve_column_names", "stateful_checks", "validate", "validate_into", "validate_stream", "write_result",
]
