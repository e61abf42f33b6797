"""The engine's public names in one place."""

from .operators.coerce import CoercionError
from .operators.resolve import SchemaResolutionError, resolve_column_names
from .plans.validate import ErrorReportConfig, NullabilityError, ValidationResult, validate, validate_into
from .report import ColumnValidationStats, ValidationReport

__all__ = ["CoercionError", "ColumnValidationStats", "ErrorReportConfig", "NullabilityError", "SchemaResolutionError", "ValidationReport", "ValidationResult", "resolve_column_names", "validate", "validate_into"]
