"""Outcome of a validation, as plain objects."""

from __future__ import annotations

from pydantic import BaseModel, ConfigDict, Field

from .schema import Profile


class ColumnValidationStats(BaseModel):
    """Counts of one column; ``parse_failures`` is always 0, parsers report none."""

    model_config = ConfigDict(extra="forbid")

    # The names of the fields and their order, here and in the report.
    column_name: str
    parse_failures: int = 0
    coercion_failures: int = 0
    check_failures: int = 0
    nullified: int = 0
    final_null_count: int = 0
    original_null_count: int = 0


class ValidationReport(BaseModel):
    """``rows_valid`` is the rows less the failures (in cells mode: less the rows
    that fail); ``rows_failed_distinct`` is the number of rows that fail."""

    model_config = ConfigDict(extra="forbid")

    rows_processed: int
    rows_valid: int
    profile_used: Profile
    columns: dict[str, ColumnValidationStats] = Field(default_factory=dict)
    rows_failed_distinct: int = 0

    def summary(self) -> str:
        # The words of the summary.
        share = 100 * self.rows_valid / self.rows_processed if self.rows_processed else 0.0
        out = [f"Validation Report (Profile: {self.profile_used})", f"Rows: {self.rows_valid}/{self.rows_processed} valid ({share:.1f}%)", "", "Column Issues:"]
        for name, stats in self.columns.items():
            if not (stats.nullified or stats.check_failures):
                continue
            counts = {"Coercion failures": stats.coercion_failures, "Check failures": stats.check_failures, "Nullified": stats.nullified}
            out.append(f"  {name}:")
            out += [f"    {label}: {n}" for label, n in counts.items() if n]
            out.append(f"    Final nulls: {stats.final_null_count}")
        return "\n".join(out)
