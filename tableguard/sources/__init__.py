"""Readers and writers of validated frames."""

from .readers import kept, read_csv, read_parquet
from .writers import read_result, write_result

__all__ = ["kept", "read_csv", "read_parquet", "read_result", "write_result"]
