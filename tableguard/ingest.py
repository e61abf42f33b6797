"""The readers' public names in one place."""

from .sources import kept, read_csv, read_parquet

__all__ = ["kept", "read_csv", "read_parquet"]
