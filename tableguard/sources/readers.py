"""CSV and Parquet readers."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path
from typing import Literal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes
from ..schema import SchemaModel

_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "enforceSchema": "true"}

Ragged = Literal["raise", "report", "cut"]
#: The column that ``ragged="report"`` adds; underscores follow where the file has one of that name.
RAGGED = "_ragged"
_MARK = "\x00tableguard end of record\x00"


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _loaded(df: DataFrame, schema: SchemaModel, lazy: bool | None) -> DataFrame:
    """Eager frames are read now and kept; they spill to disk rather than fail."""
    if schema.lazy if lazy is None else lazy:
        return df
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


@contextmanager
def kept(df: DataFrame):
    """An eager frame for the length of a block; Spark gives it up at the end."""
    try:
        yield df
    finally:
        df.unpersist(blocking=True)


def _too_long(raw: Column, width: int) -> Column:
    """Whether a record has more fields than the header, given that it has more or fewer.

    With one more field at its end that nothing else equals, a record that is too short has it
    among the header's fields or right after them; one that is too long has something else there.
    """
    names = [f"_{k}" for k in range(width + 1)]
    fields = F.from_csv(F.concat(raw, F.lit(f",{_MARK}")), ", ".join(f"{n} string" for n in names), {"escape": '"', "quote": '"', "maxColumns": str(max(20480, 4 * width))})
    return ~F.coalesce(F.array_contains(F.array(*(F.coalesce(fields[n], F.lit("")) for n in names)), _MARK), F.lit(False))


def _checked(reader, path: str, shape: T.StructType, ragged: Ragged) -> DataFrame:
    """The file's rows as text, and what to do with those that have more fields than the header."""
    if ragged == "cut" or not len(shape):
        return reader.schema(shape).csv(path)
    raw = RAGGED
    while raw in shape.names:
        raw += "_"
    texts = T.StructType([T.StructField(n, T.StringType()) for n in shape.names] + [T.StructField(raw, T.StringType())])
    read = reader.schema(texts).options(mode="PERMISSIVE", columnNameOfCorruptRecord=raw, columnPruning=False).csv(path)
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    long = F.col(raw).isNotNull() & _too_long(F.col(raw), len(shape))
    if ragged == "report":
        return read.select(*map(quoted, shape.names), F.when(long, F.col(raw)).alias(raw))
    # Spark does not read records alone, without a column of the file.
    message = F.concat(F.lit(f"MALFORMED_CSV_RECORD: more than {len(shape)} fields, the first is "), F.coalesce(quoted(shape.names[0]), F.lit("empty")), F.lit(": "), F.col(raw))
    return read.where(F.when(long, F.raise_error(message).cast("boolean")).otherwise(True)).drop(raw)


def read_csv(path: str | Path, schema: SchemaModel, lazy: bool | None = None, *, typed: bool = False, multi_line: bool = False, ragged: Ragged = "raise") -> DataFrame:
    """A CSV file or folder with a header row.

    Large files are read in parts. ``multi_line`` is for files whose quoted
    values hold line ends; each of those is read by one task.

    Every column is text and keeps its white space; empty fields are null. With
    ``typed``, columns that the schema names, by name or synonym, get its
    dtypes, a value that does not fit raises, and other columns are inferred.

    A row with fewer fields than the header ends in nulls. One with more raises
    when it is read, whatever columns are asked for; with ``ragged="report"`` a further
    column, ``RAGGED``, has the whole record of such rows and is null for others, and with
    ``ragged="cut"`` further fields are dropped without notice. ``typed`` reads always
    raise for rows of any other length.
    """
    if ragged not in ("raise", "report", "cut"):
        raise ValueError(f"Unknown handling of ragged rows: {ragged!r}")
    reader = _session().read.options(**_OPTIONS, multiLine=multi_line)
    if not typed:
        shape = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(str(path)).columns])
        return _loaded(_checked(reader, str(path), shape, ragged), schema, lazy)
    wanted = {n: dtypes.resolve(c.dtype) for name, c in schema.columns.items() for n in (name, *c.synonyms)}
    header = reader.csv(str(path)).columns
    rest = [c for c in header if c not in wanted]
    # Only unnamed columns need a look at the data.
    kinds = {f.name: f.dataType for f in reader.option("inferSchema", "true").csv(str(path)).schema} if rest else {}
    shape = T.StructType([T.StructField(c, (wanted[c].spark or T.StringType()) if c in wanted else kinds.get(c, T.StringType())) for c in header])
    return _loaded(reader.schema(shape).option("mode", "FAILFAST").csv(str(path)), schema, lazy)


def read_parquet(path: str | Path | Iterable[str | Path], schema: SchemaModel, lazy: bool | None = None) -> DataFrame:
    """One or several Parquet files or folders, with the types they have."""
    paths = [path] if isinstance(path, (str, Path)) else list(path)
    return _loaded(_session().read.parquet(*map(str, paths)), schema, lazy)
