"""Each micro-batch of a stream validated as a frame of its own, with a memory across batches where asked for."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..functions import FunctionRegistry
from ..operators.resolve import case_sensitive
from ..plans.validate import ErrorReportConfig, ValidationResult, _Run, _running
from ..schema import SchemaModel

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_checks(schema: SchemaModel, registry: FunctionRegistry) -> list[tuple[str, str]]:
    """(column, check) of the checks that a remembering stream keeps values of: those that fail for repeated values."""
    return [(name, check.name) for name, column in schema.columns.items() for check in column.checks if getattr(getattr(registry.column_checks.get(check.name), "func", None), "repeats", False)]


def validate_stream(
    stream: DataFrame,
    schema: SchemaModel,
    registry: FunctionRegistry,
    sink: Callable[[ValidationResult, int], None],
    *,
    coerce_strategy="strict",
    error_report: ErrorReportConfig | None = None,
    remember: float | None = None,
) -> DataStreamWriter:
    """A writer that hands every micro-batch's result and number to ``sink``.

    Without ``remember``, checks that compare rows, such as unique, see one
    micro-batch. With it, ``stateful_checks`` also fail for a value of an earlier batch
    that came within so many seconds, or ever if it is ``math.inf``: values, as
    parsed and coerced, are keys of Spark's state, one small entry each, that needs
    RocksDB as the session's state store. Such schemas have no frame parsers, which
    would change values after they are remembered. Frame functions and the other
    checks that compare rows still see one micro-batch. The caller sets trigger and
    checkpoint location and starts the writer.
    """
    seen: dict[str, str] = {}
    if remember is not None:
        stream, seen = _remembering(stream, schema, registry, coerce_strategy, remember)

    def each(batch: DataFrame, number: int) -> None:
        if seen:
            # State is read and written once a batch, however often its result is used.
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with _running(batch, coerce_strategy):
                result = _Run(batch, schema, registry, coerce_strategy, error_report or ErrorReportConfig(), seen).result(schema.lazy)
            sink(result, number)
        finally:
            if seen:
                batch.unpersist()

    return stream.writeStream.foreachBatch(each)


def _remembering(stream: DataFrame, schema: SchemaModel, registry: FunctionRegistry, strategy, seconds: float) -> tuple[DataFrame, dict[str, str]]:
    """The stream with a column for each remembered column, true where an earlier batch had the value; and those columns' names."""
    if schema.frame_parsers:
        raise ValueError("a stream that remembers values cannot have frame parsers")
    provider = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if provider != ROCKS:
        raise ValueError(f"remembering values needs spark.sql.streaming.stateStore.providerClass={ROCKS}")
    with case_sensitive(stream.sparkSession):
        run = _Run(stream, schema.model_copy(update={"frame_checks": []}), registry, strategy, ErrorReportConfig())
        raw = run.frame
        run._parse_and_coerce()
        columns = [n for n in dict.fromkeys(c for c, _ in stateful_checks(schema, registry)) if n in raw.columns]
        seen = {n: f"__tableguard_seen{k}__" for k, n in enumerate(columns)}
        for n, mark in seen.items():
            fields = raw.schema.fields
            key = raw.withColumn("__tableguard_key__", run.values[n])
            out = T.StructType([*key.schema.fields, T.StructField(mark, T.BooleanType())])
            ttl = None if math.isinf(seconds) else max(1, round(seconds * 1000))
            found = key.groupBy("__tableguard_key__").transformWithState(_Earlier(mark, ttl), out, "Append", "ProcessingTime" if ttl else "None")
            raw = found.select(*(F.col("`" + f.name.replace("`", "``") + "`") for f in fields), mark)
    return raw, seen


class _Earlier(StatefulProcessor):
    """Marks rows whose key an earlier batch had. Rows pass one by one, so a key may have any number of them."""

    def __init__(self, mark: str, ttl: int | None):
        self.mark, self.ttl = mark, ttl

    def init(self, handle) -> None:
        self.state = handle.getValueState("had", "rows long", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        before, n = self.state.get()[0] if self.state.exists() else 0, 0
        for r in rows:
            n += 1
            yield Row(**dict(zip(r.__fields__, r)), **{self.mark: before > 0})
        self.state.update((before + n,))

    def close(self) -> None:
        pass
