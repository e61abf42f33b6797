"""Dense row numbers in input order, without a global sort or one big task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import ROW_INDEX

_AT, _PART = "__tableguard_at__", "__tableguard_part__"
PARTITIONS_IN_A_LITERAL = 2000


def settled(df: DataFrame) -> DataFrame:
    """df if its rows stay in their partitions whenever it is computed, else written to the shared folder.

    Files, local rows and row-wise steps over them stay; behind a shuffle,
    adaptive execution may cut partitions another way for another job. Written
    rows stay in place even if an executor is lost. The folder is the one in
    ``spark.checkpoint.dir``; without one, Spark must run on this machine alone.
    """
    if not any(kind.endswith("ShuffleExchangeExec") for kind in _nodes(df)):
        return df
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("row numbers of shuffled rows need a folder that driver and executors share: spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tableguard-"))
    return df.checkpoint()


def _nodes(df: DataFrame):
    """Kinds of the nodes of df's physical plan."""
    left = [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        yield kind
        below = node.children()
        left += [node.initialPlan()] if kind == "AdaptiveSparkPlanExec" else [below.apply(k) for k in range(below.size())]


def with_row_index(df: DataFrame) -> DataFrame:
    """df with ROW_INDEX: 0, 1, ... in the order of partitions and their rows; see ``numbered``."""
    return numbered(df)[0]


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """df with ROW_INDEX, and how many partitions it has up to the last with rows.

    A first job counts rows by partition; offsets, one for each partition, come
    as a literal, or are broadcast where there are very many, so no row is shuffled. Rows must come in the same partitions
    each time df is computed; see ``settled``.
    """
    marked = df.withColumn(_AT, F.monotonically_increasing_id())
    part = F.shiftright(_AT, 33)
    sizes = marked.groupBy(part.alias(_PART)).agg(F.count(F.lit(1)).alias("n")).collect()
    total, offsets = 0, []
    for r in sorted(sizes):
        offsets.append((r[0], total))
        total += r[1]
    if offsets and offsets[-1][0] < PARTITIONS_IN_A_LITERAL:
        start = dict(offsets)
        at = F.lit([start.get(p, 0) for p in range(offsets[-1][0] + 1)])
        index = F.get(at, part.cast("int")) + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))
        return marked.select(*(F.col(_quoted(c)) for c in df.columns), index.cast("long").alias(ROW_INDEX)), offsets[-1][0] + 1
    starts = df.sparkSession.createDataFrame(offsets, f"{_PART} long, __tableguard_start__ long")
    joined = marked.withColumn(_PART, part).join(F.broadcast(starts), _PART, "left")
    index = F.col("__tableguard_start__") + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*(F.col(_quoted(c)) for c in df.columns), index.alias(ROW_INDEX)), offsets[-1][0] + 1 if offsets else 0


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
