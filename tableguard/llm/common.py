"""Small pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ROWS_A_FILE = 1_000_000


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    return F.filter(F.split(c, GAP, -1), lambda w: w != "")


def fresh(name: str, taken) -> str:
    """A column name that begins with an underscore and is not among those taken, case aside."""
    low = {t.lower() for t in taken}
    out, k = f"_{name}", 0
    while out.lower() in low:
        out, k = f"_{name}{k}", k + 1
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is
    unset a temporary folder is made, but only if Spark runs on this machine
    alone: executors elsewhere would not see it.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tableguard-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    With a bound on its rows, no more files are written than they fill: small
    tables in many files cost more to open than to read.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, lost executors or not."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("table-"):
                folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
