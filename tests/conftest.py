import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).is_dir():
        pytest.skip("needs the driver's tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    """DuckDB with the driver's tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same_rows(df, relation) -> None:
    """A Spark result and a DuckDB one have equal columns and rows, in any order."""
    names = sorted(df.columns)
    theirs = [d[0] for d in relation.description]
    assert names == sorted(theirs)
    at = [theirs.index(n) for n in names]
    plain = lambda v: None if isinstance(v, float) and v != v else v
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    other = sorted(repr([plain(r[k]) for k in at]) for r in relation.fetchall())
    assert mine == other
