import pytest

from tableguard import SchemaModel, default_registry, read_csv, read_parquet, validate
from tableguard.sources import write_result
from tableguard.streaming import validate_stream

SCHEMA = SchemaModel.from_dict({"columns": {"id": {"dtype": "Int64", "synonyms": ["nr"]}, "when": {"dtype": "Date", "nullable": True}}})


@pytest.fixture
def csv(tmp_path):
    def write(text):
        (tmp_path / "f.csv").write_text(text)
        return tmp_path / "f.csv"

    return write


def test_untyped(spark, csv):
    df = read_csv(csv('nr,when,more\n001 ,,""\n2,"a ""b"", c","x\ny"\n'), SCHEMA, multi_line=True)
    assert [tuple(r) for r in df.collect()] == [("001 ", None, None), ("2", 'a "b", c', "x\ny")] and {t for _, t in df.dtypes} == {"string"}


def test_large_files_are_read_in_parts(spark, csv):
    path = csv("nr,when,more\n" + "1,2024-01-02,3\n" * 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_csv(path, SCHEMA)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20_000
        assert read_csv(path, SCHEMA, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_typed(spark, csv):
    df = read_csv(csv("nr,when,more\n1,2024-01-02,3\n"), SCHEMA, typed=True)
    assert df.dtypes == [("nr", "bigint"), ("when", "date"), ("more", "int")]
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        read_csv(csv("nr,when\nx,2024-01-02\n"), SCHEMA, typed=True).collect()


def test_eager(spark, csv):
    df = read_csv(csv("nr,when\n1,\n"), SCHEMA, lazy=False)
    assert df.is_cached and not read_csv(csv("nr,when\n1,\n"), SCHEMA).is_cached
    df.unpersist()


def test_parquet(spark, tmp_path):
    for k in range(2):
        spark.range(k, k + 3).write.parquet(f"{tmp_path}/p{k}")
    assert read_parquet([tmp_path / "p0", tmp_path / "p1"], SCHEMA).count() == 6 and read_parquet(f"{tmp_path}/p0", SCHEMA).count() == 3


def test_write_result(spark, tmp_path):
    result = validate(spark.range(3), SCHEMA.model_copy(update={"columns": {"id": SCHEMA.columns["id"]}}), default_registry())
    write_result(result, tmp_path / "out")
    assert spark.read.parquet(f"{tmp_path}/out/data").count() == 3 and spark.read.parquet(f"{tmp_path}/out/errors").count() == 0


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("id - 5 AS id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    schema = SchemaModel.from_dict({"profile": "clean", "columns": {"id": {"dtype": "Int64", "nullable": True, "checks": [{"name": "positive"}]}}})
    seen = []
    writer = validate_stream(stream, schema, default_registry(), lambda r, n: seen.append((n, r.report.rows_processed, r.data.where("id IS NULL").count())))
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, 10, 6)]
