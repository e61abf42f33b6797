"""Parquet sink for the parts of a result, which appear together or not at all."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from ..report import ValidationReport


@contextmanager
def staged(spark: SparkSession, folder: str | Path, mode: str):
    """A folder to write to, beside the one asked for, which it becomes at the end; none where mode ignores one that is there.

    If anything raises, what was written goes and the folder is as it was. A folder
    that is replaced is moved aside first, and back if its successor cannot take
    its place. This rests on renaming of folders, as file systems do at once; on a
    store that copies, ``report`` is the last part to be written.
    """
    if mode not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError(f"Unknown mode: {mode!r}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(str(folder))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        if mode == "errorifexists":
            raise FileExistsError(f"{folder} exists")
        if mode == "ignore":
            yield None
            return
    mark = uuid.uuid4().hex
    at, old = (path(target.getParent(), f".{target.getName()}-{kind}-{mark}") for kind in ("new", "old"))
    try:
        yield at.toString()
        replaced = fs.exists(target)
        if replaced and (mode != "overwrite" or not fs.rename(target, old)):
            raise FileExistsError(f"{folder} exists")
        if not fs.rename(at, target):
            if replaced:
                fs.rename(old, target)
            raise OSError(f"cannot move {at.toString()} to {folder}")
        if replaced:
            fs.delete(old, True)
    except BaseException:
        fs.delete(at, True)
        raise


def write_report(spark: SparkSession, report: ValidationReport, folder: str) -> None:
    spark.createDataFrame([(report.model_dump_json(),)], "value string").coalesce(1).write.text(f"{folder}/report")


def write_result(result, folder: str | Path, *, mode: str = "errorifexists") -> None:
    """Write data, errors and report below a folder, which appears whole or, if anything raises, not at all.

    ``mode`` is errorifexists, overwrite or ignore. Data and errors are computed one
    after the other; ``validate_into`` validates and writes in one pass.
    """
    spark = result.data.sparkSession
    with staged(spark, folder, mode) as at:
        if at is not None:
            result.data.write.parquet(f"{at}/data")
            result.errors.write.parquet(f"{at}/errors")
            write_report(spark, result.report, at)


def read_result(spark: SparkSession, folder: str | Path):
    """A result that was written below a folder."""
    from ..plans.validate import ValidationResult

    report = ValidationReport.model_validate_json(spark.read.text(f"{folder}/report").first()[0])
    return ValidationResult(spark.read.parquet(f"{folder}/data"), spark.read.parquet(f"{folder}/errors"), report)
