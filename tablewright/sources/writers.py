"""Writing tables and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.kinds import q


def write_table(df: DataFrame, path: str) -> None:
    """Store a table, or replace the one that is stored there, from which it may be read.

    The rows go to a folder beside it first. Only when all are written do the folders change places, by name; a write that fails leaves
    the old table as it was. A reader that lists the folder while the names change finds one of both tables or none, never a mixture.
    """
    spark = df.sparkSession
    base = path.rstrip("/")
    fresh, old = (f"{base}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    files = _files(spark, base)
    try:
        df.write.option("compression", "zstd").parquet(fresh)
        held = files.exists(_place(spark, base))
        if held and not files.rename(_place(spark, base), _place(spark, old)):
            raise OSError(f"{base} cannot be renamed")
        if not files.rename(_place(spark, fresh), _place(spark, base)):
            if held:
                files.rename(_place(spark, old), _place(spark, base))
            raise OSError(f"{fresh} cannot be renamed")
        if held:
            files.delete(_place(spark, old), True)
    finally:
        files.delete(_place(spark, fresh), True)
    spark.catalog.refreshByPath(base)


def _place(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _place(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV part files with a header; the byte-order mark lets spreadsheets read other scripts correctly.

    The mark is written by putting it in front of the first header name, so each part file has it.
    """
    if bom and df.columns:
        first, *rest = df.columns
        df = df.select(q(first).alias("﻿" + first), *[q(c) for c in rest])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    write_csv(scored, path, bom=False)
