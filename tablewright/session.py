"""Session helpers: sensible defaults for our own runs, and the checkpoint folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tablewright") -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own session in."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


ROWS_PER_TASK = 2_000  # fewer rows than this are not worth a task of their own
MOST_ROWS_PER_TASK = 500_000  # of a table that is spread


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a local session gets a temporary folder of its own; any other
    master is refused, as its executors would write to folders that the others cannot see.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    # The key cannot be set in a running session, so the context keeps the folder.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder, read back: computed once, and safe when executors are lost."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(df: DataFrame) -> None:
    """Remove a table of :func:`written` that nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in what is computed inside the block; the session's setting comes back after it.

    For whole texts: the usual batch of 10,000 is held by the executor and by the worker at once, in every task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame) -> DataFrame:
    """A result of a few rows (one per column or class), computed once and held as a local table.

    For results that several others are built from; their size is bounded by the number of
    columns or classes, never by the number of rows.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def spread(df: DataFrame, rows: int, few: int = 5_000_000) -> DataFrame:
    """A table of few rows over all cores, for work that is heavy per row.

    A single small file is read by one task, whatever the cluster. A table of more than ``few`` rows
    has tasks enough and is returned as it is.
    """
    if rows > few:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(cores, rows // ROWS_PER_TASK + 1), math.ceil(rows / MOST_ROWS_PER_TASK)))
