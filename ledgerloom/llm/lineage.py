"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: The setting for the rows of an Arrow batch.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine may go without: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="scratch"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder; a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside goes to Python in Arrow batches of at most so many rows: an executor holds each task's batch twice while its buffers grow."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that :func:`cut` wrote and that no table in use depends on any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            if "/ledgerloom-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
