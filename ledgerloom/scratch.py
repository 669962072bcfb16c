"""Folders for what the library itself writes and reads again: streams, replayed files, versions of a stored table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: list[list[str]] = []


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine may go without: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="scratch"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, owned by the innermost :func:`owner` that is open."""
    path = f"{shared(spark)}/scratch-{uuid.uuid4().hex}/{name}"
    for made in _made[-1:]:
        made.append(path.rpartition("/")[0])
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def owner(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, all folders that :func:`folder` has named within: results that are read from them must be used or written before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)
