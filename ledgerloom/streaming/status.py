"""The event log as a stream: current status, master updates and new files.

There is no event time: an event applies after all with a smaller ``seq``. A
watermark may bound state as an extension; none is set here, since the log's
documents stay open without limit. Operators whose results a late event
corrects are in :mod:`ledgerloom.streaming.keyed`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.parties import merge_masters


def read_events(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet event log as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_status(stream: DataFrame, key: str = "doc_id") -> DataFrame:
    """The status of the last event by key, in whatever order events come; for update or complete mode."""
    return stream.groupBy(key).agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("last_seq"))


def master_updates(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str):
    """Merges each batch of master rows into the stored master; maxima and unions make a repeated batch harmless."""

    def merge(batch: DataFrame, _: int) -> None:
        save(merge_masters(load(), batch))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(stream: DataFrame, closed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Arriving files whose document isn't closed: a stream-static anti join."""
    return stream.join(closed.select(F.col(key).alias("__closed")).distinct(), F.col(key) == F.col("__closed"), "left_outer").where("__closed is null").drop("__closed")
