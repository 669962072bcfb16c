"""Fiscal duplicates: the same issuer, number and date seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: States in which a folder doesn't hold its fiscal hash, and those after which its file is let in again.
INACTIVE = ("cancelled", "error")
ADMITTED_AGAIN = ("error", "cancelled", "pre_scan_failed")


def blocked_duplicates(finals: DataFrame) -> DataFrame:
    """finals (folder, fiscal_hash, finalized_seq, status, rejected) with ``duplicate_of``.

    The first active folder of a hash stays; later ones name it. Cancelled,
    failed and rejected folders neither block nor count. Every other folder is
    considered, not one at random. A minimum by hash and a join, no window: a
    hash that many folders share is not gathered in one task.
    """
    active = F.col("fiscal_hash").isNotNull() & ~F.col("status").isin(*INACTIVE) & ~F.coalesce("rejected", F.lit(False))
    first = finals.where(active).groupBy("fiscal_hash").agg(F.min(F.struct("finalized_seq", "folder")).alias("first"))
    out = finals.join(first, "fiscal_hash", "left")
    later = active & (F.struct("finalized_seq", "folder") > F.col("first"))
    return out.withColumn("duplicate_of", F.when(later, F.col("first.folder"))).drop("first")


def admitted_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (sha256, name) that are new, or whose last known status lets them in again."""
    held = known.where(~F.col("status").isin(*ADMITTED_AGAIN)).select("sha256").distinct()
    return files.join(held, "sha256", "left_anti")


def unique_names(rows: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """rows with ``unique_name``: _2, _3 … for the later ones of a name. Names are near keys, so groups are small."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return rows.withColumn("unique_name", F.when(n > 1, F.concat_ws("_", name, n.cast("string"))).otherwise(F.col(name)))
