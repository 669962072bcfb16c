"""Versions as X.Y.Z with or without a suffix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def version_key(version: Column) -> Column:
    """struct(major, minor, patch, release) that orders versions: a release comes after all of its number with a suffix; null if a part is no number."""
    base, suffix = F.substring_index(version, "-", 1), F.regexp_extract(version, "(?s)-(.*)$", 1)
    parts = [F.trim(F.get(F.split(base, r"\."), F.lit(k))) for k in range(3)]
    numbers = [F.when(p.rlike(r"^\+?[0-9]{1,18}$"), p.cast("long")) for p in parts]
    there = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.when(there, F.struct(*(n.alias(k) for n, k in zip(numbers, ("major", "minor", "patch"))), (suffix == "").alias("release")))


def is_newer(latest: Column, current: Column) -> Column:
    """Whether latest comes after current; if either can't be ordered, whether they differ. False if one is null or empty."""
    there = (F.coalesce(latest, F.lit("")) != "") & (F.coalesce(current, F.lit("")) != "")
    return F.when(~there, F.lit(False)).otherwise(F.coalesce(version_key(latest) > version_key(current), latest != current))
