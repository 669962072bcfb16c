"""Sets that keep an order, given by a position column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import folder


def first_wins(*tables: DataFrame, key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The union's rows by key: of the earlier table, then of the smaller position; with ``place``, which orders the result."""
    tagged = [t.select(key, F.struct(F.lit(k).alias("t"), F.col(pos).alias("p")).alias("place")) for k, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.min("place").alias("place"))


def last_wins(*tables: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): of the last table that has the key."""
    tagged = [t.select(key, F.struct(F.lit(k).alias("t"), F.col(value).alias("v")).alias("place")) for k, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.max("place").alias("place")).select(key, F.col("place.v").alias(value))


def without(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """left's rows, in their order, whose key right doesn't have."""
    return left.join(right.select(key), key, "left_anti")


def refreshed(before: DataFrame, now: DataFrame, key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """now's keys: those known before in their old order, then the new ones; with ``place``."""
    old = before.select(key, F.col(pos).alias("old"))
    return now.join(old, key, "left").select(key, F.struct(F.col("old").isNull().alias("new"), F.coalesce("old", pos).alias("p")).alias("place"))


def covers_pages(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, ok): page groups are disjoint, in range, and hold every page. groups (doc_id, pages array), documents (doc_id, n_pages)."""
    pages = groups.select("doc_id", F.explode("pages").alias("page"))
    seen = pages.groupBy("doc_id").agg(F.count("page").alias("n"), F.count_distinct("page").alias("d"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    ok = (F.col("n") == F.col("d")) & (F.col("d") == F.col("n_pages")) & (F.col("lo") >= 1) & (F.col("hi") <= F.col("n_pages"))
    return documents.join(seen, "doc_id", "left").select("doc_id", F.coalesce(ok, F.lit(False)).alias("ok"))


def one_page_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, part, parts, child): a group for each page."""
    each = documents.where("n_pages >= 1").select("doc_id", "n_pages", F.explode(F.sequence(F.lit(1), "n_pages")).alias("part"))
    return each.select("doc_id", "part", F.col("n_pages").alias("parts"), F.concat(F.col("doc_id").cast("string"), F.lit("__"), F.col("part").cast("string"), F.lit("of"), F.col("n_pages").cast("string")).alias("child"))


def indexed(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """rows, as a stored table, with ``part`` and ``index``: its place from 0 in the order of columns, all of which may repeat.

    Rows are sorted by ranges whose bounds are sampled from the order itself, and
    stored once: a part's first place is the number of rows in the parts before
    it, of which there are as many as ranges. No task sees all rows, unless all
    are equal.
    """
    from pyspark.sql import Window as W

    spark = rows.sparkSession
    path = folder(spark, "ordered")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("part", F.shiftright("__id", 33))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    counts = kept.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    index = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(counts), "part").withColumn("index", index).drop("__id", "__before")


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their number, from 1, in the order of columns."""
    return indexed(rows, *order).withColumn(name, (F.col("index") + 1).cast("int")).drop("part", "index")
