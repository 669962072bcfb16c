"""What the screens list: visible documents, uploads, split files found again, and approved forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.texts import split_name


def pending_review(listed: DataFrame) -> DataFrame:
    """(doc_id) of listed documents that wait for review."""
    return listed.where("status = 'review'").select("doc_id")


def with_result(documents: DataFrame, results: DataFrame) -> DataFrame:
    """documents without the orphans of interrupted runs, which have no assembled result."""
    return documents.join(results.select("doc_id"), "doc_id", "left_semi")


def _named(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """documents (doc_id, folder) whose id or folder is among ids (name)."""
    wanted = ids.select("name").distinct()
    by = lambda c: wanted.select(F.col("name").alias(c), F.lit(True).alias(f"__{c}"))
    out = documents.withColumn("__id", F.col("doc_id").cast("string")).join(by("__id"), "__id", "left").join(by("folder"), "folder", "left")
    return out.where("____id or __folder").select(*documents.columns)


def visible(documents: DataFrame, focus: DataFrame, pending: DataFrame, batch: DataFrame) -> DataFrame:
    """documents (doc_id, folder) that the reviewer shows: of the first of focus, pending and batch that isn't empty.

    The first two name ids or folders, the batch ids only. With three empty
    ones nothing is shown. The driver only asks whether a list has a row.
    """
    for ids in (focus, pending):
        if not ids.isEmpty():
            return _named(documents, ids)
    names = batch.select(F.col("name").alias("__id")).distinct()
    return documents.withColumn("__id", F.col("doc_id").cast("string")).join(names, "__id", "left_semi").drop("__id")


def recovered_children(listing: DataFrame, uploaded: DataFrame) -> DataFrame:
    """(book, uploaded, parts, children, statuses) of uploads (book, name) whose parts X__NofM.pdf the listing (book, name, status) holds; without a status a part is uploaded. A name that the listing of a book has twice is one file."""
    listing = listing.groupBy("book", "name").agg(F.max("status").alias("status"))
    stem = split_name(F.regexp_replace("name", r"(?i)\.pdf$", ""))
    parts = listing.where(F.col("name").rlike(r"(?i)\.pdf$")).select("book", F.lower(stem["parent"]).alias("parent"), F.regexp_replace("name", r"(?i)\.pdf$", "").alias("child"), F.coalesce("status", F.lit("uploaded")).alias("status")).where("parent is not null")
    found = parts.groupBy("book", "parent").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("child", "status"))).alias("c"))  # the parts of one file
    asked = uploaded.select("book", F.col("name").alias("uploaded"), F.lower(F.regexp_replace("name", r"\.[^.]+$", "")).alias("parent"))
    out = asked.join(found, ["book", "parent"])
    return out.select("book", "uploaded", "parts", F.array_join(F.transform("c", lambda x: x["child"]), ",").alias("children"), F.array_join(F.transform("c", lambda x: x["status"]), ",").alias("statuses"))


def patched(rows: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the values that a patch of their keys gives; its nulls change nothing, and patches without row add none."""
    names = [c for c in patches.columns if c not in keys]
    out = rows.join(patches.select(*keys, *(F.col(c).alias(f"__{c}") for c in names)), keys, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def removed(rows: DataFrame, gone: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, items): what is left of each group's rows; a group with nothing left is dropped."""
    return rows.join(gone.select(*keys), keys, "left_anti").groupBy(group).agg(F.count("*").alias("items"))


def overlaid(original: DataFrame, approved: DataFrame) -> DataFrame:
    """original with the whole approved record in place of its own where there is one; ``approved`` tells which."""
    names = [c for c in original.columns if c != "doc_id"]
    other = approved.select("doc_id", F.struct(*names).alias("__a"))
    out = original.join(other, "doc_id", "left")
    there = F.col("__a").isNotNull()
    return out.select("doc_id", *(F.when(there, F.col(f"__a.{c}")).otherwise(F.col(c)).alias(c) for c in names), there.alias("approved"))


def known_upload(previous: DataFrame, children: DataFrame) -> DataFrame:
    """(doc_id, status, total, done, pending) of uploads that are known already.

    A split file counts its children, and those not closed are pending; a file
    still in the queue is one pending document; any other is one that is done.
    """
    closed = F.col("child_status").isin("done", "confirmed", "cancelled")
    each = children.select(F.col("parent").alias("doc_id"), F.col("status").alias("child_status")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~closed).alias("open"))
    split = F.col("status") == "split"
    queued = F.col("status").isin("review", "blocked", "processing", "retrying", "uploaded")
    out = previous.join(each, "doc_id", "left")
    total = F.when(split, F.coalesce("n", F.lit(0))).otherwise(1)
    pending = F.when(split, F.coalesce("open", F.lit(0))).otherwise(queued.cast("long"))
    return out.select("doc_id", "status", total.cast("long").alias("total"), (total - pending).cast("long").alias("done"), pending.cast("long").alias("pending"))


def carried_over(new: DataFrame, status: DataFrame, order: Column) -> DataFrame:
    """(doc_id, carried, place): new documents first, in their order, then those that still wait for review, by ``order``; none twice."""
    waiting = status.where("status = 'review'").select("doc_id", F.struct(F.lit(True).alias("carried"), order.cast("string").alias("place")).alias("p"))
    first = new.select("doc_id", F.struct(F.lit(False).alias("carried"), F.lpad(F.col("pos").cast("string"), 20, "0").alias("place")).alias("p"))
    return first.union(waiting).groupBy("doc_id").agg(F.min("p").alias("p")).select("doc_id", "p.carried", "p.place")
