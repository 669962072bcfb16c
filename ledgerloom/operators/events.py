"""The append-only event log of documents: order is ``seq``, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: The states that may follow each state; "" is the start.
TRANSITIONS = {
    "": ("uploaded", "processing"),
    "uploaded": ("processing", "cancelled", "error", "split", "pre_scan_failed"),
    "processing": ("done", "review", "blocked", "error", "cancelled", "retrying", "renamed", "split"),
    "retrying": ("processing", "done", "review", "blocked", "error", "cancelled"),
    "review": ("done", "review", "blocked", "renamed", "cancelled"),
    "done": ("confirmed", "review", "renamed", "cancelled"),
    "confirmed": ("renamed",),
    "blocked": ("retrying", "renamed", "cancelled"),
    "cancelled": ("retrying",),
    "error": ("retrying", "processing", "cancelled"),
    "renamed": ("done", "review", "blocked", "confirmed", "error", "cancelled", "retrying"),
    "reset": (),
    "split": (),
    "pre_scan_failed": ("retrying", "uploaded", "cancelled", "split"),
}

TERMINAL = ("confirmed", "blocked", "cancelled", "error", "split", "pre_scan_failed")
VERDICT_STATUS = {"auto": "done", "warn": "review", "pendiente": "review", "block": "blocked", "error": "error"}


def status_of_verdict(verdict: Column) -> Column:
    """The status that a verdict leads to; unknown verdicts are errors."""
    out = F.lit("error")
    for v, s in VERDICT_STATUS.items():
        out = F.when(verdict == v, s).otherwise(out)
    return out


def screen_status(status: Column) -> Column:
    """The status as the screens show it."""
    return (
        F.when(status.isin("done", "renamed"), "ok").when(status == "review", "warn").when(status == "blocked", "block")
        .when(status.isin("error", "pre_scan_failed"), "error").when(status == "confirmed", "confirmed").when(status == "cancelled", "cancelled").otherwise("pending")
    )


def last_status(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, last_seq): the status of the last event. One shuffle, partial maxima."""
    return events.groupBy(key).agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("last_seq"))


def first_of(column: str, order: str = "seq") -> Column:
    """Aggregate: the first value that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def last_of(column: str, order: str = "seq") -> Column:
    """Aggregate: the last value that isn't null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def _allowed(previous: Column, status: Column) -> Column:
    pairs = [f"{a}>{b}" for a, after in TRANSITIONS.items() for b in after]
    return F.concat_ws(">", F.coalesce(previous, F.lit("")), status).isin(pairs)


def transitions(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Events with the previous status, whether the step is allowed, and whether the status is known at all.

    A step that isn't allowed is a warning; an unknown status is an error.
    """
    previous = F.lag("status").over(W.partitionBy(key).orderBy("seq"))
    known = F.col("status").isin([s for s in TRANSITIONS if s])
    return events.withColumn("previous_status", previous).withColumns({"allowed": _allowed(F.col("previous_status"), F.col("status")), "known": known})


def attempts(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Events with ``attempt``: one more than the retries before."""
    before = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("attempt", F.coalesce(F.sum((F.col("status") == "retrying").cast("int")).over(before), F.lit(0)) + 1)


def rejections(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rejections): times that a person sent the document back."""
    return events.groupBy(key).agg(F.count_if((F.col("status") == "review") & (F.col("action") == "reject")).alias("rejections"))


def confirmed(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, confirmed): by the last status, or by an old event that is done and confirmed in one."""
    old = F.max((F.col("status") == "done") & (F.col("action") == "confirmed"))
    return events.groupBy(key).agg(((F.max_by("status", "seq") == "confirmed") | F.coalesce(old, F.lit(False))).alias("confirmed"))


def listed(status: DataFrame, done: bool = True, confirmed: bool = False, cancelled: bool = False, split: bool = False) -> DataFrame:
    """The documents that the list shows: four switches over the last status; an unknown one is shown."""
    s = F.coalesce("status", F.lit(""))
    hidden = [name for name, on in (("done", done), ("confirmed", confirmed), ("cancelled", cancelled), ("split", split)) if not on]
    return status.where(~s.isin(hidden)) if hidden else status


def unfinished(status: DataFrame) -> DataFrame:
    """Documents still to be processed: not done and not in a terminal state."""
    return status.where(~F.coalesce("status", F.lit("")).isin("done", *TERMINAL))


def latest_choice(choices: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, action, book): the last of approve and reject wins; a missing book keeps the one before."""
    return choices.where(F.col("action").isin("approve", "reject")).groupBy(key).agg(F.max_by("action", "seq").alias("action"), last_of("book").alias("book"))


def statistics(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: documents, a histogram of four verdicts, approvals and rejections."""
    docs = verdicts.agg(F.count("*").alias("documents"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("auto", "warn", "pendiente", "block")))
    acts = events.agg(F.count_if(F.col("action") == "approve").alias("approved"), F.count_if(F.col("action") == "reject").alias("rejected"))
    return docs.join(F.broadcast(acts))  # one row by one row


def children(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(parent, child, status) of the last split of each document; children without events are left out."""
    parents = events.groupBy(key).agg(F.max_by("split_into", F.when(F.col("status") == "split", F.col("seq"))).alias("into"))
    each = parents.select(F.col(key).alias("parent"), F.explode("into").alias("child"))
    return each.join(last_status(events, key).select(F.col(key).alias("child"), "status"), "child")


def holders(events: DataFrame, digest: str, key: str = "doc_id") -> DataFrame:
    """Documents with a file digest in any of their events."""
    return events.where(F.col("sha256_file") == digest).select(key).distinct()


def child_rows(each: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, folder, status, sha256_file, file_origin) of the uploaded events of children (doc_id of the parent, child, book, sha256_file).

    A child has its book in its folder's name and its parent's digest with its
    own id; one whose folder is known in the same book is left as it is.
    """
    child, parent = F.col("child").cast("string"), F.col("doc_id").cast("string")
    new = each.withColumn("folder", F.concat_ws("_", "book", child)).join(known.select("folder").distinct(), "folder", "left_anti")
    return new.select(
        F.col("child").alias("doc_id"), "folder", F.lit("uploaded").alias("status"), F.concat(F.col("sha256_file"), F.lit("#"), child).alias("sha256_file"), F.concat(parent, F.lit("__"), child, F.lit(".pdf")).alias("file_origin")
    )


def child_events(splits: DataFrame, known: DataFrame) -> DataFrame:
    """:func:`child_rows` of the children in ``split_into`` of splits (doc_id, book, sha256_file, split_into)."""
    return child_rows(splits.select("doc_id", "book", "sha256_file", F.explode("split_into").alias("child")), known)


def folder_of(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, book, folder) for wanted (doc_id, book): the first folder of the document, of that book if one is named."""
    known = documents.select("doc_id", "folder")
    met = wanted.join(known, "doc_id").where(F.col("book").isNull() | F.col("folder").startswith(F.concat("book", F.lit("_"))))
    return met.groupBy("doc_id", "book").agg(F.min("folder").alias("folder"))


def not_processed(files: DataFrame, status: DataFrame) -> DataFrame:
    """files whose document has no status, or one that isn't done or terminal."""
    closed = status.where(F.col("status").isin("done", *TERMINAL))
    return files.join(closed.select("doc_id"), "doc_id", "left_anti")


def shown_status(files: DataFrame, status: DataFrame) -> DataFrame:
    """files with their last status as the screens show it; without any, pending."""
    out = files.join(status.select("doc_id", "status"), "doc_id", "left")
    return out.select(*files.columns, screen_status(F.col("status")).alias("shown"))
