"""Client cards, history and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .parties import master_by_upper


def client_totals(finals: DataFrame) -> DataFrame:
    """(nif, documents, last_date, books, name) of confirmed documents (client_nif, date, book, name, folder).

    The name is that of the latest dated document with a name, the later folder
    on a tie; if no named document has a date, the first folder's.
    """
    rows = finals.withColumn("nif", F.upper(F.trim("client_nif"))).where("nif <> ''")
    named = F.trim("name") != ""
    dated = F.max(F.when(named & F.col("date").isNotNull(), F.struct("date", "folder", "name")))
    undated = F.min(F.when(named, F.struct("folder", "name")))
    out = rows.groupBy("nif").agg(F.count("*").alias("documents"), F.max("date").alias("last_date"), F.array_join(F.sort_array(F.collect_set("book")), ",").alias("books"), dated.alias("d"), undated.alias("u"))
    return out.select("nif", "documents", "last_date", "books", F.trim(F.coalesce("d.name", "u.name")).alias("name"))


def client_cards(finals: DataFrame, master: DataFrame) -> DataFrame:
    """Clients that are in the master and have a confirmed document, the latest first, then by id."""
    meta = master_by_upper(master).select(F.col("key").alias("nif"), F.col("nombre").alias("master_name"), "fecha_alta")
    out = client_totals(finals).join(meta, "nif")
    out = out.select("nif", F.coalesce("name", "master_name").alias("name"), "fecha_alta", "last_date", "documents", "books")
    return out.orderBy(F.desc_nulls_last("last_date"), "nif")


def client_history(finals: DataFrame, nif: str) -> DataFrame:
    """One client's documents, the latest first; the id is compared trimmed and in upper case."""
    when = F.coalesce("operation_date", "date", F.lit(""))
    return finals.where(F.upper(F.trim("client_nif")) == nif.strip().upper()).withColumn("sort_date", when).orderBy(F.desc("sort_date"), "folder")


def history_groups(finals: DataFrame) -> DataFrame:
    """(client_nif, day, documents): by operation date, else issue date, else sin-fecha."""
    return finals.groupBy("client_nif", F.coalesce("operation_date", "date", F.lit("sin-fecha")).alias("day")).agg(F.count("*").alias("documents"))


def run_summary(verdicts: DataFrame) -> DataFrame:
    """One row: ok, warn (with pendiente) and error (the rest)."""
    v = F.coalesce("verdict", F.lit(""))
    return verdicts.agg(F.count_if(v == "auto").alias("ok"), F.count_if(v.isin("warn", "pendiente")).alias("warn"), F.count_if(~v.isin("auto", "warn", "pendiente")).alias("error"))


def new_keys(after: DataFrame, before: DataFrame, key: str = "nif") -> DataFrame:
    """One row: how many keys came."""
    return after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("new_keys"))


def upload_summary(files: DataFrame) -> DataFrame:
    """One row: invoices, ok, blocked and skipped, by pre-scan status; an undetected number counts 1."""
    s = F.col("scan")
    n = F.coalesce("detected", F.lit(1))
    return files.agg(F.sum(n).alias("invoices"), F.count_if(~s.isin("failed", "skipped", "deferred")).alias("ok"), F.count_if(s == "failed").alias("blocked"), F.count_if(s.isin("skipped", "deferred")).alias("skipped"))


def search(totals: DataFrame, text: str) -> DataFrame:
    """Clients whose name or id contains the text, in any case."""
    found = lambda c: F.lower(c).contains(text.lower())
    return totals.where(found("name") | found("nif"))


def split_confidence(parts: DataFrame, key: str, low: float = 0.1) -> DataFrame:
    """(key, least, mean, any_low, tokens) of parts (key, confidence, tokens); parts without confidence don't count for it."""
    c = F.col("confidence")
    return parts.groupBy(key).agg(F.min(c).alias("least"), F.avg(c).cast("decimal(10,4)").alias("mean"), F.bool_or(c < low).alias("any_low"), F.sum("tokens").alias("tokens"))
