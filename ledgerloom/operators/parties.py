"""Which party of a document is the firm's client, and whether the client master knows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .verdicts import ASSEMBLING, worse

BOOKS = ("compras", "ventas", "bienes")


def client(book: Column, issuer: Column, receiver: Column) -> Column:
    """The issuer in the sales book, else the receiver."""
    return F.when(book == "ventas", issuer).otherwise(receiver)


def counterpart(book: Column, issuer: Column, receiver: Column) -> Column:
    """The other party."""
    return F.when(book == "ventas", receiver).otherwise(issuer)


def party_types(book: Column) -> tuple[Column, Column]:
    """The kinds that confirming gives issuer and receiver."""
    return F.when(book == "ventas", "cliente").otherwise("proveedor"), F.when(book == "ventas", "proveedor").otherwise("cliente")


def first_by_name(master: DataFrame) -> DataFrame:
    """(name_key, name_nif): the first master row of each upper-cased name, in master order."""
    return master.where(F.trim("nombre") != "").groupBy(F.upper(F.trim("nombre")).alias("name_key")).agg(F.min_by("nif", "pos").alias("name_nif"))


def resolve_client(documents: DataFrame, master: DataFrame) -> DataFrame:
    """documents (book, issuer_*, receiver_* with nif, name, verdict) with ``client_nif``, ``match`` and verdicts.

    ``match``: exact (by id as written), name, inversion (the other party is a
    client and this one isn't), unknown, or unavailable. Three equi-joins; the
    master is a dimension, joined as Spark sees fit.
    """
    ids = master.select(F.col("nif").alias("k")).where("k is not null").distinct()
    book = F.col("book")
    out = documents.withColumns({
        "client_nif": client(book, F.col("issuer_nif"), F.col("receiver_nif")), "client_name": client(book, F.col("issuer_name"), F.col("receiver_name")),
        "nif_verdict": client(book, F.col("issuer_verdict"), F.col("receiver_verdict")), "other_nif": counterpart(book, F.col("issuer_nif"), F.col("receiver_nif")),
        "name_key": F.upper(F.trim(client(book, F.col("issuer_name"), F.col("receiver_name")))),
    })
    out = out.join(ids.withColumnRenamed("k", "own_key"), F.col("client_nif") == F.col("own_key"), "left")
    out = out.join(ids.withColumnRenamed("k", "other_key"), F.col("other_nif") == F.col("other_key"), "left")
    out = out.join(first_by_name(master), "name_key", "left")
    blocked = ~book.isin(*BOOKS) | F.coalesce(F.col("nif_verdict") == "block", F.lit(True)) | F.col("client_nif").isNull()
    match = F.when(blocked, "unavailable").when(F.col("own_key").isNotNull(), "exact").when(F.col("name_nif").isNotNull(), "name").when(F.col("other_key").isNotNull(), "inversion").otherwise("unknown")
    out = out.withColumn("match", match)
    verdict = F.when(F.col("match") == "unavailable", "block").when(F.col("match") == "exact", F.col("nif_verdict")).otherwise(worse(F.col("nif_verdict"), F.lit("warn"), order=ASSEMBLING, unknown=3))
    return out.withColumn("client_verdict", verdict).withColumn("is_new", F.col("match").isin("unknown", "inversion")).drop("own_key", "other_key", "name_key")


def merge_masters(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """One master of two, by id: greatest count and date, sets joined in order with the stored ones first, stored name and start unless empty."""
    d, m = disk.alias("d"), memory.alias("m")
    both = d.join(m, F.col("d.nif") == F.col("m.nif"), "full")
    keep = lambda c: F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.nullif(F.col(f"m.{c}"), F.lit("")))
    sets = lambda c: F.array_union(F.coalesce(f"d.{c}", F.array().cast("array<string>")), F.coalesce(f"m.{c}", F.array().cast("array<string>")))
    return both.select(
        F.coalesce("d.nif", "m.nif").alias("nif"), F.coalesce(keep("nombre"), F.lit("")).alias("nombre"), keep("fecha_alta").alias("fecha_alta"),
        F.greatest("d.documentos", "m.documentos").alias("documentos"), F.greatest("d.ultima", "m.ultima").alias("ultima"), sets("libros").alias("libros"), sets("tipos").alias("tipos"),
    )


#: Decisions that register a client.
REGISTERED = ("auto", "warn")


def register(master: DataFrame, confirmations: DataFrame, today: str) -> DataFrame:
    """The master after confirmations (nif, nombre, date, book, kind, decision, seq), as if they came in the order of seq.

    Only the decisions auto and warn register, and only with an id. A client's
    documents are counted, its latest date kept, and books and kinds added in
    the order of their first confirmation; an empty name is filled in by the
    first that isn't, a good one stays; a new client starts ``today``.
    """
    rows = confirmations.where(F.col("decision").isin(*REGISTERED)).withColumn("nif", F.upper(F.trim("nif"))).where("nif <> ''")
    name = F.min_by(F.trim("nombre"), F.when(F.trim("nombre") != "", F.col("seq"))).alias("new_name")
    # few books and kinds: their first places are found before the shuffle
    firsts = lambda c: rows.where(F.coalesce(c, F.lit("")) != "").groupBy("nif", c).agg(F.min("seq").alias("s")).groupBy("nif").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", F.col(c).alias("v")))), lambda x: x["v"]).alias(f"new_{c}"))
    new = rows.groupBy("nif").agg(F.count("*").alias("n"), F.max(F.nullif(F.col("date"), F.lit(""))).alias("new_date"), name)
    new = new.join(firsts("book"), "nif", "left").join(firsts("kind"), "nif", "left")
    both = master.join(new, "nif", "full")
    none = F.array().cast("array<string>")
    sets = lambda old, add: F.array_union(F.coalesce(old, none), F.coalesce(add, none))
    return both.select(
        "nif", F.coalesce(F.nullif(F.trim("nombre"), F.lit("")), "new_name", F.lit("")).alias("nombre"), F.coalesce("fecha_alta", F.when(F.col("n").isNotNull(), F.lit(today))).alias("fecha_alta"),
        (F.coalesce("documentos", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("documentos"), F.greatest("ultima", "new_date").alias("ultima"), sets("libros", "new_book").alias("libros"), sets("tipos", "new_kind").alias("tipos"),
    )


def master_by_upper(master: DataFrame) -> DataFrame:
    """Clients by upper-cased id: of case duplicates the one with most documents, the first on a tie."""
    keyed = master.where(F.array_contains("tipos", "cliente")).withColumn("key", F.upper(F.trim("nif"))).where("key <> ''")
    order = W.partitionBy("key").orderBy(F.desc("documentos"), "pos")
    return keyed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
