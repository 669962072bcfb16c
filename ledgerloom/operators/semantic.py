"""Concepts and accounts: supplier defaults, whitelist, coherence and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .verdicts import ASSEMBLING, worse

AUTO = 0.95
SUPPLIER_CONFIDENCE = 0.90

#: Concept, account, and whether a person must look.
CHART = (
    ("mercaderias", "600", False), ("materias_primas", "601", False), ("aprovisionamientos", "602", False), ("trabajos_subcontratados", "607", False), ("alquiler_local", "621", False),
    ("reparacion_conservacion", "622", False), ("profesional_independiente", "623", False), ("transporte", "624", False), ("seguro", "625", False), ("gasto_bancario", "626", False),
    ("publicidad", "627", False), ("suministros", "628", False), ("servicios_generales", "629", False), ("tributo", "631", False), ("nomina", "640", True), ("seguridad_social", "642", True),
    ("venta_mercaderias", "700", False), ("prestacion_servicios", "705", False), ("ingresos_maquinas_recreativas", "705.01", False),
    ("instalacion_tecnica", "212", True), ("maquinaria", "213", True), ("mobiliario", "216", True), ("equipo_informatico", "217", True), ("vehiculo", "218", True), ("no_clasificado", None, True),
)

#: Accounts that each book admits.
WHITELIST = {
    "compras": ("600", "601", "602", "621", "622", "623", "624", "625", "626", "627", "628", "629", "631", "640", "642", "649"),
    "ventas": ("700", "701", "705", "706", "708", "709", "750"),
    "bienes": ("212", "213", "216", "217", "218"),
}

#: The book of an account's first digit.
GROUPS = {"6": "compras", "7": "ventas", "2": "bienes"}


def book_of_group(account: Column) -> Column:
    """The book that the account's first digit belongs to, else null."""
    out = F.lit(None).cast("string")
    for digit, book in GROUPS.items():
        out = F.when(F.substring(account, 1, 1) == digit, book).otherwise(out)
    return out


def admitted(account: Column, book: Column) -> Column:
    """In the book's whitelist, itself or by what stands before its point. Books without whitelist admit all; a missing account isn't admitted."""
    out = F.lit(True)
    for name, codes in WHITELIST.items():
        out = F.when(book == name, account.isin(list(codes)) | F.substring_index(account, ".", 1).isin(list(codes))).otherwise(out)
    return F.when(F.coalesce(account, F.lit("")) == "", False).otherwise(out)


def coherent(account: Column, book: Column) -> Column:
    """The account's group belongs to the book, or to none."""
    return F.coalesce(book_of_group(account) == book, F.lit(True))


def suppliers_by_id(suppliers: DataFrame) -> DataFrame:
    """The supplier dimension by upper-cased id: blank ids dropped, the last of several rows stays."""
    keyed = suppliers.withColumn("nif", F.upper(F.trim("nif"))).where("nif <> ''")
    last = F.row_number().over(W.partitionBy("nif").orderBy(F.desc("pos")))
    return keyed.withColumn("__n", last).where("__n = 1").drop("__n").withColumn("confidence", F.coalesce("confidence", F.lit(SUPPLIER_CONFIDENCE).cast("decimal(5,4)")))


def known_supplier(documents: DataFrame, suppliers: DataFrame) -> DataFrame:
    """documents with the supplier's default concept, account and confidence; a row without account is no match."""
    dim = suppliers_by_id(suppliers).where("account <> ''").select("nif", F.col("concept").alias("supplier_concept"), F.col("account").alias("supplier_account"), F.col("confidence").alias("supplier_confidence"))
    return documents.withColumn("nif", F.upper(F.trim("issuer_nif"))).join(dim, "nif", "left").drop("nif")


def account_concepts(chart: DataFrame) -> DataFrame:
    """(account, concept): the inverse map; rows without account dropped, the last wins."""
    return chart.where(F.coalesce("account", F.lit("")) != "").groupBy("account").agg(F.max_by("concept", "pos").alias("concept"))


def consistent_concept(rows: DataFrame, chart: DataFrame) -> DataFrame:
    """rows with an invalid concept replaced by the account's, else null."""
    known = chart.select(F.col("concept").alias("valid")).distinct()
    by_account = account_concepts(chart).select(F.col("account"), F.col("concept").alias("derived"))
    out = rows.join(known, F.col("concept") == F.col("valid"), "left").join(by_account, "account", "left")
    return out.withColumn("concept", F.coalesce("valid", "derived")).drop("valid", "derived")


def best_pair(candidates: DataFrame) -> DataFrame:
    """(doc_id, concept, account, confidences): the concept of highest confidence, and the account of highest confidence, of that concept's candidates if it has any."""
    order = W.partitionBy("doc_id").orderBy(F.desc("confidence"), "pos")
    first = candidates.withColumn("chosen", F.first("concept").over(order)).withColumn("chosen_confidence", F.first("confidence").over(order))
    same = F.col("concept").eqNullSafe(F.col("chosen"))
    pick = F.min(F.struct((~same).alias("other"), (-F.col("confidence")).alias("c"), "pos", "account", "confidence"))
    out = first.groupBy("doc_id").agg(pick.alias("b"), F.first("chosen").alias("concept"), F.first("chosen_confidence").alias("concept_confidence"))
    return out.select("doc_id", "concept", "concept_confidence", F.col("b.account").alias("account"), F.col("b.confidence").alias("account_confidence"))


def pair_verdicts(pairs: DataFrame, review: Column, auto: float = AUTO) -> DataFrame:
    """pairs (book, concept, account, confidences) with concept, account and joint verdicts."""
    limit = F.lit(str(auto)).cast("decimal(5,4)")
    asset = F.col("book") == "bienes"
    concept = F.when((F.col("concept_confidence") >= limit) & ~F.coalesce(review, F.lit(False)), "auto").otherwise("warn")
    account = F.when(F.col("account_confidence") >= limit, "auto").otherwise("warn")
    account = F.when(F.col("account").isNotNull() & ~admitted(F.col("account"), F.col("book")), "block").otherwise(account)
    account = F.when(~coherent(F.col("account"), F.col("book")) & account.isin("auto", "pendiente"), "warn").otherwise(account)
    raised = lambda c: F.when(asset & c.isin("auto", "pendiente"), "warn").otherwise(c)
    out = pairs.withColumns({"concept_verdict": raised(concept), "account_verdict": raised(account)})
    return out.withColumn("verdict", worse(F.col("concept_verdict"), F.col("account_verdict"), order=ASSEMBLING))
