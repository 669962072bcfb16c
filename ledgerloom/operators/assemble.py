"""From module results in long form to one assembled document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .verdicts import ASSEMBLING, named, rank

#: The module that answers for each field, and the fields that the joint verdict counts.
ROUTES = {
    "nif_entidad": "identidad", "nombre_entidad": "identidad", "numero_factura": "identidad", "fecha_expedicion": "identidad", "fecha_operacion": "identidad",
    "nif_receptor": "identidad", "nombre_receptor": "identidad", "total_euros": "fiscal", "lineas_fiscales": "fiscal", "concepto": "semantica", "cuenta_contable": "semantica",
    "nif_cliente": "cliente", "nombre_cliente": "cliente",
}
MANDATORY = ("nif_entidad", "nombre_entidad", "numero_factura", "fecha_expedicion", "total_euros", "nif_receptor", "concepto", "nif_cliente", "nombre_cliente")
MODULES = ("ocr", "identidad", "fiscal", "semantica", "cliente")


def routes(spark: SparkSession) -> DataFrame:
    """(field, module): the routing table, as data."""
    return spark.createDataFrame(list(ROUTES.items()), "field string, module string")


def module_states(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(doc_id, module, state): ok, pendiente if there is no artifact, error if it is corrupt."""
    there = artifacts.groupBy("doc_id").agg(*(F.max(F.when(F.col("module") == m, F.col("corrupt"))).alias(m) for m in MODULES))
    state = lambda m: F.when(F.col(m), "error").when(F.col(m).isNull(), "pendiente").otherwise("ok")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("module"), state(m).alias("state")) for m in MODULES))).alias("x")
    return documents.select("doc_id").join(there, "doc_id", "left").select("doc_id", each).select("doc_id", "x.*")  # a row for each document until the end


def routed_fields(documents: DataFrame, fields: DataFrame, states: DataFrame) -> DataFrame:
    """(doc_id, field, value, verdict): every routed field of every document.

    A field counts only from its own module. Without it the verdict follows the
    module: pendiente if it is absent, block if it is corrupt or silent.
    """
    table = F.broadcast(routes(documents.sparkSession))
    wanted = documents.select("doc_id").crossJoin(table)  # by the 13 rows of the routing table
    out = wanted.join(states, ["doc_id", "module"], "left").join(fields, ["doc_id", "module", "field"], "left")
    verdict = F.coalesce("verdict", F.when(F.coalesce("state", F.lit("pendiente")) == "pendiente", "pendiente").otherwise("block"))
    return out.select("doc_id", "field", "value", verdict.alias("verdict"))


def joint_verdict(fields: DataFrame) -> DataFrame:
    """(doc_id, verdict, loadable, reasons): the worst of the mandatory fields, a missing one counting as block; reasons by field name."""
    counted = fields.where(F.col("field").isin(*MANDATORY))
    missing = F.size(F.collect_set("field")) < len(MANDATORY)
    worst = F.max(F.when(F.col("verdict").isin(*ASSEMBLING), rank(F.col("verdict"), ASSEMBLING)).otherwise(3))
    why = F.sort_array(F.collect_list(F.when(F.col("verdict") != "auto", F.concat("field", F.lit(": "), "verdict"))))
    out = counted.groupBy("doc_id").agg(F.when(missing, "block").otherwise(named(worst, ASSEMBLING)).alias("verdict"), F.array_join(why, "; ").alias("reasons"))
    return out.withColumn("loadable", F.col("verdict") == "auto")


def cross_checks(fields: DataFrame) -> DataFrame:
    """(doc_id, dates_ordered, id_format_ok, sum_ok, rate_in_catalogue): null where a check can't be computed; the last two always."""
    value = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    verdict = F.max(F.when((F.col("field") == "nif_entidad") & F.col("value").isNotNull(), F.col("verdict")))
    none = F.lit(None).cast("boolean")
    return fields.groupBy("doc_id").agg((value("fecha_expedicion") <= value("fecha_operacion")).alias("dates_ordered"), verdict.isin("auto", "warn").alias("id_format_ok")).withColumns({"sum_ok": none, "rate_in_catalogue": none})


def wide(fields: DataFrame) -> DataFrame:
    """One row per document, a column per field."""
    return fields.groupBy("doc_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ROUTES))


def wide_documents(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """:func:`wide` of :func:`routed_fields`, without their verdicts and so without states: a value that is there is shuffled once, by document, with its field's number.

    Rows are combined after the shuffle only: before it they would be sorted with 13 columns each.
    """
    number = F.coalesce(*(F.when((F.col("module") == m) & (F.col("field") == f), k) for k, (f, m) in enumerate(ROUTES.items())))
    known = fields.where("doc_id is not null and value is not null").select("doc_id", number.cast("tinyint").alias("k"), "value").where("k is not null")
    none = F.lit(None).cast("tinyint").alias("k"), F.lit(None).cast("string").alias("value")
    rows = documents.select("doc_id", *none).union(known).repartition("doc_id")
    values = (F.max(F.when(F.col("k") == k, F.col("value"))).alias(f) for k, f in enumerate(ROUTES))
    return rows.groupBy("doc_id").agg(F.max(F.col("k").isNull()).alias("there"), *values).where("there").drop("there")


def edited(final: DataFrame, baseline: DataFrame) -> DataFrame:
    """final (doc_id, field, value) with ``edited``: in the baseline, and with another value; two nulls are equal."""
    base = baseline.select("doc_id", "field", F.col("value").alias("before"), F.lit(True).alias("known"))
    out = final.join(base, ["doc_id", "field"], "left")
    return out.select("doc_id", "field", "value", (F.coalesce("known", F.lit(False)) & ~F.col("value").eqNullSafe(F.col("before"))).alias("edited"))


def with_mandatory(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """Field rows of each document with the mandatory ones added empty, in order of name."""
    wanted = documents.select("doc_id", F.explode(F.array(*map(F.lit, MANDATORY))).alias("field"))
    both = wanted.join(fields, ["doc_id", "field"], "full")
    return both.select("doc_id", "field", F.coalesce("value", F.lit("")).alias("value"))
