"""Append-only and partitioned outputs."""

from __future__ import annotations

import logging
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import csv_cell_lf
from ..operators.ordered import first_wins

CRITICAL = ("nif_entidad", "nombre_entidad", "numero_factura", "fecha_expedicion", "total_euros", "nif_receptor", "nombre_receptor", "concepto", "cuenta_contable", "nif_cliente")


def critical_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, verdict) of the ten critical fields; a missing one is pendiente."""
    docs = fields.select("doc_id").distinct()
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, CRITICAL))).alias("field"))
    return wanted.join(fields, ["doc_id", "field"], "left").select("doc_id", "field", "value", "confidence", F.coalesce("verdict", F.lit("pendiente")).alias("verdict"))


def append_audit(records: DataFrame, path: str) -> None:
    """Appends audit records (book, ts and more) as JSON lines under book and UTC day."""
    _by_day(records.withColumn("fecha", F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd"))).write.mode("append").partitionBy("book", "fecha").json(path)


def _by_day(records: DataFrame) -> DataFrame:
    """Records brought together by book and day, so that a day is a file or a few, not one of each task; a day too large for one task is split."""
    return records.hint("rebalance", "book", "fecha")


class Appended(NamedTuple):
    """What became of audit records: how many were written, were there before, and were refused; the error if nothing could be written."""

    written: int
    known: int
    refused: int
    error: str | None = None


def audit(records: DataFrame, path: str, refused: str) -> Appended:
    """Appends audit records (key, book, ts text, payload text), each key once, and never fails the run that calls it.

    A record whose key, book or time is missing, or whose payload is no JSON,
    goes to the JSON lines in ``refused`` with the ``reason``; the others to
    ``path`` as :func:`append_audit` has them. What is in the same book and day
    already isn't written again, so that a run that starts anew adds what its
    first attempt lacks; of a key that comes twice the first payload in text
    order stays. An error of the store is logged and returned.
    """
    spark = records.sparkSession
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    time = F.try_to_timestamp("ts")
    reason = F.when(blank("key"), "key").when(blank("book"), "book").when(time.isNull(), "time").when(F.coalesce(F.try_parse_json("payload").isNull(), F.lit(True)), "payload")
    tagged = records.select("key", "book", "ts", "payload", reason.alias("reason"))
    try:
        day = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd")
        good = tagged.where("reason is null").withColumn("fecha", day).groupBy("key", "book", "fecha").agg(F.min(F.struct("payload", "ts")).alias("x")).select("key", "book", "fecha", "x.*")
        fields = "key string, payload string, ts string, book string, fecha string"
        there = spark.read.schema(fields).json(path) if _exists(spark, path) else spark.createDataFrame([], fields)
        known = there.select("key", "book", "fecha").distinct()
        total, old = good.join(known.withColumn("there", F.lit(True)), ["key", "book", "fecha"], "left").agg(F.count("*"), F.count("there")).first()
        _by_day(good.join(known, ["key", "book", "fecha"], "left_anti")).write.mode("append").partitionBy("book", "fecha").json(path)
        bad = tagged.where("reason is not null")
        bad.write.mode("append").json(refused)
        return Appended(total - old, old, bad.count())
    except (PySparkException, Py4JError) as error:
        logging.getLogger(__name__).error("audit records could not be written to %s: %s", path, error)
        return Appended(0, 0, 0, str(error).splitlines()[0])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_json(records: DataFrame, path: str) -> None:
    """Appends manifests and feedback as JSON lines."""
    records.write.mode("append").json(path)


#: The header lines of a ledger file and of a client's history.
LEDGER_HEADER = "cuenta;concepto;debe;haber;tipo_iva;base_imponible"
HISTORY = ("doc_id", "numero_factura", "libro", "fecha_operacion", "fecha_expedicion", "total_euros", "concepto", "cuenta_contable", "decision_global", "contraparte_nif", "contraparte_nombre")


def ledger_csv(lines: DataFrame) -> DataFrame:
    """(doc_id, csv): a document's ledger lines (line_index, cuenta, concepto, debe, haber, tipo_iva, base_imponible) as text; amounts with two decimals."""
    two = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)").cast("string")
    row = F.concat_ws(";", F.coalesce("cuenta", F.lit("")), F.coalesce("concepto", F.lit("")), two("debe"), two("haber"), F.coalesce(F.col("tipo_iva").cast("string"), F.lit("")), two("base_imponible"))
    body = F.sort_array(F.collect_list(F.struct("line_index", row.alias("row"))))  # one document's lines
    return lines.groupBy("doc_id").agg(F.concat(F.lit(LEDGER_HEADER + "\n"), F.array_join(F.transform(body, lambda x: x["row"]), "\n"), F.lit("\n")).alias("csv"))


def base64_csv(lines: DataFrame) -> DataFrame:
    """(doc_id, csv): :func:`ledger_csv` in base64."""
    return ledger_csv(lines).select("doc_id", F.base64(F.encode("csv", "UTF-8")).alias("csv"))


def final_records(documents: DataFrame, fields: DataFrame, csv: DataFrame) -> DataFrame:
    """(doc_id, libro, origen_decision, campos, n_edited, csv_filename, hash_csv) of confirmed documents (doc_id, libro, decision).

    fields (doc_id, field, value, edited) become one sorted array; csv is
    :func:`ledger_csv`. Without an assembled verdict nothing counts as edited.
    """
    each = fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("field", "value", "edited"))).alias("campos"))
    out = documents.join(each, "doc_id").join(csv, "doc_id")
    known = F.col("decision").isNotNull()
    fields_out = F.transform("campos", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), (x["edited"] & known).alias("edited")))
    return out.select(
        "doc_id", "libro", F.col("decision").alias("origen_decision"), fields_out.alias("campos"), F.size(F.filter(fields_out, lambda x: x["edited"])).cast("long").alias("n_edited"),
        F.concat(F.lit("asiento_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("csv_filename"), F.concat(F.lit("sha256:"), F.sha2("csv", 256)).alias("hash_csv"),
    )


def write_final(records: DataFrame, path: str) -> None:
    """Final records as compressed JSON lines: the names of fields make most of a record, and repeat."""
    records.write.option("compression", "gzip").json(path)


def split_manifests(splits: DataFrame) -> DataFrame:
    """(origen_pdf, origen_sha256, n_facturas, facturas) of splits (name, sha256, children)."""
    return splits.select(F.col("name").alias("origen_pdf"), F.col("sha256").alias("origen_sha256"), F.size("children").cast("long").alias("n_facturas"), F.col("children").alias("facturas"))


def history_rows(rows: DataFrame) -> DataFrame:
    """(nif, doc_id, row): a client's history as lines of text, in the columns of HISTORY; null is empty."""
    cells = [csv_cell_lf(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in HISTORY]
    return rows.select("nif", "doc_id", F.concat_ws(";", *cells).alias("row"))


def write_history(rows: DataFrame, path: str) -> None:
    """Histories as text under each client's id."""
    history_rows(rows).sortWithinPartitions("nif", "doc_id").select("nif", "row").write.mode("overwrite").partitionBy("nif").text(path)


def write_pending(new: DataFrame, path: str, into: str, merge: bool) -> None:
    """Writes the pending batch (doc_id, pos) to ``into``: the new ids, after those stored at ``path`` if ``merge``, none twice."""
    out = new.select("doc_id", "pos")
    if merge:
        old = read_pending(new.sparkSession, path)
        place = first_wins(old, new).select("doc_id", F.col("place.t").alias("t"), F.col("place.p").alias("p"))
        out = place.select("doc_id", (F.col("t") * F.lit(1 << 40) + F.col("p")).alias("pos"))
    out.write.mode("overwrite").parquet(into)


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos): the stored batch, in the order of pos."""
    return spark.read.schema("doc_id long, pos long").parquet(path)


def reset(status: DataFrame, path: str) -> DataFrame:
    """Writes the documents that aren't confirmed to ``path`` and returns the confirmed ones, which stay."""
    status.where(~F.col("confirmed")).write.mode("overwrite").json(path)
    return status.where("confirmed")
