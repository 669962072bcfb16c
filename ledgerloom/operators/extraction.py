"""The extracted document: recognised answers, or a minimal record where there is none."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.readers import cell_confidence

#: A recognised answer in JSON. Amounts are decimals.
ANSWER = (
    "struct<nif_entidad:string,nombre_entidad:string,numero_factura:string,fecha_expedicion:string,nif_receptor:string,nombre_receptor:string,total_factura:decimal(18,2),"
    "lineas_fiscales:array<struct<base_euros:decimal(18,2),tipo_porcentaje:decimal(6,2),cuota:decimal(18,2),total_linea:decimal(18,2)>>>"
)

#: The names in an answer; without any of them it says nothing.
FIELDS = re.findall(r"[<,](\w+):(?:string|decimal|array)", re.sub(r"array<struct<.*>>", "array", ANSWER))

#: Confidences of a cell that is there, of a total that doesn't fit its lines, and of a rescued number.
PRESENT, DOUBTFUL, RESCUED = 0.95, 0.5, 0.5
TOLERANCE = "0.02"

#: Fixed value: what an invoice number looks like in plain text.
NUMBER = r"\b[A-Z]{0,3}[-/]?\d{4}[-/]\d{2,6}\b"


def _cell(value: Column, confidence: Column) -> Column:
    return F.struct(value.alias("valor"), confidence.cast("double").alias("confianza"))


def _text_cell(value: Column) -> Column:
    return _cell(value, cell_confidence(value))


def sum_fits(lines: Column, total: Column) -> Column:
    """Base plus tax of the lines that have both agrees with the total; without lines, total or amounts it isn't held against them."""
    zero = F.lit(0).cast("decimal(18,2)")
    summed = F.aggregate(lines, zero, lambda s, x: (s + F.coalesce(x["base_euros"] + x["cuota"], zero)).cast("decimal(18,2)"))
    return F.coalesce((summed == 0) | (F.abs(summed - total) <= F.lit(TOLERANCE).cast("decimal(18,2)")), F.lit(True))


def _line(x: Column) -> Column:
    sure = F.when(x["base_euros"].isNotNull() & x["tipo_porcentaje"].isNotNull(), PRESENT).otherwise(0.0)
    if_there = lambda c: _cell(x[c], F.when(x[c].isNotNull(), sure).otherwise(0.0))
    return F.struct(_cell(x["base_euros"], sure).alias("base_euros"), _cell(x["tipo_porcentaje"], sure).alias("tipo_porcentaje"), if_there("cuota").alias("cuota"), if_there("total_linea").alias("total_linea"))


def extracted(files: DataFrame, engine: str = "external") -> DataFrame:
    """One document per row of files (doc_id, archivo, paginas, carpeta, answer JSON, text).

    A cell's confidence follows from its presence, a line's from base and rate,
    the total's from whether the lines add up to it; the operation date is the
    issue date. Without an answer that can be read, the document is empty but
    for a number rescued from the text, wants review and says why.
    """
    answer = files.withColumn("a", F.from_json("answer", ANSWER))
    ok, a = F.coalesce(reduce(or_, (F.col(f"a.{c}").isNotNull() for c in FIELDS)), F.lit(False)), lambda c: F.when(F.col("ok"), F.col(f"a.{c}"))
    rescued = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), NUMBER, 0), F.lit(""))
    lines = F.coalesce(a("lineas_fiscales"), F.array().cast("array<struct<base_euros:decimal(18,2),tipo_porcentaje:decimal(6,2),cuota:decimal(18,2),total_linea:decimal(18,2)>>"))
    fits = sum_fits(lines, a("total_factura"))
    number = F.when(F.col("ok"), _text_cell(a("numero_factura"))).otherwise(_cell(rescued, F.when(rescued.isNotNull(), RESCUED).otherwise(0.0)))
    total = _cell(a("total_factura"), F.when(~F.col("ok"), 0.0).when(fits, PRESENT).otherwise(DOUBTFUL))
    return answer.withColumn("ok", ok).select(
        "doc_id",
        F.struct(F.col("archivo"), F.when(F.col("ok"), F.col("paginas")).alias("pagina_count"), F.lit(engine).alias("ocr_engine"), F.col("carpeta").alias("carpeta_entrada")).alias("origen"),
        F.struct(
            *(_text_cell(a(source)).alias(name) for name, source in (("nif_entidad", "nif_entidad"), ("nombre_entidad", "nombre_entidad"), ("fecha_expedicion", "fecha_expedicion"), ("fecha_operacion", "fecha_expedicion"))),
            number.alias("numero_factura"),
        ).alias("identificacion"),
        F.struct(*(_text_cell(a(c)).alias(c) for c in ("nif_receptor", "nombre_receptor"))).alias("cliente_destino"),
        F.struct(total.alias("total_euros"), F.transform(lines, _line).alias("lineas_fiscales")).alias("fiscal"),
        (~F.col("ok") | ~fits).alias("requiere_revision"), F.when(~F.col("ok"), "no_answer").alias("error_extraccion"),
    )
