"""From candidates of a field to its resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

AUTO, WARN = 0.90, 0.65
ARBITER_CAP = 0.89
ASK_BELOW = 0.80

#: Sources by priority; those not listed rank 9.
PRIORITY = {"document_ai_nativo": 0, "sistema": 0, "normalized_value": 1, "fase2_ocr": 2, "regex_contextual": 3, "bbox_proximidad": 4, "llm_arbitro": 5, "fallback": 6}

#: What a source's confidence is multiplied by.
DATE_PENALTY = {"invoice_date": 1.0, "delivery_date": 0.85, "receive_date": 0.70, "due_date": 0.70}
CHECKSUM_PENALTY = 0.3


def priority(source: Column) -> Column:
    out = F.lit(9)
    for name, k in PRIORITY.items():
        out = F.when(source == name, k).otherwise(out)
    return out


def viable() -> Column:
    """A value, and not found invalid; not examined passes."""
    return (F.coalesce("value", F.lit("")) != "") & F.coalesce("valid", F.lit(True))


def first_of_each_value(candidates: DataFrame) -> DataFrame:
    """The first candidate of every value of a document's field."""
    order = W.partitionBy("doc_id", "field", "value").orderBy("pos")
    return candidates.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def penalised(confidence: Column, source_date: Column, checksum_ok: Column) -> Column:
    """Confidence by the date's source and the checksum, in exact decimals."""
    factor = F.lit("1.0").cast("decimal(4,2)")
    for name, p in DATE_PENALTY.items():
        factor = F.when(source_date == name, F.lit(str(p)).cast("decimal(4,2)")).otherwise(factor)
    check = F.when(F.coalesce(checksum_ok, F.lit(True)), F.lit("1.0")).otherwise(F.lit(str(CHECKSUM_PENALTY))).cast("decimal(4,2)")
    return (confidence.cast("decimal(5,4)") * factor * check).cast("decimal(5,4)")


def field_verdict(confidence: Column, auto: float = AUTO, warn: float = WARN) -> Column:
    """auto, warn or block by thresholds; block without candidate."""
    d = lambda x: F.lit(str(x)).cast("decimal(5,4)")
    return F.when(confidence >= d(auto), "auto").when(confidence >= d(warn), "warn").otherwise("block")


def resolve(candidates: DataFrame, auto: float = AUTO, warn: float = WARN) -> DataFrame:
    """(doc_id, field, value, source, confidence, verdict, ask): the viable candidate of highest confidence, then priority, then place.

    ``ask`` says whether an arbiter is wanted: blocked, unsure, or several
    viable values. A struct's minimum takes the place of a sort: one shuffle,
    partial aggregates.
    """
    best = F.min(F.when(viable(), F.struct((-F.col("confidence")).alias("c"), priority(F.col("source")).alias("p"), "pos", "value", "source", "confidence")))
    many = F.count_distinct(F.when(viable(), F.col("value")))
    out = candidates.groupBy("doc_id", "field").agg(best.alias("b"), many.alias("values"))
    out = out.select("doc_id", "field", F.col("b.value").alias("value"), F.col("b.source").alias("source"), F.coalesce("b.confidence", F.lit(0).cast("decimal(5,4)")).alias("confidence"), "values")
    out = out.withColumn("verdict", F.when(F.col("value").isNull(), "block").otherwise(field_verdict(F.col("confidence"), auto, warn)))
    ask = (F.col("verdict") == "block") | (F.col("confidence") < F.lit(str(ASK_BELOW)).cast("decimal(5,4)")) | (F.col("values") > 1)
    return out.withColumn("ask", ask)


def arbitrated(resolved: DataFrame, answers: DataFrame) -> DataFrame:
    """Resolutions after an arbiter's answers (doc_id, field, answer, answer_valid, answer_confidence); none means not asked.

    A valid answer replaces the value, capped below auto: warn from the warn
    threshold on, else block.
    """
    capped = F.least(F.col("answer_confidence").cast("decimal(5,4)"), F.lit(str(ARBITER_CAP)).cast("decimal(5,4)"))
    taken = F.col("ask") & F.col("answer").isNotNull() & F.coalesce("answer_valid", F.lit(True))
    out = resolved.join(answers, ["doc_id", "field"], "left")
    return out.select(
        "doc_id", "field", F.when(taken, F.col("answer")).otherwise(F.col("value")).alias("value"), F.when(taken, F.lit("llm_arbitro")).otherwise(F.col("source")).alias("source"),
        F.when(taken, capped).otherwise(F.col("confidence")).alias("confidence"),
        F.when(taken & (capped >= F.lit(str(WARN)).cast("decimal(5,4)")), "warn").when(taken, "block").otherwise(F.col("verdict")).alias("verdict"), F.coalesce(taken, F.lit(False)).alias("arbitrated"),
    )


def swap_parties(wide: DataFrame, self_billed: Column, attributes=("nif", "name", "nif_confidence", "name_confidence")) -> DataFrame:
    """Issuer and receiver exchanged where ``self_billed``, if both ids are there; both verdicts are then warn at least."""
    go = F.coalesce(self_billed & F.col("issuer_nif").isNotNull() & F.col("receiver_nif").isNotNull(), F.lit(False))
    out = {"swapped": go}
    for a in attributes:
        out[f"issuer_{a}"] = F.when(go, F.col(f"receiver_{a}")).otherwise(F.col(f"issuer_{a}"))
        out[f"receiver_{a}"] = F.when(go, F.col(f"issuer_{a}")).otherwise(F.col(f"receiver_{a}"))
    least = lambda c: F.when(go & (c == "auto"), "warn").otherwise(c)
    out["issuer_verdict"] = least(F.when(go, F.col("receiver_verdict")).otherwise(F.col("issuer_verdict")))
    out["receiver_verdict"] = least(F.when(go, F.col("issuer_verdict")).otherwise(F.col("receiver_verdict")))
    return wide.withColumns(out)


def operation_date(issue_value: Column, issue_confidence: Column, issue_verdict: Column) -> Column:
    """The operation date as a copy of the issue date; pendiente without one."""
    return F.when(issue_value.isNotNull(), F.struct(issue_value.alias("value"), F.lit("derivado").alias("source"), issue_confidence.alias("confidence"), issue_verdict.alias("verdict"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"), issue_confidence.alias("confidence"), F.lit("pendiente").alias("verdict"))
    )
