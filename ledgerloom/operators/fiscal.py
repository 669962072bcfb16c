"""Arithmetic checks of tax lines and documents, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import nearest, safe_decimal
from .verdicts import named, rank, worse, worst

TOLERANCE = "0.02"
LEGAL_RATES = (0, 4, 10, 21)
RATE_WITHIN = 1.0
CORRECTED_CONFIDENCE = 0.5


def _money(c: Column) -> Column:
    return c.cast("decimal(14,2)")


def _state(ok: Column, tolerance: str = TOLERANCE) -> Column:
    return F.when(ok <= F.lit(tolerance).cast("decimal(14,2)"), "ok").otherwise("fail")


def _present(value: str, raw: str) -> Column:
    return F.when(F.col(value).isNotNull(), "ok").when(F.col(raw).isNotNull(), "error").otherwise("no_ejecutada")


def correct_rates(lines: DataFrame, legal=LEGAL_RATES, within: float = RATE_WITHIN) -> DataFrame:
    """Replaces an illegal rate by the legal one that tax / base comes near to; adds ``corrected``.

    Rewrites ``rate_raw`` and ``rate_confidence`` before validation. Exempt,
    unparseable and zero rates stay, as do lines without base or tax.
    """
    base, rate, tax = (safe_decimal(F.col(c)) for c in ("base_raw", "rate_raw", "tax_raw"))
    derived = F.round((tax.cast("decimal(14,4)") * 100 / F.nullif(base.cast("decimal(14,4)"), F.lit(0).cast("decimal(14,4)"))).cast("decimal(20,6)"), 2)
    legal_rate = nearest(derived.cast("decimal(18,6)"), [r for r in legal if r > 0], within)
    fix = F.when((rate > 0) & ~rate.isin([float(r) for r in legal]), legal_rate)
    out = lines.withColumn("corrected_rate", fix)
    return out.withColumns({
        "corrected": F.col("corrected_rate").isNotNull(),
        "rate_raw": F.coalesce(F.col("corrected_rate").cast("decimal(6,2)").cast("string"), "rate_raw"),
        "rate_confidence": F.when(F.col("corrected_rate").isNotNull(), F.lit(CORRECTED_CONFIDENCE)).otherwise(F.col("rate_confidence")).cast("decimal(5,4)"),
    }).drop("corrected_rate")


def check_lines(lines: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Adds class, parsed values, rules f001 to f005, recomputed tax and total, least confidence and verdict of each line.

    Needs base_raw, rate_raw, tax_raw, total_raw (text) and the four
    confidences. A line without tax isn't computed, and its verdict is auto.
    """
    out = lines.withColumns({
        "base": _money(safe_decimal(F.col("base_raw"))), "rate": safe_decimal(F.col("rate_raw")).cast("decimal(6,2)"),
        "tax": _money(safe_decimal(F.col("tax_raw"))), "line_total": _money(safe_decimal(F.col("total_raw"))),
    })
    kind = F.when(F.col("rate_raw").isNull(), "exenta").when(F.col("rate").isNull(), "invalida").when(F.col("rate") > 0, "gravada").otherwise("tipo_cero")
    out = out.withColumn("kind", kind)
    counted = ~F.col("kind").isin("exenta", "invalida")
    known = counted & F.col("base").isNotNull() & F.col("tax").isNotNull()
    product = F.round(F.col("base") * F.col("rate") * F.lit("0.01").cast("decimal(3,2)"), 2).cast("decimal(14,2)")
    out = out.withColumn("tax_again", F.when(known, product).when(F.col("kind") == "tipo_cero", F.lit(0).cast("decimal(14,2)")))
    again = F.when(F.col("kind") == "exenta", F.col("base")).when(counted, (F.col("base") + F.coalesce("tax_again", "tax")).cast("decimal(14,2)"))
    out = out.withColumn("total_again", F.when(F.col("line_total").isNotNull(), again))
    out = out.withColumns({
        "f001": _present("base", "base_raw"),
        "f002": F.when(F.col("kind") == "invalida", "error").otherwise("ok"),
        "f003": _present("tax", "tax_raw"),
        "f004": F.when(F.col("kind") == "invalida", "error").when(known, _state(F.abs(F.col("tax") - F.col("tax_again")), tolerance)).otherwise("no_ejecutada"),
        "f005": F.when(F.col("line_total").isNull(), "no_ejecutada").when(F.col("kind") == "invalida", "error").when(F.col("total_again").isNull(), "no_ejecutada").otherwise(_state(F.abs(F.col("line_total") - F.col("total_again")), tolerance)),
    })
    bad = F.lit(False)
    for rule in ("f001", "f002", "f003", "f004", "f005"):
        bad = bad | F.col(rule).isin("fail", "error")
    verdict = F.when((F.col("kind") == "invalida") | bad, "block").when(F.col("kind") == "exenta", "warn").otherwise("auto")
    least = F.coalesce(F.least("base_confidence", "rate_confidence", "tax_confidence", "total_confidence"), F.lit(0).cast("decimal(5,4)"))
    return out.withColumns({"line_verdict": verdict, "line_confidence": least})


def check_documents(documents: DataFrame, lines: DataFrame, key: str = "doc_id", tolerance: str = TOLERANCE) -> DataFrame:
    """One row per document: line counts by class, recomputed total, rules f006 to f008 and verdicts.

    ``documents`` has the key and total_raw; ``lines`` are checked lines. One
    shuffle on the key, with partial sums; documents without lines stay.
    """
    part = F.when(F.col("base").isNotNull(), F.col("base") + F.coalesce("tax_again", "tax", F.lit(0).cast("decimal(14,2)")))
    kinds = ("gravada", "tipo_cero", "exenta", "invalida")
    # a document's few rates as a set: counting them distinct beside other sums would copy every line
    rates = F.size(F.collect_set(F.when(F.col("kind").isin("gravada", "tipo_cero"), F.col("rate")))).cast("long").alias("rates")
    summed = lines.groupBy(key).agg(
        F.count("*").alias("lines"), F.sum(part).cast("decimal(18,2)").alias("total_again"), F.max(rank(F.col("line_verdict"))).alias("line_rank"), F.min("line_confidence").alias("confidence"),
        rates, *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds),
    )
    out = documents.withColumn("total", safe_decimal(F.col("total_raw")).cast("decimal(18,2)")).join(summed, key, "left")
    some = F.col("lines") > 0
    out = out.withColumn("lines", F.coalesce("lines", F.lit(0)))
    out = out.withColumns({
        "f006": F.when(F.col("lines") > 0, "ok").otherwise("fail"),
        "f007": F.when(F.col("total").isNotNull() & some, _state(F.abs(F.col("total") - F.coalesce("total_again", F.lit(0))), tolerance)).otherwise("no_ejecutada"),
        "f008": F.lit("ok"),
    })
    lines_verdict = F.when(F.col("lines") > 0, named(F.col("line_rank"))).otherwise("pendiente")
    total_verdict = F.when(F.col("f007") == "fail", "block").when(F.col("f007") == "ok", "auto").otherwise("pendiente")
    out = out.withColumns({"lines_verdict": lines_verdict, "total_verdict": total_verdict})
    out = out.withColumn("verdict", worse(F.col("total_verdict"), F.col("lines_verdict")))
    counts = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in kinds} | {"rates": F.coalesce("rates", F.lit(0))}
    return out.withColumns(counts).drop("line_rank")


def sum_check(lines: DataFrame, documents: DataFrame, key: str = "doc_id", tolerance: str = TOLERANCE) -> DataFrame:
    """(key, sum_ok): base plus tax of the lines that have both agrees with the total; no lines, total or zero passes."""
    both = F.col("base").isNotNull() & F.col("tax").isNotNull()
    total = lines.groupBy(key).agg(F.sum(F.when(both, F.col("base") + F.col("tax"))).cast("decimal(18,2)").alias("summed"))
    out = documents.join(total, key, "left")
    skip = F.col("total").isNull() | (F.col("total") == 0) | F.col("summed").isNull()
    return out.select(key, (skip | (F.abs(F.col("total") - F.col("summed")) <= F.lit(tolerance).cast("decimal(14,2)"))).alias("sum_ok"))


def reasons(lines: DataFrame, key: str = "doc_id", index: str = "line_index") -> DataFrame:
    """(key, reason): every line's class and verdict, in order, joined by '; '. A group is one document's lines."""
    each = F.concat(F.lit("línea "), F.col(index).cast("string"), F.lit(": "), F.col("kind"), F.lit(" → "), F.col("line_verdict"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(index), each.alias("text"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("reason"))


def worst_of(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, verdict): the worst line verdict."""
    return lines.groupBy(key).agg(worst(F.col("line_verdict")).alias("verdict"))
