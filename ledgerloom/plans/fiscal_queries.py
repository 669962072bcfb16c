"""Queries of the fiscal checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fiscal
from ..operators.verdicts import ASSEMBLING, CHECKING, worst
from .views import registry, view


def _safe(c: str) -> str:
    return f"(CASE WHEN trim({c}) NOT IN ('-','+','%','--','N/A','n/a','na','NA','') THEN abs(TRY_CAST(trim(regexp_replace(trim({c}), '^[+%-]', '')) AS DECIMAL(18,6))) END)"


#: Checked lines and documents in DuckDB.
CHECKED = f"""
parsed AS (SELECT *, CAST({_safe("base_raw")} AS DECIMAL(14,2)) AS base, CAST({_safe("rate_raw")} AS DECIMAL(6,2)) AS rate, CAST({_safe("tax_raw")} AS DECIMAL(14,2)) AS tax, CAST({_safe("total_raw")} AS DECIMAL(14,2)) AS line_total FROM tax_lines),
kinds AS (SELECT *, CASE WHEN rate_raw IS NULL THEN 'exenta' WHEN rate IS NULL THEN 'invalida' WHEN rate > 0 THEN 'gravada' ELSE 'tipo_cero' END AS kind FROM parsed),
again AS (SELECT *, CASE WHEN kind IN ('gravada','tipo_cero') AND base IS NOT NULL AND tax IS NOT NULL THEN CAST(round(base * rate * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) WHEN kind = 'tipo_cero' THEN CAST(0 AS DECIMAL(14,2)) END AS tax_again FROM kinds),
totals AS (SELECT *, CASE WHEN line_total IS NULL THEN NULL WHEN kind = 'exenta' THEN base WHEN kind <> 'invalida' THEN CAST(base + coalesce(tax_again, tax) AS DECIMAL(14,2)) END AS total_again FROM again),
ruled AS (SELECT *, CASE WHEN base IS NOT NULL THEN 'ok' WHEN base_raw IS NOT NULL THEN 'error' ELSE 'no_ejecutada' END AS f001, CASE WHEN kind = 'invalida' THEN 'error' ELSE 'ok' END AS f002,
  CASE WHEN tax IS NOT NULL THEN 'ok' WHEN tax_raw IS NOT NULL THEN 'error' ELSE 'no_ejecutada' END AS f003,
  CASE WHEN kind = 'invalida' THEN 'error' WHEN kind IN ('gravada','tipo_cero') AND base IS NOT NULL AND tax IS NOT NULL THEN CASE WHEN abs(tax - tax_again) <= 0.02 THEN 'ok' ELSE 'fail' END ELSE 'no_ejecutada' END AS f004,
  CASE WHEN line_total IS NULL THEN 'no_ejecutada' WHEN kind = 'invalida' THEN 'error' WHEN total_again IS NULL THEN 'no_ejecutada' WHEN abs(line_total - total_again) <= 0.02 THEN 'ok' ELSE 'fail' END AS f005 FROM totals),
checked AS (SELECT *, CASE WHEN kind = 'invalida' OR f001 IN ('fail','error') OR f002 IN ('fail','error') OR f003 IN ('fail','error') OR f004 IN ('fail','error') OR f005 IN ('fail','error') THEN 'block' WHEN kind = 'exenta' THEN 'warn' ELSE 'auto' END AS line_verdict,
  coalesce(least(base_confidence, rate_confidence, tax_confidence, total_confidence), 0) AS line_confidence FROM ruled),
summed AS (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN base IS NOT NULL THEN base + coalesce(tax_again, tax, 0) END) AS DECIMAL(18,2)) AS total_again, max(CASE line_verdict WHEN 'block' THEN 3 WHEN 'pendiente' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r, min(line_confidence) AS confidence,
  count(DISTINCT CASE WHEN kind IN ('gravada','tipo_cero') THEN rate END) AS rates, count_if(kind = 'gravada') AS n_gravada, count_if(kind = 'tipo_cero') AS n_tipo_cero, count_if(kind = 'exenta') AS n_exenta, count_if(kind = 'invalida') AS n_invalida FROM checked GROUP BY doc_id),
judged AS (SELECT d.doc_id, CAST({_safe("total_raw")} AS DECIMAL(18,2)) AS doc_total, s.* EXCLUDE (doc_id) FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id),
rules AS (SELECT *, CASE WHEN n > 0 THEN 'ok' ELSE 'fail' END AS f006, CASE WHEN doc_total IS NULL OR n IS NULL THEN 'no_ejecutada' WHEN abs(doc_total - coalesce(total_again, 0)) <= 0.02 THEN 'ok' ELSE 'fail' END AS f007 FROM judged),
verdicts AS (SELECT *, CASE WHEN n > 0 THEN ['auto','warn','pendiente','block'][r + 1] ELSE 'pendiente' END AS lines_verdict, CASE f007 WHEN 'fail' THEN 'block' WHEN 'ok' THEN 'auto' ELSE 'pendiente' END AS total_verdict FROM rules)
"""


def checked(spark, sf):
    return fiscal.check_lines(view(spark, sf, "tax_lines"))


def judged(spark, sf):
    return fiscal.check_documents(view(spark, sf, "docs").select("doc_id", "total_raw"), checked(spark, sf))


_WORSE = "CASE greatest(list_position(['auto','warn','pendiente','block'], total_verdict), list_position(['auto','warn','pendiente','block'], lines_verdict)) WHEN 1 THEN 'auto' WHEN 2 THEN 'warn' WHEN 3 THEN 'pendiente' ELSE 'block' END"


@registry.add("fiscal_documents", "SCL-08 AGG-01 AGG-02 AGG-05", f"WITH {CHECKED} SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS lines, doc_total AS total, total_again, confidence, f006, f007, 'ok' AS f008, lines_verdict, total_verdict, {_WORSE} AS verdict FROM verdicts", ("docs", "tax_lines"))
def fiscal_documents(spark, sf):
    return judged(spark, sf).select("doc_id", "lines", "total", "total_again", "confidence", "f006", "f007", "f008", "lines_verdict", "total_verdict", "verdict")


@registry.add("fiscal_line_rules", "SCL-01 SCL-03 SCL-04 SCL-05 SCL-06 SCL-07", f"WITH {CHECKED} SELECT doc_id, line_index, kind, base, rate, tax, line_total, tax_again, total_again, f001, f002, f003, f004, f005, line_verdict, line_confidence FROM checked", ("docs", "tax_lines"))
def fiscal_line_rules(spark, sf):
    return checked(spark, sf).select("doc_id", "line_index", "kind", "base", "rate", "tax", "line_total", "tax_again", "total_again", "f001", "f002", "f003", "f004", "f005", "line_verdict", "line_confidence")


@registry.add("agg03_line_classes", "AGG-03 AGG-04", f"WITH {CHECKED} SELECT doc_id, coalesce(n_gravada, 0) AS n_gravada, coalesce(n_tipo_cero, 0) AS n_tipo_cero, coalesce(n_exenta, 0) AS n_exenta, coalesce(n_invalida, 0) AS n_invalida, coalesce(rates, 0) AS rates FROM verdicts", ("docs", "tax_lines"))
def agg03_line_classes(spark, sf):
    return judged(spark, sf).select("doc_id", "n_gravada", "n_tipo_cero", "n_exenta", "n_invalida", "rates")


@registry.add("agg16_sum_check", "AGG-16", f"WITH {CHECKED}, s AS (SELECT doc_id, CAST(sum(CASE WHEN base IS NOT NULL AND tax IS NOT NULL THEN base + tax END) AS DECIMAL(18,2)) AS summed FROM checked GROUP BY doc_id) SELECT d.doc_id, (total IS NULL OR total = 0 OR summed IS NULL OR abs(total - summed) <= 0.02) AS sum_ok FROM docs d LEFT JOIN s ON d.doc_id = s.doc_id", ("docs", "tax_lines"))
def agg16_sum_check(spark, sf):
    return fiscal.sum_check(checked(spark, sf), view(spark, sf, "docs"))


@registry.add("agg17_reasons", "AGG-17", f"WITH {CHECKED} SELECT doc_id, string_agg('línea ' || line_index || ': ' || kind || ' → ' || line_verdict, '; ' ORDER BY line_index) AS reason FROM checked GROUP BY doc_id", ("docs", "tax_lines"))
def agg17_reasons(spark, sf):
    return fiscal.reasons(checked(spark, sf))



@registry.add("scl09_rate_corrector", "SCL-09 WIN-11", f"""
    WITH odd AS (SELECT doc_id, line_index, CASE WHEN line_index % 2 = 0 AND rate_raw IS NOT NULL THEN '17' ELSE rate_raw END AS rate_raw, base_raw, tax_raw, rate_confidence FROM tax_lines),
    p AS (SELECT *, {_safe("base_raw")} AS b, {_safe("rate_raw")} AS r, {_safe("tax_raw")} AS t FROM odd),
    q AS (SELECT *, CASE WHEN b <> 0 THEN round(CAST(CAST(t AS DOUBLE) * 100 / CAST(b AS DOUBLE) AS DECIMAL(20,6)), 2) END AS d FROM p),
    f AS (SELECT *, CASE WHEN r > 0 AND r NOT IN (0, 4, 10, 21) AND d IS NOT NULL THEN CASE WHEN abs(d - 4) <= 1 THEN '4.00' WHEN abs(d - 10) <= 1 THEN '10.00' WHEN abs(d - 21) <= 1 THEN '21.00' END END AS fix FROM q)
    SELECT doc_id, line_index, fix IS NOT NULL AS corrected, coalesce(fix, rate_raw) AS rate_raw, CASE WHEN fix IS NOT NULL THEN CAST(0.5 AS DECIMAL(5,4)) ELSE rate_confidence END AS rate_confidence FROM f""", ("tax_lines",))  # fmt: skip
def scl09_rate_corrector(spark, sf):
    lines = view(spark, sf, "tax_lines").withColumn("rate_raw", F.when((F.col("line_index") % 2 == 0) & F.col("rate_raw").isNotNull(), "17").otherwise(F.col("rate_raw")))
    return fiscal.correct_rates(lines).select("doc_id", "line_index", "corrected", "rate_raw", "rate_confidence")


@registry.add("agg01_worst_both_orders", "AGG-01 AGG-12", """
    SELECT book, CASE max(CASE v WHEN 'block' THEN 3 WHEN 'pendiente' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 3 THEN 'block' WHEN 2 THEN 'pendiente' WHEN 1 THEN 'warn' ELSE 'auto' END AS checking,
      CASE max(CASE v WHEN 'block' THEN 3 WHEN 'warn' THEN 2 WHEN 'pendiente' THEN 1 ELSE 0 END) WHEN 3 THEN 'block' WHEN 2 THEN 'warn' WHEN 1 THEN 'pendiente' ELSE 'auto' END AS assembling
    FROM (SELECT book, CASE WHEN book = 'ventas' THEN CASE WHEN doc_id % 2 = 0 THEN 'warn' ELSE 'pendiente' END ELSE issuer_verdict END AS v FROM docs) GROUP BY book""", ("docs",))  # fmt: skip
def agg01_worst_both_orders(spark, sf):
    v = F.when(F.col("book") == "ventas", F.when(F.col("doc_id") % 2 == 0, "warn").otherwise("pendiente")).otherwise(F.col("issuer_verdict"))
    return view(spark, sf, "docs").withColumn("v", v).groupBy("book").agg(worst(F.col("v"), CHECKING).alias("checking"), worst(F.col("v"), ASSEMBLING).alias("assembling"))
