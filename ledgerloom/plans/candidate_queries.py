"""Queries of candidates, resolutions and semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import concept_key
from ..operators import candidates, semantic
from .views import registry, view

C = ("candidates",)
PRIO = "CASE source WHEN 'document_ai_nativo' THEN 0 WHEN 'sistema' THEN 0 WHEN 'normalized_value' THEN 1 WHEN 'fase2_ocr' THEN 2 WHEN 'regex_contextual' THEN 3 WHEN 'bbox_proximidad' THEN 4 WHEN 'llm_arbitro' THEN 5 WHEN 'fallback' THEN 6 ELSE 9 END"
VIABLE = "(coalesce(value, '') <> '' AND coalesce(valid, true))"
BEST = f"""best AS (SELECT doc_id, field, value, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, {PRIO}, pos) AS rn FROM candidates WHERE {VIABLE}) WHERE rn = 1),
 groups AS (SELECT doc_id, field, count(DISTINCT CASE WHEN {VIABLE} THEN value END) AS vals FROM candidates GROUP BY doc_id, field),
 resolved AS (SELECT g.doc_id, g.field, value, source, coalesce(confidence, 0) AS confidence, vals, CASE WHEN value IS NULL THEN 'block' WHEN confidence >= 0.9 THEN 'auto' WHEN confidence >= 0.65 THEN 'warn' ELSE 'block' END AS verdict FROM groups g LEFT JOIN best b ON g.doc_id = b.doc_id AND g.field = b.field)"""


@registry.add("win04_resolved_fields", "WIN-04 FLT-08 SCL-19 SCL-20 SRT-05", f"WITH {BEST} SELECT doc_id, field, value, source, confidence, verdict, verdict = 'block' OR confidence < 0.8 OR vals > 1 AS ask FROM resolved", C)
def win04_resolved_fields(spark, sf):
    return candidates.resolve(view(spark, sf, "candidates")).drop("values")


@registry.add("win12_first_of_each_value", "WIN-12 FLT-13", "SELECT doc_id, field, value, pos, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field, value ORDER BY pos) AS rn FROM candidates WHERE length(value) >= 2 AND upper(value) NOT IN ('V3','V4')) WHERE rn = 1", C)
def win12_first_of_each_value(spark, sf):
    rows = view(spark, sf, "candidates").where((F.length("value") >= 2) & ~F.upper("value").isin("V3", "V4"))
    return candidates.first_of_each_value(rows).select("doc_id", "field", "value", "pos", "source")


@registry.add("scl18_confidence_rules", "SCL-18", "SELECT pos, CAST(CAST(confidence * CAST(CASE source_date WHEN 'delivery_date' THEN 0.85 WHEN 'receive_date' THEN 0.70 ELSE 1.0 END AS DECIMAL(4,2)) * CAST(CASE WHEN coalesce(valid, true) THEN 1.0 ELSE 0.3 END AS DECIMAL(4,2)) AS DECIMAL(12,8)) AS DECIMAL(5,4)) AS confidence FROM candidates", C)
def scl18_confidence_rules(spark, sf):
    rows = view(spark, sf, "candidates")
    return rows.select("pos", candidates.penalised(F.col("confidence"), F.col("source_date"), F.col("valid")).alias("confidence"))


@registry.add("scl21_arbitrated", "SCL-21", f"""WITH {BEST}, a AS (SELECT *, verdict = 'block' OR confidence < 0.8 OR vals > 1 AS ask FROM resolved),
    n AS (SELECT doc_id, field, CASE WHEN doc_id % 4 <> 1 THEN 'arb' END AS answer, doc_id % 3 <> 0 AS answer_valid, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.97 ELSE 0.5 END AS DECIMAL(5,4)) AS answer_confidence FROM resolved),
    t AS (SELECT a.*, answer, answer_confidence, coalesce(ask AND answer IS NOT NULL AND coalesce(answer_valid, true), false) AS taken FROM a LEFT JOIN n ON a.doc_id = n.doc_id AND a.field = n.field)
    SELECT doc_id, field, CASE WHEN taken THEN answer ELSE value END AS value, CASE WHEN taken THEN 'llm_arbitro' ELSE source END AS source, CASE WHEN taken THEN least(answer_confidence, 0.89) ELSE confidence END AS confidence,
    CASE WHEN taken AND least(answer_confidence, 0.89) >= 0.65 THEN 'warn' WHEN taken THEN 'block' ELSE verdict END AS verdict, taken AS arbitrated FROM t""", C)  # fmt: skip
def scl21_arbitrated(spark, sf):
    resolved = candidates.resolve(view(spark, sf, "candidates"))
    answers = resolved.select("doc_id", "field", F.when(F.col("doc_id") % 4 != 1, "arb").alias("answer"), (F.col("doc_id") % 3 != 0).alias("answer_valid"), F.when(F.col("doc_id") % 2 == 0, 0.97).otherwise(0.5).cast("decimal(5,4)").alias("answer_confidence"))
    return candidates.arbitrated(resolved, answers)


@registry.add("scl22_operation_date", "SCL-22", "SELECT doc_id, d AS value, CASE WHEN d IS NOT NULL THEN 'derivado' END AS source, CASE WHEN d IS NULL THEN 'pendiente' ELSE issuer_verdict END AS verdict FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE date END AS d FROM docs)", ("docs",))
def scl22_operation_date(spark, sf):
    d = F.when(F.col("doc_id") % 7 != 0, F.col("date"))
    return view(spark, sf, "docs").select("doc_id", candidates.operation_date(d, F.lit(0.5), F.col("issuer_verdict")).alias("x")).select("doc_id", "x.value", "x.source", "x.verdict")


@registry.add("scl25_swapped_parties", "SCL-23 SCL-24 SCL-25", """
    SELECT doc_id, go AS swapped, CASE WHEN go THEN receiver_nif ELSE issuer_nif END AS issuer_nif, CASE WHEN go THEN issuer_nif ELSE receiver_nif END AS receiver_nif, CASE WHEN go THEN receiver_name ELSE issuer_name END AS issuer_name, CASE WHEN go THEN issuer_name ELSE receiver_name END AS receiver_name,
      CASE WHEN go AND receiver_verdict = 'auto' THEN 'warn' WHEN go THEN receiver_verdict ELSE issuer_verdict END AS issuer_verdict, CASE WHEN go AND issuer_verdict = 'auto' THEN 'warn' WHEN go THEN issuer_verdict ELSE receiver_verdict END AS receiver_verdict
    FROM (SELECT *, (doc_id % 5 = 0 OR doc_id % 5 = 1) AND issuer_nif IS NOT NULL AND receiver_nif IS NOT NULL AS go FROM docs)""", ("docs",))  # fmt: skip
def scl25_swapped_parties(spark, sf):
    from ..functions.texts import has_marker

    words = F.when(F.col("doc_id") % 5 == 0, "Auto  Facturación del\tmes").when(F.col("doc_id") % 5 == 1, "AUTO FACTURACION").otherwise("factura")
    rows = view(spark, sf, "docs").withColumn("self", has_marker(words, ["auto facturación"]))
    return candidates.swap_parties(rows, F.col("self"), ("nif", "name")).select("doc_id", "swapped", "issuer_nif", "receiver_nif", "issuer_name", "receiver_name", "issuer_verdict", "receiver_verdict")


# semantics

_CHART = ", ".join(f"('{c}', {'NULL' if a is None else repr(a)}, {str(r).lower()}, {k})" for k, (c, a, r) in enumerate(semantic.CHART))
CHART = f"chart(concept, account, review, pos) AS (VALUES {_CHART})"
_WL = " ".join(f"WHEN '{b}' THEN account IN ({', '.join(map(repr, c))}) OR split_part(account, '.', 1) IN ({', '.join(map(repr, c))})" for b, c in semantic.WHITELIST.items())
GROUP = "CASE substr(account, 1, 1) WHEN '6' THEN 'compras' WHEN '7' THEN 'ventas' WHEN '2' THEN 'bienes' END"


def chart(spark):
    """The chart of accounts as a table."""
    return spark.createDataFrame([(c, a, r, k) for k, (c, a, r) in enumerate(semantic.CHART)], "concept string, account string, review boolean, pos int")


@registry.add("join17_admitted_accounts", "JOIN-17 SRC-09 SCL-28 SCL-45 FLT-05", f"SELECT doc_id, CASE WHEN coalesce(account, '') = '' THEN false ELSE CASE book {_WL} ELSE true END END AS admitted, coalesce({GROUP} = book, true) AS coherent, {GROUP} AS book_of_account FROM docs", ("docs",))
def join17_admitted_accounts(spark, sf):
    a, b = F.col("account"), F.col("book")
    return view(spark, sf, "docs").select("doc_id", semantic.admitted(a, b).alias("admitted"), semantic.coherent(a, b).alias("coherent"), semantic.book_of_group(a).alias("book_of_account"))


_SUP = "(SELECT upper(trim(nif)) AS nif, account, concept, coalesce(confidence, 0.9) AS confidence, pos FROM suppliers WHERE trim(nif) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(nif)) ORDER BY pos DESC) = 1)"


@registry.add("join02_known_suppliers", "JOIN-02 SRC-08", f"SELECT doc_id, s.concept AS supplier_concept, s.account AS supplier_account, s.confidence AS supplier_confidence FROM docs d LEFT JOIN (SELECT * FROM {_SUP} WHERE account <> '') s ON upper(trim(d.issuer_nif)) = s.nif", ("docs", "suppliers"))
def join02_known_suppliers(spark, sf):
    return semantic.known_supplier(view(spark, sf, "docs"), view(spark, sf, "suppliers")).select("doc_id", "supplier_concept", "supplier_account", "supplier_confidence")


@registry.add("src08_suppliers_by_id", "SRC-08 SRC-07", f"SELECT nif, account, confidence, pos FROM {_SUP}", ("suppliers",))
def src08_suppliers_by_id(spark, sf):
    return semantic.suppliers_by_id(view(spark, sf, "suppliers")).select("nif", "account", "confidence", "pos")


@registry.add("join16_consistent_concepts", "JOIN-16 SRC-12 SCL-27", f"""WITH {CHART}, k AS (SELECT doc_id, account, nullif(regexp_replace(trim(lower(regexp_replace(translate(trim(concept), ' -', '__'), '[^a-zA-Z_]', '', 'g')), '_'), '_+', '_', 'g'), '') AS key FROM docs),
    inv AS (SELECT account, arg_max(concept, pos) AS derived FROM chart WHERE account IS NOT NULL GROUP BY account)
    SELECT doc_id, k.account, coalesce(c.concept, derived) AS concept FROM k LEFT JOIN (SELECT DISTINCT concept FROM chart) c ON key = c.concept LEFT JOIN inv ON k.account = inv.account""", ("docs",))  # fmt: skip
def join16_consistent_concepts(spark, sf):
    rows = view(spark, sf, "docs").select("doc_id", "account", concept_key(F.col("concept")).alias("concept"))
    return semantic.consistent_concept(rows, chart(spark)).select("doc_id", "account", "concept")


@registry.add("win05_best_pairs", "WIN-05 SCL-26", """
    WITH c AS (SELECT doc_id, pos, 'c' || cast(pos % 4 as varchar) AS concept, '6' || cast(pos % 7 as varchar) AS account, confidence FROM candidates),
    f AS (SELECT *, first(concept) OVER w AS chosen, first(confidence) OVER w AS cc FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY confidence DESC, pos))
    SELECT doc_id, chosen AS concept, cc AS concept_confidence, account, confidence AS account_confidence FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (concept IS DISTINCT FROM chosen), confidence DESC, pos) = 1""", C)  # fmt: skip
def win05_best_pairs(spark, sf):
    rows = view(spark, sf, "candidates").select("doc_id", "pos", F.concat(F.lit("c"), (F.col("pos") % 4).cast("string")).alias("concept"), F.concat(F.lit("6"), (F.col("pos") % 7).cast("string")).alias("account"), "confidence")
    return semantic.best_pair(rows)


@registry.add("scl30_pair_verdicts", "SCL-29 SCL-30 SRC-11", f"""WITH {CHART}, p AS (SELECT doc_id, book, d.account, CAST(((doc_id * 7) % 100) * 0.01 AS DECIMAL(5,4)) AS c, d.concept, coalesce(review, false) AS review FROM docs d LEFT JOIN (SELECT concept AS k, max(review) AS review FROM chart GROUP BY concept) ON d.concept = k),
    v AS (SELECT *, CASE WHEN c >= 0.95 AND NOT review THEN 'auto' ELSE 'warn' END AS cv, CASE WHEN account IS NOT NULL AND NOT (CASE book {_WL} ELSE true END) THEN 'block' WHEN c >= 0.95 THEN 'auto' ELSE 'warn' END AS av FROM p),
    w AS (SELECT *, CASE WHEN NOT coalesce({GROUP} = book, true) AND av = 'auto' THEN 'warn' ELSE av END AS av2 FROM v)
    SELECT doc_id, CASE WHEN book = 'bienes' AND cv = 'auto' THEN 'warn' ELSE cv END AS concept_verdict, CASE WHEN book = 'bienes' AND av2 = 'auto' THEN 'warn' ELSE av2 END AS account_verdict,
      CASE WHEN av2 = 'block' THEN 'block' WHEN cv = 'warn' OR av2 = 'warn' OR book = 'bienes' THEN 'warn' ELSE 'auto' END AS verdict FROM w""", ("docs",))  # fmt: skip
def scl30_pair_verdicts(spark, sf):
    flags = chart(spark).groupBy(F.col("concept").alias("k")).agg(F.max("review").alias("review"))
    rows = view(spark, sf, "docs").join(flags, F.col("concept") == F.col("k"), "left")
    c = ((F.col("doc_id") * 7) % 100 * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(5,4)")
    rows = rows.withColumns({"concept_confidence": c, "account_confidence": c})
    return semantic.pair_verdicts(rows, F.col("review")).select("doc_id", "concept_verdict", "account_verdict", "verdict")
