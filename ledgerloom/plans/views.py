"""Domain tables made of the driver's tables: the adapter that queries run the operators on.

Each view is one SELECT that Spark SQL and DuckDB read alike, so that a query
and its oracle start from the same rows. Operators know nothing of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def nif(key: str) -> str:
    """A person's tax id for a key; every seventh has a wrong letter."""
    return f"(lpad(cast({key} as string), 8, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(({key} + case when {key} % 7 = 0 then 1 else 0 end) % 23 as int) + 1, 1))"


def cif(key: str) -> str:
    """A company's tax id for a key; every fifth has a wrong digit."""
    digit = lambda k: f"cast(substr(lpad(cast({key} as string), 7, '0'), {k}, 1) as int)"
    odd = " + ".join(f"(case when {digit(k)} * 2 > 9 then {digit(k)} * 2 - 9 else {digit(k)} * 2 end)" for k in (1, 3, 5, 7))
    even = " + ".join(digit(k) for k in (2, 4, 6))
    return f"('B' || lpad(cast({key} as string), 7, '0') || cast(((10 - ({odd} + {even}) % 10) % 10 + case when {key} % 5 = 0 then 1 else 0 end) % 10 as string))"


VIEWS = {
    "docs": f"""
        SELECT doc_id, book, total_raw, cast(total as decimal(18,2)) AS total, day AS date, 'F-' || lpad(cast(doc_id as string), 6, '0') AS number,
          case when book = 'ventas' then c_nif else s_nif end AS issuer_nif, case when book = 'ventas' then s_nif else c_nif end AS receiver_nif,
          case when book = 'ventas' then c_name else s_name end AS issuer_name, case when book = 'ventas' then s_name else c_name end AS receiver_name,
          case when doc_id % 10 = 0 then 'block' when doc_id % 10 < 4 then 'warn' else 'auto' end AS issuer_verdict, case when doc_id % 13 = 0 then 'block' else 'auto' end AS receiver_verdict,
          case when doc_id % 9 = 0 then null else case when book = 'ventas' then '705.01' when book = 'bienes' then '213' else cast(600 + doc_id % 40 as string) end end AS account,
          case when doc_id % 6 = 0 then '600 Materias-Primas' when doc_id % 6 = 1 then 'maquinaria' else 'transporte' end AS concept
        FROM (SELECT o_orderkey AS doc_id, case o_orderstatus when 'F' then 'compras' when 'O' then 'ventas' else 'bienes' end AS book,
          cast(o_totalprice as decimal(18,2)) AS total, case when o_orderkey % 50 = 0 then 'N/A' else cast(cast(o_totalprice as decimal(18,2)) as string) end AS total_raw,
          cast(cast(o_orderdate as date) as string) AS day, {nif("o_custkey")} AS c_nif, {cif("(o_orderkey % 10)")} AS s_nif,
          case when o_custkey % 11 = 0 then '' else 'Customer#' || lpad(cast(o_custkey as string), 9, '0') end AS c_name, 'Supplier#' || lpad(cast(o_orderkey % 10 as string), 9, '0') AS s_name
          FROM {{orders}}) o""",
    "tax_lines": """
        SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY n, p, s, base, taxed) AS int) - 1 AS line_index, base_raw, rate_raw,
          case when d = 9 then null else cast(taxed as string) end AS tax_raw, case when n = 6 then 'N/A' else cast(base + taxed as string) end AS total_raw,
          cast(0.95 as decimal(5,4)) AS base_confidence, cast(0.9 - n * 0.01 as decimal(5,4)) AS rate_confidence, case when n = 2 then null else cast(0.85 as decimal(5,4)) end AS tax_confidence, cast(0.8 as decimal(5,4)) AS total_confidence
        FROM (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, cast(l_extendedprice as decimal(14,2)) AS base, cast(round(l_discount * 100) as int) AS d,
          case when cast(round(l_discount * 100) as int) = 5 and l_linenumber = 3 then 'x1' else cast(cast(l_extendedprice as decimal(14,2)) as string) end AS base_raw,
          case when cast(round(l_discount * 100) as int) = 8 then null when cast(round(l_discount * 100) as int) = 7 and l_linenumber = 4 then 'abc' else cast(cast(round(l_tax * 100) as int) as string) end AS rate_raw,
          cast(round(cast(l_extendedprice as decimal(14,2)) * cast(l_tax as decimal(6,2)), 2) as decimal(14,2)) + case when cast(round(l_discount * 100) as int) = 10 then cast(0.05 as decimal(3,2)) else cast(0 as decimal(3,2)) end AS taxed
          FROM {lineitem}) l""",
    "doc_events": """
        SELECT user_id AS doc_id, event_id AS seq, k, case event_type when 'signup' then 'uploaded' when 'view' then case when k % 5 = 0 then 'retrying' else 'processing' end when 'click' then 'review' when 'purchase' then case when k % 4 = 0 then 'done' else 'confirmed' end else case when k % 3 = 0 then 'lost' else 'error' end end AS status,
          case when event_type = 'click' and k % 2 = 0 then 'reject' when event_type = 'click' then 'approve' when event_type = 'purchase' and k % 8 = 0 then 'confirmed' else null end AS action,
          case when k % 3 = 0 then 'compras' when k % 3 = 1 then null else 'ventas' end AS book, case when k % 7 = 0 then 'sha' || cast(k as string) else null end AS sha256_file, case when k % 5 = 1 then 'auto' when k % 5 = 2 then 'block' else null end AS decision,
          case when event_type = 'signup' then 'inbox/' || cast(event_id as string) || '.pdf' else null end AS file_origin
        FROM (SELECT user_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as int) AS k FROM {events}) e""",
    "candidates": """
        SELECT user_id AS doc_id, event_type AS field, event_id AS pos, case when k % 17 = 0 then '' else 'v' || cast(k % 12 as string) end AS value,
          cast(cast(((k * 37) % 100) as decimal(5,2)) * 0.01 as decimal(5,4)) AS confidence, case when event_id % 6 = 0 then false when event_id % 6 = 1 then null else true end AS valid,
          case event_id % 8 when 0 then 'document_ai_nativo' when 1 then 'normalized_value' when 2 then 'fase2_ocr' when 3 then 'regex_contextual' when 4 then 'llm_arbitro' when 5 then 'fallback' when 6 then 'sistema' else 'derivado' end AS source,
          case event_id % 4 when 0 then 'invoice_date' when 1 then 'delivery_date' when 2 then 'receive_date' else null end AS source_date
        FROM (SELECT user_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as int) AS k FROM {events}) e""",
    "master": f"""
        SELECT case when c_custkey % 19 = 0 then lower({nif("c_custkey")}) else {nif("c_custkey")} end AS nif, case when c_custkey % 23 = 0 then '' else c_name end AS nombre, '2020-01-' || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') AS fecha_alta,
          cast(c_custkey % 17 as int) AS documentos, case when c_custkey % 6 = 0 then null else '2021-0' || cast(c_custkey % 9 + 1 as string) || '-01' end AS ultima, c_custkey AS pos
        FROM {{customer}} WHERE c_mktsegment <> 'HOUSEHOLD'""",
    "suppliers": f"""
        SELECT case when p_partkey % 13 = 0 then ' ' else ' ' || lower({cif("(p_partkey % 10)")}) end AS nif, case when p_partkey % 3 = 0 then '' else cast(600 + p_partkey % 9 as string) end AS account, 'transporte' AS concept,
          case when p_partkey % 2 = 0 then null else cast(0.96 as decimal(5,4)) end AS confidence, p_partkey AS pos FROM {{part}}""",
    "finals": """
        SELECT doc_id, book || '_' || lpad(cast(doc_id as string), 9, '0') AS folder, book, case when doc_id % 5 = 0 then lower(client) || ' ' else client end AS client_nif, case when doc_id % 8 = 0 then null else date end AS date,
          case when doc_id % 3 = 0 then date else null end AS operation_date, case when doc_id % 4 = 0 then ' ' else 'Name ' || cast(doc_id % 5 as string) end AS name, doc_id AS finalized_seq,
          case when doc_id % 11 = 0 or doc_id % 22 = 1 then 'cancelled' when doc_id % 11 = 1 then 'error' else 'done' end AS status, doc_id % 13 = 0 AS rejected, 'NIF' || cast(doc_id % 10 as string) AS hash_nif, 'f- 00' || cast(doc_id % 300 as string) AS hash_number, case when doc_id % 40 = 7 then null else '2024-01-0' || cast(doc_id % 9 + 1 as string) end AS hash_date
        FROM (SELECT doc_id, book, date, case when book = 'ventas' then issuer_nif else receiver_nif end AS client FROM docs) f""",
}
NEEDS = {"finals": ("docs",)}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*_order(NEEDS.get(n, ())), n) if x not in out]
    return out


def sql_for(names: tuple[str, ...]) -> str:
    """The views as a DuckDB WITH clause."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in _order(names)) if names else ""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"{(\w+)}", text)}
    for n in NEEDS.get(name, ()):
        text = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", text)
        tables[n] = view(spark, sf_dir, n)
    return spark.sql(text, **tables)


class Registry:
    """Queries by name, with the reference operators that each answers for and its oracle."""

    def __init__(self):
        self.queries, self.oracle, self.covers = {}, {}, {}

    def add(self, name: str, covers: str, sql: str | None = None, views: tuple[str, ...] = ()):
        """Registers a function of (spark, sf_dir); ``sql`` follows the WITH clause of ``views``."""

        def keep(f):
            self.queries[name], self.covers[name] = f, covers.split()
            if sql:
                head = sql_for(views)
                text = sql.strip()
                if text.startswith("WITH RECURSIVE "):
                    head, text = head.replace("WITH ", "WITH RECURSIVE ", 1), text.replace("RECURSIVE ", "", 1)
                self.oracle[name] = f"{head}, {text[5:]}" if head and text[:5].upper() == "WITH " else f"{head} {text}"
            return f

        return keep


registry = Registry()
