"""Queries of scalar functions, ordered sets, sources and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import dates, identifiers, numbers, texts, versions
from ..operators import events, ordered, rollups
from ..sources import dimensions, readers, sinks
from ..streaming import keyed, status
from .views import registry, view

D = ("docs",)

def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")

_LETTER = "substr('TRWAGMYFPDXBNJZSQVHLCKE', ({0}) % 23 + 1, 1)"
_DIGIT = "CAST(substr(v, {0}, 1) AS INT)"
_SUM = " + ".join(f"(CASE WHEN {_DIGIT.format(k)} * 2 > 9 THEN {_DIGIT.format(k)} * 2 - 9 ELSE {_DIGIT.format(k)} * 2 END)" if k % 2 == 0 else _DIGIT.format(k) for k in range(2, 9))
IDS = f"""
ids AS (SELECT doc_id, raw, regexp_replace(upper(trim(raw)), '[\\s\\-\\.]', '', 'g') AS v FROM (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'X' || substr(receiver_nif, 2) WHEN doc_id % 12 = 1 THEN ' ' || lower(receiver_nif) WHEN doc_id % 12 = 2 THEN substr(receiver_nif, 1, 3) || '-' || substr(receiver_nif, 4) WHEN doc_id % 12 = 3 THEN '?' ELSE issuer_nif END AS raw FROM docs)),
kinds AS (SELECT *, CASE WHEN regexp_full_match(v, '[0-9]{{8}}[A-Z]') THEN 'nif' WHEN regexp_full_match(v, '[ABCDEFGHJKLMNPQRSUVW][0-9]{{7}}[0-9A-J]') THEN 'cif' WHEN regexp_full_match(v, '[XYZ][0-9]{{7}}[A-Z]') THEN 'nie' ELSE 'desconocido' END AS kind FROM ids)"""

@registry.add("scl10_13_tax_ids", "SCL-10 SCL-11 SCL-12 SCL-13 SCL-14", f"""WITH {IDS} SELECT doc_id, v AS value, kind, coalesce(CASE kind WHEN 'nif' THEN {_LETTER.format("CAST(substr(v, 1, 8) AS BIGINT)")} = substr(v, 9, 1) WHEN 'nie' THEN {_LETTER.format("CAST(translate(substr(v, 1, 1), 'XYZ', '012') || substr(v, 2, 7) AS BIGINT)")} = substr(v, 9, 1)
    WHEN 'cif' THEN substr(v, 9, 1) = CAST((10 - ({_SUM}) % 10) % 10 AS VARCHAR) OR substr(v, 9, 1) = substr('JABCDEFGHI', (10 - ({_SUM}) % 10) % 10 + 1, 1) END, false) AS valid FROM kinds""", D)  # fmt: skip
def scl10_13_tax_ids(spark, sf):
    m = F.col("doc_id") % 12
    r = F.col("receiver_nif")
    raw = F.when(m == 0, F.concat(F.lit("X"), F.substring(r, 2, 99))).when(m == 1, F.concat(F.lit(" "), F.lower(r))).when(m == 2, F.concat(F.substring(r, 1, 3), F.lit("-"), F.substring(r, 4, 99))).when(m == 3, "?").otherwise(F.col("issuer_nif"))
    v = identifiers.clean(raw)
    return view(spark, sf, "docs").select("doc_id", v.alias("value"), identifiers.kind(v).alias("kind"), identifiers.is_valid(v).alias("valid"))

_RAW = "CASE doc_id % 9 WHEN 0 THEN '-' || CAST(total AS VARCHAR) WHEN 1 THEN '% ' || CAST(total AS VARCHAR) WHEN 2 THEN 'N/A' WHEN 3 THEN replace(CAST(total AS VARCHAR), '.', ',') WHEN 4 THEN '1.250,50' WHEN 5 THEN ' +7 ' WHEN 6 THEN 'x' WHEN 7 THEN NULL ELSE CAST(total AS VARCHAR) END"

def _raw_amount():
    m, t = F.col("doc_id") % 9, F.col("total").cast("string")
    return F.when(m == 0, F.concat(F.lit("-"), t)).when(m == 1, F.concat(F.lit("% "), t)).when(m == 2, "N/A").when(m == 3, F.replace(t, F.lit("."), F.lit(","))).when(m == 4, "1.250,50").when(m == 5, " +7 ").when(m == 6, "x").when(m == 8, t)

@registry.add("scl01_02_38_39_numbers", "SCL-01 SCL-02 SCL-38 SCL-39 SCL-41 SCL-51", f"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM docs), s AS (SELECT *, CASE WHEN trim(raw) NOT IN ('-','+','%','--','N/A','n/a','na','NA','') THEN abs(TRY_CAST(trim(regexp_replace(trim(raw), '^[+%-]', '')) AS DECIMAL(18,6))) END AS d FROM r)
    SELECT doc_id, d AS safe, replace(CAST(CAST(round(d, 2) AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS shown, coalesce(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE), 0) AS as_float,
      coalesce(TRY_CAST(CASE WHEN contains(raw, ',') AND contains(raw, '.') THEN replace(replace(trim(raw), '.', ''), ',', '.') ELSE replace(trim(raw), ',', '.') END AS DOUBLE), 0) AS as_spanish,
      CASE WHEN trim(raw) NOT IN ('-','+','%','--','N/A','n/a','na','NA','') THEN nullif(trim(regexp_replace(trim(raw), '^[+%-]', '')), '') END AS cleaned FROM s""", D)  # fmt: skip
def scl01_02_38_39_numbers(spark, sf):
    raw = _raw_amount()
    safe = numbers.safe_decimal(raw)
    return view(spark, sf, "docs").select("doc_id", safe.alias("safe"), numbers.comma_amount(safe).alias("shown"), numbers.safe_float(raw).alias("as_float"), numbers.spanish_number(raw).alias("as_spanish"), numbers.clean_value(raw).alias("cleaned"))

@registry.add("scl15_40_dates", "SCL-15 SCL-40", """WITH p AS (SELECT doc_id, date, substr(date, 1, 4) AS y, substr(date, 6, 2) AS m, substr(date, 9, 2) AS d FROM docs)
    SELECT doc_id, CASE doc_id % 7 WHEN 5 THEN NULL WHEN 6 THEN '2024-03-05' ELSE date END AS iso, d || '/' || m || '/' || y AS shown FROM p""", D)  # fmt: skip
def scl15_40_dates(spark, sf):
    day, k = F.col("date"), F.col("doc_id") % 7
    y, m, d = F.substring(day, 1, 4), F.substring(day, 6, 2), F.substring(day, 9, 2)
    written = F.when(k == 0, day).when(k == 1, F.concat_ws("/", d, m, y)).when(k == 2, F.concat_ws(".", d, m, F.substring(y, 3, 2))).when(k == 3, F.concat(d, m, y)).when(k == 4, F.concat(F.lit(" "), d, F.lit("-"), m, F.lit("-"), y)).when(k == 5, "31/02/2024").otherwise("el 5 de Marzo de 2024")
    return view(spark, sf, "docs").select("doc_id", dates.iso_date(written).alias("iso"), dates.day_first(day).alias("shown"))

@registry.add("scl16_17_context", "SCL-16 SCL-17 WIN-10 SRT-07", "SELECT doc_id, issuer_nif || ',' || receiver_nif AS ids, number, CAST(2 AS BIGINT) AS windows, left('NIF: ' || issuer_nif, 8) AS head FROM docs", D)
def scl16_17_context(spark, sf):
    d = view(spark, sf, "docs")
    text = F.concat(F.lit("NIF: "), F.col("issuer_nif"), F.lit(" Factura "), F.col("number"), F.lit(" cif. "), F.col("receiver_nif"))
    return d.select("doc_id", F.array_join(texts.in_context(text, texts.ID_CONTEXT, texts.ID_SHAPE, 20), ",").alias("ids"), texts.in_context(text, texts.NUMBER_CONTEXT, r"[A-Z0-9][A-Z0-9\-/]{3,}", 30)[0].alias("number"), F.size(texts.context_windows(text, texts.ID_CONTEXT, 20)).cast("long").alias("windows"), F.left(text, F.lit(8)).alias("head"))

_ODD = ["15 de de marzo 2026", "15 marzo 2026ñ", "día 15 marzo de 2026.", "1 ENE de 1999", "115 mayo 2020", "31 de abril de 2020", "(3 de sept 2020)", "9 dic 2021x", "x9 dic 2021", "29 feb 2024 y 1 mar 2024"]
_ODD_IDS = ["1 2345678Z", "B 1 2345674", "X 1 234567L", "B 12 34567 4", "12 3 4 5 6 7 8 Z", "x1234567l", "B1234567A9", "1234567Z", "Z 9"]
_EDGES = [None, None, "2026-03-15", "1999-01-01", None, None, None, None, None, "2024-02-29"]
_EDGE_IDS = ["2345678Z", "B 1 234567", "1 234567L", "B 12 34567 4", "12 3 4 5 6 7 8 Z", "x1234567l", "B1234567A", "1234567Z", ""]
_list = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"

@registry.add("scl15_16_edges", "SCL-15 SCL-16", f"""SELECT doc_id, {_list(_EDGES)}[CAST(doc_id % {len(_ODD)} AS INT) + 1] AS iso, {_list(_EDGE_IDS)}[CAST(doc_id % {len(_ODD_IDS)} AS INT) + 1] AS id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE receiver_nif END AS receiver FROM docs""", D)
def scl15_16_edges(spark, sf):
    """Dates and ids as no layout has them, and the receiver's id after the words that announce it."""
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs)).cast("int"))
    text = F.concat(F.lit("NIF: "), "issuer_nif", F.when(F.col("doc_id") % 3 == 0, " Bill  TO: ").when(F.col("doc_id") % 3 == 1, "\nDatos fiscales del cliente # ").otherwise(" clientela "), "receiver_nif")
    found = texts.in_context(text, texts.RECEIVER_CONTEXT, texts.ID_SHAPE, 20)
    return view(spark, sf, "docs").select("doc_id", dates.iso_date(pick(_ODD)).alias("iso"), F.regexp_extract(pick(_ODD_IDS), f"(?i){identifiers.WRITTEN}", 0).alias("id"), F.get(found, F.lit(0)).alias("receiver"))

_VERSIONS = """v AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'x.1.2' WHEN 2 THEN '1.2' ELSE (doc_id % 3) || '.' || (doc_id % 12) || '.' || (doc_id % 4) || CASE doc_id % 4 WHEN 0 THEN '-rc.1' WHEN 1 THEN '-' ELSE '' END END AS latest,
  CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN '0.0.0-dev' ELSE (doc_id % 3) || '.' || (doc_id % 10) || '.' || (doc_id % 2) || CASE WHEN doc_id % 5 = 0 THEN '-dev' ELSE '' END END AS current FROM {docs})"""

@registry.add("scl47_newer_versions", "SCL-47", rf"""WITH {_VERSIONS.replace("{docs}", "docs")}, n AS (SELECT *, regexp_extract(latest, '^([0-9]+)\.([0-9]+)\.([0-9]+)(-.+)?', ['a','b','c','s']) AS l, regexp_extract(current, '^([0-9]+)\.([0-9]+)\.([0-9]+)(-.+)?', ['a','b','c','s']) AS r FROM v)
    SELECT doc_id, latest, current, CASE WHEN coalesce(latest, '') = '' OR coalesce(current, '') = '' THEN false WHEN l.a = '' OR r.a = '' THEN latest <> current ELSE (TRY_CAST(l.a AS INT), TRY_CAST(l.b AS INT), TRY_CAST(l.c AS INT), l.s = '') > (TRY_CAST(r.a AS INT), TRY_CAST(r.b AS INT), TRY_CAST(r.c AS INT), r.s = '') END AS newer FROM n""", D)
def scl47_newer_versions(spark, sf):
    v = spark.sql(f"WITH {_VERSIONS} SELECT * FROM v", docs=view(spark, sf, "docs"))
    return v.select("doc_id", "latest", "current", versions.is_newer(F.col("latest"), F.col("current")).alias("newer"))

@registry.add("scl27_32_34_36_keys", "SCL-27 SCL-32 SCL-34 SCL-35 SCL-36 SCL-63", r"""
    SELECT doc_id, nullif(regexp_replace(trim(lower(regexp_replace(translate(trim(concept), ' -', '__'), '[^a-zA-Z_]', '', 'g')), '_'), '_+', '_', 'g'), '') AS concept_key,
      regexp_replace(upper(regexp_replace('f- 00' || number, '\s+', '', 'g')), '(^|[^A-Z0-9])0+([1-9])', '\1\2', 'g') AS number_key,
      CASE WHEN issuer_verdict IN ('auto','warn','pendiente') AND issuer_nif <> '' THEN book || '_' || date || '_' || issuer_nif || '_' || trim(regexp_replace('/' || number || ' b', '[^A-Za-z0-9-]+', '-', 'g'), '-') END AS folder,
      split_part(book || '_x_y', '_', 1) AS book_of_folder, number AS parent, CAST(doc_id % 5 + 1 AS INT) AS part, 7 AS parts FROM docs""", D)  # fmt: skip
def scl27_32_34_36_keys(spark, sf):
    d = view(spark, sf, "docs")
    name = texts.split_name(F.concat(F.col("number"), F.lit("__"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("OF7")))
    return d.select(
        "doc_id", texts.concept_key(F.col("concept")).alias("concept_key"), texts.invoice_number(F.concat(F.lit("f- 00"), F.col("number"))).alias("number_key"),
        texts.folder_name(F.col("book"), F.col("date"), F.col("issuer_nif"), F.concat(F.lit("/"), F.col("number"), F.lit(" b")), F.col("issuer_verdict")).alias("folder"),
        F.substring_index(F.concat(F.col("book"), F.lit("_x_y")), "_", 1).alias("book_of_folder"), name["parent"].alias("parent"), name["part"].alias("part"), name["parts"].alias("parts"),
    )

@registry.add("scl33_60_digests", "SCL-33 SCL-60", "SELECT doc_id, substr(sha256(issuer_nif || '|' || number || '|' || date), 1, 16) AS fiscal_hash, sha256(number) || '#' || doc_id AS part_digest FROM (SELECT doc_id, issuer_nif, date, 'N' || CAST(doc_id AS VARCHAR) AS number FROM docs)", D)
def scl33_60_digests(spark, sf):
    number = F.concat(F.lit("N"), F.col("doc_id").cast("string"))
    return view(spark, sf, "docs").select("doc_id", texts.fiscal_hash(F.col("issuer_nif"), number, F.col("date")).alias("fiscal_hash"), F.concat(F.sha2(number, 256), F.lit("#"), F.col("doc_id").cast("string")).alias("part_digest"))

@registry.add("scl42_43_export_cells", "SCL-42 SCL-43 SNK-15", r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '9' WHEN doc_id % 5 = 1 THEN '5.5' ELSE CAST(doc_id % 5 AS VARCHAR) END AS rate, upper(regexp_replace(regexp_replace(trim('´' || issuer_nif), '^[^A-Za-z0-9]+', ''), '\s+', '', 'g')) AS cell,
    CASE WHEN doc_id % 4 = 0 THEN 'SIN_CLIENTE' ELSE issuer_nif END AS file_key, CASE WHEN doc_id % 3 = 0 THEN '"a;""' || doc_id || '"' WHEN doc_id % 3 = 1 THEN '"r' || chr(13) || '"' ELSE 'plain' END AS quoted, CASE WHEN doc_id % 3 = 0 THEN '"a;""' || doc_id || '"' WHEN doc_id % 3 = 1 THEN 'r' || chr(13) ELSE 'plain' END AS quoted_lf FROM docs""", D)  # fmt: skip
def scl42_43_export_cells(spark, sf):
    k, i = F.col("doc_id"), F.col("issuer_nif")
    rate = F.when(k % 5 == 1, F.lit("5.50").cast("decimal(6,2)")).otherwise((k % 5).cast("decimal(6,2)"))
    value = F.when(k % 3 == 0, F.concat(F.lit('a;"'), k.cast("string"))).when(k % 3 == 1, "r\r").otherwise("plain")
    return view(spark, sf, "docs").select("doc_id", numbers.export_rate(rate).alias("rate"), identifiers.export_cell(F.concat(F.lit("´"), i)).alias("cell"), identifiers.file_key(F.when(k % 4 == 0, "-").otherwise(i)).alias("file_key"), numbers.csv_cell(value).alias("quoted"), numbers.csv_cell_lf(value).alias("quoted_lf"))

@registry.add("scl23_markers_in_texts", "SCL-23 SRC-23", "SELECT doc_id, contains(upper(trim(regexp_replace(strip_accents(coalesce(text, '')), '\\s+', ' ', 'g'))), 'LICENSED UNDER') AS marked FROM documents")
def scl23_markers_in_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", texts.has_marker(F.col("text"), ["licénsed  under"]).alias("marked"))

@registry.add("src14_log_tail", "SRC-14 SRT-06", "SELECT event_id AS line_no, CASE WHEN event_id % 3 <> 0 THEN event_type END AS level, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS message, CASE WHEN event_id % 3 = 0 THEN 'plain ' || event_type END AS raw FROM events ORDER BY event_id DESC LIMIT 50")
def src14_log_tail(spark, sf):
    e = table(spark, sf, "events")
    json = F.to_json(F.struct(F.col("event_type").alias("level"), F.col("user_id").cast("string").alias("message")))
    return readers.log_tail(e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("plain "), "event_type")).otherwise(json).alias("value")), 50)

@registry.add("src18_21_entities", "SRC-18 SRC-19 SRC-20 SRC-21", "SELECT doc_id, issuer_nif AS nif, date AS day, total AS amount, CAST(0.25 AS DOUBLE) AS x_min, CAST(0.75 AS DOUBLE) AS y_max, CAST(5 AS INT) AS starts FROM (SELECT doc_id, issuer_nif, date, CAST(total AS DECIMAL(18,6)) AS total FROM docs)", D)
def src18_21_entities(spark, sf):
    y, m, d = F.substring("date", 1, 4), F.substring("date", 6, 2).cast("int").cast("string"), F.substring("date", 9, 2).cast("int").cast("string")
    units = F.floor("total").cast("string")
    nanos = ((F.col("total") - F.floor("total")) * 1000000000).cast("long").cast("string")
    nif = F.concat(F.lit('{"type_":"supplier_tax_id","mentionText":"'), F.col("issuer_nif"), F.lit('","textAnchor":{"textSegments":[{"startIndex":5,"endIndex":9}]},"pageAnchor":{"pageRefs":[{"page":0},{"page":1,"boundingPoly":{"normalizedVertices":[{"x":0.5,"y":0.25},{"x":0.25,"y":0.75}]}}]}}'))
    day = F.concat(F.lit('{"type":"invoice_date","normalizedValue":{"dateValue":{"year":'), y, F.lit(',"month":'), m, F.lit(',"day":'), d, F.lit("}}}"))
    amount = F.concat(F.lit('{"entityType":"total_amount","normalizedValue":{"moneyValue":{"units":"'), units, F.lit('","nanos":'), nanos, F.lit("}}}"))
    body = F.concat(F.lit('{"text":"t","entities":['), nif, F.lit(","), day, F.lit(","), amount, F.lit("]}"))
    raw = F.when(F.col("doc_id") % 2 == 0, body).otherwise(F.concat(F.lit('{"document":'), body, F.lit("}")))
    e = view(spark, sf, "docs").select("doc_id", readers.entities(raw).alias("e"))
    first = lambda kind: readers.first_of_type(F.col("e"), kind)
    box = readers.box(first("supplier_tax_id"))
    return e.select("doc_id", readers.mention(first("supplier_tax_id")).alias("nif"), readers.normalized_text(first("invoice_date")).alias("day"), readers.money(first("total_amount")).alias("amount"), box["x_min"].alias("x_min"), box["y_max"].alias("y_max"), first("supplier_tax_id")["textAnchor"]["textSegments"][0]["startIndex"].alias("starts"))

@registry.add("src16_page_texts", "SRC-16", "SELECT conv_id AS doc_id, string_agg('--- page ' || turn || ' ---' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def src16_page_texts(spark, sf):
    return readers.page_text(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))

@registry.add("flt15_document_validity", "FLT-15 SCL-48", "SELECT doc_id, concat_ws('; ', CASE WHEN issuer_name = '' THEN 'nombre: missing' END, CASE WHEN doc_id % 10 = 0 THEN 'total: low confidence' END) AS reasons, CAST(CASE WHEN issuer_name = '' THEN 0.0 ELSE 0.95 END AS DOUBLE) AS confidence FROM docs", D)
def flt15_document_validity(spark, sf):
    cell = lambda v, c: F.struct(v.alias("valor"), c.alias("confianza"))
    fields = {"nombre": cell(F.col("issuer_name"), F.lit(0.9)), "total": cell(F.col("total_raw"), F.when(F.col("doc_id") % 10 == 0, 0.1).otherwise(0.9))}
    return view(spark, sf, "docs").select("doc_id", F.array_join(readers.valid_document(fields, 0.5), "; ").alias("reasons"), readers.cell_confidence(F.col("issuer_name")).alias("confidence"))

@registry.add("flt18_editable_numbers", "FLT-18", r"SELECT page_id, regexp_full_match(split_part(url, '/', 4), '-?[0-9]*(,[0-9]*)?') AS editable FROM pages")
def flt18_editable_numbers(spark, sf):
    part = F.split_part(F.col("url"), F.lit("/"), F.lit(4))
    return table(spark, sf, "pages").select("page_id", numbers.is_editable(part).alias("editable"))

@registry.add("src01_files_by_extension", "SRC-01", r"SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '\.([^./]+)$', 1)) IN ('html')")
def src01_files_by_extension(spark, sf):
    return readers.with_extension(table(spark, sf, "pages").select("page_id", "url"), "url", ("html",)).orderBy("url", "page_id")

@registry.add("src09_whitelist", "SRC-09", "SELECT s_nationkey AS file, 's' || s_suppkey AS book_key, unnest([CAST(600 + s_suppkey % 40 AS VARCHAR), s_suppkey || '.01', 'x y']) AS code FROM supplier")
def src09_whitelist(spark, sf):
    """A file for each nation, a key for each of its suppliers, with comments, blank lines and both kinds of quotes."""
    k = F.col("s_suppkey")
    block = F.concat(F.lit("# accounts\ns"), k.cast("string"), F.lit(":\n  - \""), (600 + k % 40).cast("string"), F.lit("\"; '"), k.cast("string"), F.lit(".01';\n\n - \"x y\" # one more"))
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("file"), F.struct(k, block.alias("block")).alias("b"))
    texts = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["block"]), "\n").alias("text"))
    return dimensions.whitelist(dimensions.lines_of(texts), "file")

@registry.add("set01_02_ordered_union", "SET-01 SET-02 SET-07", "WITH u AS (SELECT doc_id, 0 AS t, min(seq) AS p FROM doc_events WHERE status = 'uploaded' GROUP BY 1 UNION ALL SELECT doc_id, 1, min(seq) FROM doc_events WHERE status = 'review' GROUP BY 1) SELECT doc_id, t AS source, p AS pos FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t, p) = 1", ("doc_events",))
def set01_02_ordered_union(spark, sf):
    e = view(spark, sf, "doc_events")
    some = lambda s: e.where(F.col("status") == s).select("doc_id", F.col("seq").alias("pos"))
    return ordered.first_wins(some("uploaded"), some("review")).select("doc_id", F.col("place.t").alias("source"), F.col("place.p").alias("pos"))

@registry.add("set03_ordered_difference", "SET-03", "SELECT doc_id, seq FROM doc_events WHERE status = 'review' AND doc_id NOT IN (SELECT doc_id FROM doc_events WHERE status = 'retrying')", ("doc_events",))
def set03_ordered_difference(spark, sf):
    e = view(spark, sf, "doc_events")
    return ordered.without(e.where("status = 'review'").select("doc_id", "seq"), e.where("status = 'retrying'"))

@registry.add("set05_last_wins", "SET-05 JOIN-21", "WITH u AS (SELECT doc_id, 0 AS t, issuer_name AS v FROM docs UNION ALL SELECT doc_id, 1, 'final' FROM finals WHERE rejected) SELECT doc_id, v AS name FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC) = 1", ("docs", "finals"))
def set05_last_wins(spark, sf):
    later = view(spark, sf, "finals").where("rejected").select("doc_id", F.lit("final").alias("name"))
    return ordered.last_wins(view(spark, sf, "docs").select("doc_id", F.col("issuer_name").alias("name")), later, key="doc_id", value="name")

@registry.add("set06_page_cover", "SET-06 SCL-62 WIN-14", "SELECT doc_id, doc_id % 4 <> 3 AS ok FROM docs", D)
def set06_page_cover(spark, sf):
    n = (F.col("doc_id") % 4 + 1).cast("int")
    d = view(spark, sf, "docs").select("doc_id", n.alias("n_pages"))
    each = ordered.one_page_groups(d)
    # documents of four pages get a group that repeats a page
    pages = F.when((F.col("parts") == 4) & (F.col("part") == 4), F.array(F.lit(3))).otherwise(F.array("part"))
    return ordered.covers_pages(each.select("doc_id", pages.alias("pages")), d)

@registry.add("agg13_split_confidence", "AGG-13 AGG-23", "SELECT book, min(c) AS least, CAST(avg(c) AS DECIMAL(10,4)) AS mean, bool_or(c < 0.1) AS any_low, CAST(sum(doc_id % 7) AS BIGINT) AS tokens FROM (SELECT book, doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST((doc_id % 100) * 0.01 AS DECIMAL(5,4)) END AS c FROM docs) GROUP BY book", D)
def agg13_split_confidence(spark, sf):
    c = F.when(F.col("doc_id") % 6 != 0, (F.col("doc_id") % 100 * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(5,4)"))
    return rollups.split_confidence(view(spark, sf, "docs").select("book", c.alias("confidence"), (F.col("doc_id") % 7).alias("tokens")), "book")

@registry.add("join19_refreshed_order", "JOIN-19", "WITH b AS (SELECT doc_id, min(seq) AS old FROM doc_events WHERE status = 'review' GROUP BY 1), n AS (SELECT doc_id, max(seq) AS pos FROM doc_events GROUP BY 1) SELECT n.doc_id, old IS NULL AS is_new, coalesce(old, pos) AS place FROM n LEFT JOIN b ON n.doc_id = b.doc_id", ("doc_events",))
def join19_refreshed_order(spark, sf):
    e = view(spark, sf, "doc_events")
    before = e.where("status = 'review'").groupBy("doc_id").agg(F.min("seq").alias("pos"))
    now = e.groupBy("doc_id").agg(F.max("seq").alias("pos"))
    return ordered.refreshed(before, now).select("doc_id", F.col("place.new").alias("is_new"), F.col("place.p").alias("place"))

@registry.add("snk02_critical_fields", "SNK-02", "WITH f AS (SELECT doc_id, unnest(['nif_entidad','total_euros']) AS field, unnest([issuer_nif, total_raw]) AS value, unnest([issuer_verdict, 'auto']) AS verdict FROM docs), w AS (SELECT doc_id, unnest(['nif_entidad','nombre_entidad','numero_factura','fecha_expedicion','total_euros','nif_receptor','nombre_receptor','concepto','cuenta_contable','nif_cliente']) AS field FROM docs) SELECT w.doc_id, w.field, value, CAST(CASE WHEN verdict IS NOT NULL THEN 0.5 END AS DOUBLE) AS confidence, coalesce(verdict, 'pendiente') AS verdict FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.field = f.field", D)
def snk02_critical_fields(spark, sf):
    row = lambda f, v, w: F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(0.5).alias("confidence"), w.alias("verdict"))
    rows = view(spark, sf, "docs").select("doc_id", F.explode(F.array(row("nif_entidad", F.col("issuer_nif"), F.col("issuer_verdict")), row("total_euros", F.col("total_raw"), F.lit("auto")))).alias("x")).select("doc_id", "x.*")
    return sinks.critical_fields(rows)

@registry.add("str01_stream_last_status", "STR-01 STR-11", "SELECT doc_id, arg_max(status, seq) AS status, max(seq) AS last_seq FROM doc_events GROUP BY doc_id", ("doc_events",))
def str01_stream_last_status(spark, sf):
    changes = keyed.replayed(_steps(spark, sf), status.current_status, scratch.folder(spark, "stream"), "update")
    return keyed.latest(changes.withColumn("change", F.col("last_seq")), "doc_id")

@registry.add("str02_stream_violations", "STR-02", "SELECT doc_id, seq, p AS previous_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM doc_events) WHERE (coalesce(p, '') || '>' || status) NOT IN (" + ",".join(f"'{a}>{b}'" for a, after in events.TRANSITIONS.items() for b in after) + ")", ("doc_events",))
def str02_stream_violations(spark, sf):
    changes = keyed.replayed(_steps(spark, sf), keyed.steps, scratch.folder(spark, "stream"), session=keyed.session_for(spark, spark.sparkContext.defaultParallelism))
    return keyed.latest(changes, "doc_id", "seq").where("not allowed").drop("allowed")

def _steps(spark, sf):
    return view(spark, sf, "doc_events").select("doc_id", "seq", "status")
