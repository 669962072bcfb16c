"""Reading files, artifacts and recognised documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif")


def scan_folder(spark: SparkSession, path: str, extensions=EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length) of files with these extensions, ordered by path. Contents aren't read; a missing folder raises."""
    files = spark.read.format("binaryFile").load(path).drop("content")
    return with_extension(files, "path", extensions).orderBy("path")


def with_extension(files: DataFrame, column: str = "path", extensions=EXTENSIONS) -> DataFrame:
    """Rows whose name has one of the extensions, in any case."""
    return files.where(F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1)).isin(list(extensions)))


#: Extensions of uploads, and the artifacts that may be asked for by name.
INVOICE_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".tif", ".webp", ".bmp")
ARTIFACTS = ("raw_document_ai", "documento_extraido", "resultado_identidad_cabecera", "resultado_fiscal", "resultado_semantica", "resultado_cliente", "resultado_validacion")


def name_parts(path: Column) -> tuple[Column, Column, Column]:
    """Base name, stem and lower-case extension with its point; a name's leading points begin no extension."""
    base = F.substring_index(path, "/", -1)
    end = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    return base, F.left(base, F.length(base) - F.length(end)), F.lower(end)


def upload_errors(files: DataFrame, column: str = "name") -> DataFrame:
    """files with ``error``: extension, name (empty, hidden or with two points in a row), or null if the upload is fine."""
    base, _, end = name_parts(F.col(column))
    return files.withColumn("error", F.when(~end.isin(*INVOICE_EXTENSIONS), "extension").when((base == "") | base.startswith(".") | base.contains(".."), "name"))


def entry_folders(files: DataFrame, column: str = "path") -> DataFrame:
    """(folder): names of the folders in files that hold a state sidecar, in order."""
    side = files.where(F.substring_index(column, "/", -1) == ".state.json")
    return side.select(F.element_at(F.split(column, "/"), -2).alias("folder")).distinct().orderBy("folder")


def artifact(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """requests (doc_id, name) with ``state``: refused for names not on the list, absent, corrupt or ok. artifacts (doc_id, name, corrupt)."""
    known = artifacts.groupBy("doc_id", "name").agg(F.max("corrupt").alias("corrupt"))
    state = F.when(~F.col("name").isin(*ARTIFACTS), "refused").when(F.col("corrupt").isNull(), "absent").when(F.col("corrupt"), "corrupt").otherwise("ok")
    return requests.join(known, ["doc_id", "name"], "left").withColumn("state", state).drop("corrupt")


def inbox_listing(files: DataFrame, status: DataFrame) -> DataFrame:
    """(book, name, size_kb, added, status, folder) of inbox files (book, name, size, added) by book and time; status (doc_id text, status, folder) by the file's stem, in whatever book."""
    stem = name_parts(F.col("name"))[1]
    out = files.withColumn("doc_id", stem).join(status, "doc_id", "left")
    return out.select("book", "name", F.round(F.col("size") / 1024, 1).alias("size_kb"), "added", "status", "folder").orderBy("book", "added", "name")


#: Files whose names a task cuts into parts, some forty each.
CUT_FILES = 100_000


def original_file(documents: DataFrame, origins: DataFrame, inbox: DataFrame) -> DataFrame:
    """(doc_id, name, found): the file of each document (doc_id text, folder), or null.

    In order: the origin of its first event (origins: doc_id, name) if it is in
    the inbox (book, name); the inbox file of its book with its id as stem; one
    that has the id anywhere in its name. Of several, the first by name. The
    last two are an equi-join too: names are cut into all parts that are as long
    as some id and have only characters that ids have, and of each part the best
    name is found before any document is looked up.
    """
    _, stem, end = name_parts(F.col("name"))
    files = inbox.where(end.isin(*INVOICE_EXTENSIONS)).select("book", "name", stem.alias("stem"))
    files = files.repartition(inbox.count() // CUT_FILES + 1)  # what a task cuts fits its memory
    docs = documents.select("doc_id", F.substring_index("folder", "_", 1).alias("book"))
    there = origins.join(inbox.select("name").distinct(), "name", "left_semi")
    first = docs.select("doc_id").join(there, "doc_id").select("doc_id", F.struct(F.lit(0).alias("rank"), "name").alias("f"))
    ids = documents.where(F.col("doc_id").isNotNull())
    sizes = F.broadcast(ids.select(F.length("doc_id").alias("n")).distinct())  # a few lengths
    letters = F.broadcast(ids.select(F.explode(F.split("doc_id", "")).alias("c")).distinct().agg(F.array_join(F.collect_list("c"), "").alias("letters")))  # a row
    starts = F.sequence(F.lit(1), F.length("name") - F.col("n") + 1)
    cut = files.join(sizes, F.length("name") >= F.col("n")).crossJoin(letters)
    part = F.explode(F.filter(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("name"), i, F.col("n")))), lambda x: F.call_function("translate", x, F.col("letters"), F.lit("")) == ""))
    parts = cut.select("book", "name", "stem", part.alias("doc_id"))
    rank = F.when(F.col("doc_id") == F.col("stem"), 1).otherwise(2)
    named = parts.groupBy("book", "doc_id").agg(F.min(F.struct(rank.alias("rank"), "name")).alias("f"))
    best = first.union(docs.join(named, ["book", "doc_id"]).select("doc_id", "f")).groupBy("doc_id").agg(F.min("f").alias("f"))
    how = F.when(F.col("f.rank") == 0, "origin").when(F.col("f.rank") == 1, "stem").when(F.col("f.rank") == 2, "part")
    return documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.col("f.name").alias("name"), how.alias("found"))


def setting_list(text: Column, separator: str = ",", upper: bool = False) -> Column:
    """A setting's values: trimmed, empty ones dropped, each once, in order."""
    each = F.transform(F.split(text, "[" + separator + "]"), lambda x: F.upper(F.trim(x)) if upper else F.trim(x))
    return F.array_distinct(F.filter(each, lambda x: x != ""))


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON artifacts with ``corrupt``: whether a record couldn't be read. Corrupt and absent differ, so nothing is dropped."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.withColumn("corrupt", F.col("_corrupt_record").isNotNull()).withColumn("path", F.input_file_name())


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines (1 to 1000), newest first; lines that aren't JSON stay as ``raw``. The limit is the operator."""
    n = min(max(n, 1), 1000)
    parsed = F.from_json("value", "level string, message string")
    tail = lines.orderBy(F.desc("line_no")).limit(n)
    ok = parsed["level"].isNotNull() | parsed["message"].isNotNull()
    return tail.select("line_no", parsed["level"].alias("level"), parsed["message"].alias("message"), F.when(~ok | parsed.isNull(), F.col("value")).alias("raw"))


ENTITY = (
    "struct<type:string,type_:string,entityType:string,mentionText:string,mention_text:string,confidence:double,"
    "normalizedValue:struct<text:string,moneyValue:struct<units:string,nanos:bigint>,dateValue:struct<year:int,month:int,day:int>>,"
    "textAnchor:struct<textSegments:array<struct<startIndex:int,endIndex:int>>>,"
    "pageAnchor:struct<pageRefs:array<struct<page:int,boundingPoly:struct<normalizedVertices:array<struct<x:double,y:double>>>>>>>"
)
BRIDGE = f"struct<text:string,entities:array<{ENTITY}>,document:struct<text:string,entities:array<{ENTITY}>>>"


def entities(raw: Column) -> Column:
    """The entities of a recognised document in JSON, bare or in a wrapper."""
    doc = F.from_json(raw, BRIDGE)
    return F.coalesce(doc["entities"], doc["document"]["entities"])


def of_type(found: Column, kind: str) -> Column:
    """Entities of a type, under any of its three names."""
    return F.filter(found, lambda e: F.coalesce(e["type_"], e["type"], e["entityType"]) == kind)


def first_of_type(found: Column, kind: str) -> Column:
    """The first of them, or null."""
    return F.try_element_at(of_type(found, kind), F.lit(1))


def mention(entity: Column) -> Column:
    return F.coalesce(entity["mentionText"], entity["mention_text"])


def normalized_text(entity: Column) -> Column:
    """The normalised text, else an ISO date of a complete date value."""
    v = entity["normalizedValue"]
    d = v["dateValue"]
    whole = (d["year"] > 0) & (d["month"] > 0) & (d["day"] > 0)
    iso = F.concat_ws("-", F.lpad(d["year"].cast("string"), 4, "0"), F.lpad(d["month"].cast("string"), 2, "0"), F.lpad(d["day"].cast("string"), 2, "0"))
    return F.coalesce(F.nullif(v["text"], F.lit("")), F.when(whole, iso))


def money(entity: Column) -> Column:
    """Units and billionths as one decimal."""
    m = entity["normalizedValue"]["moneyValue"]
    return (m["units"].try_cast("decimal(18,0)") + (F.coalesce(m["nanos"], F.lit(0)).cast("decimal(18,9)") * F.lit("0.000000001").cast("decimal(10,9)"))).cast("decimal(18,6)")


def box(entity: Column) -> Column:
    """struct(x_min, y_min, x_max, y_max) of the first page reference with two vertices or more."""
    refs = F.filter(entity["pageAnchor"]["pageRefs"], lambda r: F.size(r["boundingPoly"]["normalizedVertices"]) >= 2)
    v = F.try_element_at(refs, F.lit(1))["boundingPoly"]["normalizedVertices"]
    x, y = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.when(v.isNotNull(), F.struct(F.array_min(x).alias("x_min"), F.array_min(y).alias("y_min"), F.array_max(x).alias("x_max"), F.array_max(y).alias("y_max")))


def page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages (doc_id, page, text) joined in order, each under a header line. Recognition itself is an input."""
    each = F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("page", each.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n").alias("text"))


def text_or_fallback(text: Column, name: Column, concepts: Column) -> Column:
    """The recognised text, else name and concepts in a row."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.concat_ws(" ", name, concepts))


def valid_document(fields: dict[str, Column], least: float) -> Column:
    """Reasons why a document can't go on: missing critical fields, or ones below the least confidence; empty if it can."""
    out = []
    for name, cell in fields.items():
        out.append(F.when(F.coalesce(F.trim(cell["valor"]), F.lit("")) == "", F.lit(f"{name}: missing")).when(F.coalesce(cell["confianza"], F.lit(0)) < least, F.lit(f"{name}: low confidence")))
    return F.filter(F.array(*out), lambda r: r.isNotNull())


def cell_confidence(value: Column) -> Column:
    """0 for nothing, else 0.95."""
    return F.when(F.coalesce(F.trim(value), F.lit("")).isin("", "nan", "NaN"), 0.0).otherwise(0.95)
