"""The accounting export: one CSV per client and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ..functions.dates import day_first
from ..functions.identifiers import export_cell, file_key
from ..functions.numbers import comma_amount, csv_cell, export_rate
from .ordered import indexed, numbered
from .parties import client, counterpart

#: Fixed value: the export's header line.
HEADER = "FECHA;SERIE;Nº FACTURA;NOMBRE CLI-PRO;NIF CLI-PRO;DESCRIPCION;BASE;%IVA;CUOTA IVA;%RECARGO EQUIVALENCIA;CUOTA RECARGO EQUIVALENCIA;%RETENCION;IMPORTE RETENCION;BASE EXENTA;TOTAL FACTURA"


def keyed(invoices: DataFrame) -> DataFrame:
    """invoices with ``file_nif``, ``file_kind`` (emitidas or recibidas) and ``file_name`` of the client."""
    book = F.col("book")
    return invoices.withColumns({
        "file_nif": file_key(client(book, F.col("issuer_nif"), F.col("receiver_nif"))), "file_kind": F.when(book == "ventas", "emitidas").otherwise("recibidas"),
        "client_name": client(book, F.col("issuer_name"), F.col("receiver_name")),
    })


def rows(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_index, row): a CSV row for each tax line; an invoice without lines has none."""
    return invoices.join(lines, "doc_id").select("doc_id", "line_index", _row().alias("row"))


def _row() -> Column:
    """The CSV row of an invoice with one of its lines."""
    book = F.col("book")
    cells = [
        day_first(F.coalesce("date", F.lit(""))), F.lit(""), F.coalesce("number", F.lit("")), F.coalesce(counterpart(book, F.col("issuer_name"), F.col("receiver_name")), F.lit("")),
        export_cell(F.coalesce(counterpart(book, F.col("issuer_nif"), F.col("receiver_nif")), F.lit(""))), F.upper(F.coalesce("concept", F.lit(""))), comma_amount(F.coalesce("base", F.lit(0))), export_rate(F.col("rate")),
        comma_amount(F.coalesce("tax", F.lit(0))), F.lit(""), F.lit(""), F.lit("0"), F.lit("0"), F.lit(""), comma_amount(F.coalesce("total", F.lit(0))),
    ]
    return F.concat_ws(";", *(csv_cell(F.coalesce(c, F.lit(""))) for c in cells))


def files(invoices: DataFrame, day: str) -> DataFrame:
    """(file_nif, file_kind, client_name, invoices, sequence, file): one row per file, numbered by id and kind, binary order.

    Files are numbered by ranges of ids, so that no task sees all of them.
    """
    name = F.min_by("client_name", F.when(F.coalesce("client_name", F.lit("")) != "", F.col("doc_id")))
    out = keyed(invoices).groupBy("file_nif", "file_kind").agg(F.coalesce(name, F.lit("")).alias("client_name"), F.count_distinct("doc_id").alias("invoices"))
    n = F.col("sequence")
    number = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return numbered(out, "file_nif", "file_kind", name="sequence").withColumn("file", F.concat_ws("_", F.lit(day), "file_nif", number, F.concat("file_kind", F.lit(".csv"))))


#: Lines of a leaf, and leaves of a node, of a file's digest.
FAN = 1000

END = "\r\n"
BOM = "\ufeff"


def _from_heads(placed: DataFrame, head: Column) -> DataFrame:
    """(file_nif, file_kind, line, row) of rows with ``part`` and ``index``: a file's lines are counted from its header, the last one before.

    A part that begins within a file takes the header's place from the parts before it.
    """
    begin = F.when(head, F.col("index"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    carried = placed.groupBy("part").agg(F.max(begin).alias("last")).select("part", F.max("last").over(before).alias("carried"))
    so_far = F.max(begin).over(W.partitionBy("part").orderBy("index").rowsBetween(W.unboundedPreceding, 0))
    out = placed.withColumn("begin", so_far).join(F.broadcast(carried), "part")
    return out.select("file_nif", "file_kind", (F.col("index") - F.coalesce("begin", "carried")).alias("line"), "row")


#: Lines of a file that one task may put in order.
ORDERED = 500_000


def file_lines(invoices: DataFrame, lines: DataFrame, ranges: int | None = None, most: int = ORDERED) -> DataFrame:
    """(file_nif, file_kind, line, row): the lines of all files, in order within each.

    Line 0 is the byte order mark with the header; a client and kind whose
    invoices have no lines have a file with nothing else. A file of at most
    ``most`` lines is ordered in one task. The lines of larger ones, and of all
    with ``ranges``, are ordered in ranges, wherever a file begins or ends, and
    stored, so that a client with a third of all lines is many ranges. The
    driver is told the names of the large ones, one in ``most`` lines at most.
    """
    names = ["file_nif", "file_kind"]
    tagged = keyed(invoices)
    day, n = F.coalesce("date", F.lit("")).alias("day"), F.coalesce("number", F.lit("")).alias("n")
    body = tagged.join(lines, "doc_id").select("doc_id", *names, day, n, "line_index", _row().alias("row"), F.lit(1).alias("head"))
    none = {"day": F.lit(""), "n": F.lit(""), "doc_id": F.lit(None).cast("long"), "line_index": F.lit(None).cast("int"), "row": F.lit(BOM + HEADER), "head": F.lit(0)}
    heads = tagged.select("file_nif", "file_kind").distinct().withColumns(none)
    order = ("file_nif", "file_kind", "head", "day", "n", "doc_id", "line_index")
    every = body.unionByName(heads).select(*order, "row")
    in_ranges = lambda some: _from_heads(indexed(some, *order, ranges=ranges), F.col("head") == 0)
    if ranges:
        return in_ranges(every)
    sizes = tagged.select("doc_id", *names).join(lines.groupBy("doc_id").agg(F.count("*").alias("c")), "doc_id").groupBy(*names).agg(F.sum("c").alias("c"))
    large = sizes.where(F.col("c") > most).select(*names).collect()
    place = (F.row_number().over(W.partitionBy(*names).orderBy(*order[2:])) - 1).cast("long")
    one_task = lambda some: some.select(*names, place.alias("line"), "row")
    if not large:
        return one_task(every)
    known = F.broadcast(invoices.sparkSession.createDataFrame(large, "file_nif string, file_kind string"))
    return one_task(every.join(known, names, "left_anti")).unionByName(in_ranges(every.join(known, names, "left_semi")))


def leaves(placed: DataFrame, fan: int = FAN) -> DataFrame:
    """(file_nif, file_kind, leaf, lines, bytes, digest) of each ``fan`` lines of :func:`file_lines`: the sha256 of their bytes, line ends included. Leaves one after the other are the file."""
    return _digested(_texts(placed, fan))


def _texts(placed: DataFrame, fan: int) -> DataFrame:
    part = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "row"))), lambda x: F.concat(x["row"], F.lit(END))), "")
    return placed.groupBy("file_nif", "file_kind", F.floor(F.col("line") / fan).alias("leaf")).agg(F.count("*").alias("lines"), part.alias("text"))


def _digested(texts: DataFrame) -> DataFrame:
    return texts.select("file_nif", "file_kind", "leaf", "lines", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


def file_digests(leaf: DataFrame, fan: int = FAN) -> DataFrame:
    """(file_nif, file_kind, lines, bytes, digest) of each file: its leaves' digests are joined ``fan`` at a time and digested, and these nodes' digests again.

    Parts of a file may so be digested wherever they lie; no value grows beyond
    ``fan`` digests up to ``fan`` x ``fan`` leaves.
    """
    keys = ["file_nif", "file_kind"]
    joined = lambda place: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "digest"))), lambda x: x["digest"]), ""), 256).alias("digest")
    sums = [F.sum(c).alias(c) for c in ("lines", "bytes")]
    nodes = leaf.groupBy(*keys, F.floor(F.col("leaf") / fan).alias("node")).agg(*sums, joined("leaf"))
    return nodes.groupBy(*keys).agg(*sums, joined("node"))


def write_parts(placed: DataFrame, path: str, ranges: int | None = None) -> None:
    """Files as text, one folder for each, in parts whose names are in order: parts one after the other are the file, byte for byte.

    Lines are dealt by ranges of file and line, so that a large file is many parts.
    """
    ranges = ranges or int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # never null, so that the writer has no cause to sort by the folder once more
    named = placed.select(F.coalesce(F.concat_ws("__", "file_nif", "file_kind"), F.lit("")).alias("file"), "line", "row")
    named.repartitionByRange(ranges, "file", "line").sortWithinPartitions("file", "line").select("row", "file").write.partitionBy("file").option("lineSep", END).mode("overwrite").text(path)


def read_parts(spark: SparkSession, path: str, ranges: int | None = None) -> DataFrame:
    """(file_nif, file_kind, line, row) of the files that :func:`write_parts` wrote. Readers of text take the mark off a part's first line; it is put back."""
    at = [F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    read = spark.read.schema("row string, file string").option("lineSep", END).text(path).select("file", "row", *at)
    head = F.ltrim(F.col("row"), F.lit(BOM)) == HEADER
    out = read.select(F.substring_index("file", "__", 1).alias("file_nif"), F.substring_index("file", "__", -1).alias("file_kind"), "name", "block", "id", F.when(head, F.lit(BOM + HEADER)).otherwise(F.col("row")).alias("row"))
    return _from_heads(indexed(out, "file_nif", "file_kind", "name", "block", "id", ranges=ranges), F.col("row") == BOM + HEADER)


def write_packed(placed: DataFrame, path: str, fan: int = FAN) -> None:
    """Files as archives, for millions of them: a member for each ``fan`` lines, named by file and place; members of a file one after the other are the file, byte for byte."""
    name = F.concat_ws("/", F.coalesce(F.concat_ws("__", "file_nif", "file_kind"), F.lit("")), F.lpad(F.col("leaf").cast("string"), 12, "0"))
    members = _texts(placed, fan).select(name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    members.write.format("ziparchive").mode("append").save(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """:func:`leaves` of the files that :func:`write_packed` wrote, of the bytes read."""
    file, text = F.substring_index("name", "/", 1), F.decode("content", "UTF-8")
    keys = [F.substring_index(file, "__", 1).alias("file_nif"), F.substring_index(file, "__", -1).alias("file_kind"), F.substring_index("name", "/", -1).cast("long").alias("leaf")]
    count = (F.size(F.split(text, END)) - 1).cast("long")
    return _digested(spark.read.format("ziparchive").load(path).select(*keys, count.alias("lines"), text.alias("text")))


def contents(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_nif, file_kind, content): the bytes-exact file as one value, for clients of ordinary size; :func:`file_lines` has no such bound."""
    there = F.when(F.col("line_index").isNotNull(), _row())
    day, n = F.coalesce("date", F.lit("")).alias("day"), F.coalesce("number", F.lit("")).alias("n")
    each = keyed(invoices).join(lines, "doc_id", "left").select("doc_id", "file_nif", "file_kind", day, n, "line_index", there.alias("row"))
    body = F.sort_array(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("day", "n", "doc_id", "line_index", "row"))))
    text = F.array_join(F.concat(F.array(F.lit(HEADER)), F.transform(body, lambda x: x["row"])), END)
    return each.groupBy("file_nif", "file_kind").agg(F.concat(F.lit(BOM), text, F.lit(END)).alias("content"))


def warnings(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: invoices and files with no account, no date or number, and no tax lines."""
    has = lines.select("doc_id").distinct().withColumn("has", F.lit(True))
    both = keyed(invoices).join(has, "doc_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    tests = {"account": empty("account"), "date_or_number": empty("date") | empty("number"), "lines": F.col("has").isNull()}
    file = F.concat_ws("__", "file_nif", "file_kind")
    return both.agg(*(x for k, t in tests.items() for x in (F.count_if(t).alias(f"no_{k}"), F.count_distinct(F.when(t, file)).alias(f"no_{k}_files"))))


def preview(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_index, base, rate_label, total): as rows, but an invoice without lines has one, with its total as base; a zero rate is EXENTA."""
    both = invoices.select("doc_id", "total").join(lines.select("doc_id", "line_index", "base", "rate"), "doc_id", "left")
    label = F.when(F.col("line_index").isNull(), "").when(F.col("rate") == 0, "EXENTA").otherwise(export_rate(F.col("rate")))
    return both.select("doc_id", F.coalesce("line_index", F.lit(0)).alias("line_index"), F.coalesce("base", F.when(F.col("line_index").isNull(), F.col("total"))).alias("base"), label.alias("rate_label"), "total")


def ledger_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_index, debit, credit): base and tax are debited."""
    zero = F.lit(0).cast("decimal(18,2)")
    return lines.select("doc_id", "line_index", (F.coalesce("base", zero) + F.coalesce("tax", zero)).cast("decimal(18,2)").alias("debit"), zero.alias("credit"))
