"""Operators on hand-made rows: rule tables, edge cases, sinks and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, identifiers, numbers, texts
from ledgerloom.operators import candidates, duplicates, events, export, fiscal, ordered, parties, verdicts
from ledgerloom.sources import dimensions, readers, sinks
from ledgerloom.streaming import status


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("12.5", "12.500000"), ("-3", "3.000000"), ("% 4", "4.000000"), ("N/A", None), ("", None), ("12,5", None), ("x", None), (None, None)])
def test_safe_decimal(spark, raw, want):
    got = value(spark, numbers.safe_decimal(F.lit(raw).cast("string")))
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize(("raw", "want"), [("1.250,50", 1250.5), ("131,00", 131.0), ("7", 7.0), ("x", 0.0), (None, 0.0)])
def test_spanish_number(spark, raw, want):
    assert value(spark, numbers.spanish_number(F.lit(raw).cast("string"))) == want


def test_the_two_number_readers_differ(spark):
    assert value(spark, numbers.safe_float(F.lit("1.250,50"))) == 0.0


@pytest.mark.parametrize(("raw", "kind", "ok"), [("12345678Z", "nif", True), ("12345678A", "nif", False), ("B12345674", "cif", True), ("B1234567D", "cif", True), ("B12345678", "cif", False), ("X1234567L", "nie", True), ("", "desconocido", False), (None, "desconocido", False), ("12", "desconocido", False)])
def test_tax_ids(spark, raw, kind, ok):
    c = F.lit(raw).cast("string")
    assert value(spark, F.coalesce(identifiers.kind(c), F.lit("desconocido"))) == kind
    assert value(spark, identifiers.is_valid(c)) is ok


@pytest.mark.parametrize(("raw", "want"), [("2026-3-5", "2026-03-05"), ("05/03/2026", "2026-03-05"), ("5.3.49", "2049-03-05"), ("5-3-50", "1950-03-05"), ("05032026", "2026-03-05"), ("15 de marzo de 2026", "2026-03-15"), ("3 Mar 2026", "2026-03-03"), ("31/02/2026", None), ("soon", None), (None, None)])
def test_dates(spark, raw, want):
    assert value(spark, dates.iso_date(F.lit(raw).cast("string"))) == want


def test_invoice_number_and_hash(spark):
    assert value(spark, texts.invoice_number(F.lit(" f-0001 a07"))) == "F-1A07"
    assert value(spark, texts.fiscal_hash(F.lit("a"), F.lit("F-1"), F.lit("d"))) == value(spark, texts.fiscal_hash(F.lit(" A "), F.lit("f-01"), F.lit("d ")))
    assert value(spark, texts.fiscal_hash(F.lit("a"), F.lit(""), F.lit("d"))) is None


def test_context_windows_overlap(spark):
    assert value(spark, F.size(texts.context_windows(F.lit("nif: cif: B12345674"), texts.ID_CONTEXT, 20))) == 2


LINES = [
    # base, rate, tax, total, kind, verdict
    ("100", "21", "21", "121", "gravada", "auto"), ("100", "21", "21.02", "121", "gravada", "auto"), ("100", "21", "22", "121", "gravada", "block"), ("100", None, None, "100", "exenta", "warn"),
    ("100", None, None, "130", "exenta", "block"), ("100", "0", None, "100", "tipo_cero", "auto"), ("100", "x", "1", "101", "invalida", "block"), ("x", "21", "1", None, "gravada", "block"), ("100", "21", None, None, "gravada", "auto"),
]


def tax_lines(spark, rows):
    schema = "doc_id long, line_index int, base_raw string, rate_raw string, tax_raw string, total_raw string"
    df = spark.createDataFrame([(d, k, *r) for k, (d, *r) in enumerate(rows)], schema)
    return df.withColumns({f"{c}_confidence": F.lit("0.9").cast("decimal(5,4)") for c in ("base", "rate", "tax", "total")})


def test_line_rules(spark):
    out = fiscal.check_lines(tax_lines(spark, [(1, *r[:4]) for r in LINES])).orderBy("line_index").collect()
    assert [(r["kind"], r["line_verdict"]) for r in out] == [r[4:] for r in LINES]


def test_document_rules(spark):
    docs = spark.createDataFrame([(1, "121"), (2, "300"), (3, "5"), (4, "N/A")], "doc_id long, total_raw string")
    lines = fiscal.check_lines(tax_lines(spark, [(1, "100", "21", "21", "121"), (2, "100", "21", "21", "121"), (4, "1", "21", "0.21", None)]))
    got = {r["doc_id"]: (r["f006"], r["f007"], r["verdict"]) for r in fiscal.check_documents(docs, lines).collect()}
    assert got == {1: ("ok", "ok", "auto"), 2: ("ok", "fail", "block"), 3: ("fail", "no_ejecutada", "pendiente"), 4: ("ok", "no_ejecutada", "pendiente")}


def test_rate_corrector(spark):
    lines = tax_lines(spark, [(1, "100", "20", "21", "121"), (2, "100", "21", "10", "110"), (3, "100", "17", "15", "115"), (4, "0", "17", "1", "1")])
    assert [(r["corrected"], r["rate_raw"]) for r in fiscal.correct_rates(lines).orderBy("doc_id").collect()] == [(True, "21.00"), (False, "21"), (False, "17"), (False, "17")]


def test_two_verdict_orders(spark):
    rows = spark.createDataFrame([("warn",), ("pendiente",)], "v string")
    assert rows.agg(verdicts.worst(F.col("v"), verdicts.CHECKING)).first()[0] == "pendiente"
    assert rows.agg(verdicts.worst(F.col("v"), verdicts.ASSEMBLING)).first()[0] == "warn"
    assert rows.where("false").agg(verdicts.worst(F.col("v"))).first()[0] == "auto"


def log(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq long, status string, action string")


def test_renamed_documents_are_neither_done_nor_closed(spark):
    e = log(spark, [(1, 1, "processing", None), (1, 2, "done", None), (1, 3, "renamed", None)])
    assert [r["status"] for r in events.unfinished(events.last_status(e)).collect()] == ["renamed"]


def test_transitions_warn_and_unknown_states_fail(spark):
    e = log(spark, [(1, 1, "uploaded", None), (1, 2, "confirmed", None), (1, 3, "lost", None)])
    assert [(r["allowed"], r["known"]) for r in events.transitions(e).orderBy("seq").collect()] == [(True, True), (False, True), (False, False)]


def test_old_confirmation(spark):
    e = log(spark, [(1, 1, "done", "confirmed"), (1, 2, "renamed", None), (2, 1, "done", None)])
    assert {r["doc_id"]: r["confirmed"] for r in events.confirmed(e).collect()} == {1: True, 2: False}


def test_candidates_prefer_confidence_then_source(spark):
    rows = [(1, "f", 1, "a", 0.9, None, "fallback"), (1, "f", 2, "b", 0.9, True, "fase2_ocr"), (1, "f", 3, "c", 0.99, False, "sistema"), (1, "g", 4, "", 0.9, None, "sistema")]
    df = spark.createDataFrame(rows, "doc_id long, field string, pos int, value string, confidence double, valid boolean, source string").withColumn("confidence", F.col("confidence").cast("decimal(5,4)"))
    got = {r["field"]: (r["value"], r["verdict"], r["ask"]) for r in candidates.resolve(df).collect()}
    assert got == {"f": ("b", "auto", True), "g": (None, "block", True)}


def test_duplicates_skip_the_inactive(spark):
    rows = [("a", "h", 1, "cancelled", False), ("b", "h", 2, "done", True), ("c", "h", 3, "done", False), ("d", "h", 4, "done", False), ("e", None, 5, "done", False)]
    df = spark.createDataFrame(rows, "folder string, fiscal_hash string, finalized_seq long, status string, rejected boolean")
    got = {r["folder"]: r["duplicate_of"] for r in duplicates.blocked_duplicates(df).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": "c", "e": None}


def test_master_merge(spark):
    s = "nif string, nombre string, fecha_alta string, documentos int, ultima string, libros array<string>, tipos array<string>"
    disk = spark.createDataFrame([("A", "", "2020", 5, "2026-04-28", ["compras"], ["cliente"])], s)
    memory = spark.createDataFrame([("A", "M", "2021", 3, "2026-03-15", ["ventas", "compras"], None), ("B", "N", None, 1, None, [], [])], s)
    got = {r["nif"]: r for r in parties.merge_masters(disk, memory).collect()}
    assert (got["A"]["documentos"], got["A"]["ultima"], got["A"]["libros"], got["A"]["nombre"], got["A"]["fecha_alta"]) == (5, "2026-04-28", ["compras", "ventas"], "M", "2020")
    assert got["B"]["documentos"] == 1


def invoices(spark):
    schema = "doc_id long, book string, date string, number string, issuer_nif string, issuer_name string, receiver_nif string, receiver_name string, concept string, account string, total decimal(18,2)"
    return spark.createDataFrame([(1, "ventas", "2026-01-02", "F;1", "A1", "Us", "B2", 'Q "x"', "c", "700", None), (2, "compras", "2026-01-03", "", "B2", "They", "--", "", "c", None, None)], schema)


def test_invoices_without_lines_have_no_row_but_a_preview(spark):
    lines = spark.createDataFrame([(1, 0, 10, 0, 0)], "doc_id long, line_index int, base int, rate int, tax int").select("doc_id", "line_index", *(F.col(c).cast("decimal(14,2)") for c in ("base", "rate", "tax")))
    rows = export.rows(invoices(spark), lines).collect()
    assert [r["row"] for r in rows] == ['02/01/2026;;"F;1";"Q ""x""";B2;C;10,00;9;0,00;;;0;0;;0,00']
    assert export.preview(invoices(spark), lines).count() == 2
    assert [r["file"] for r in export.files(invoices(spark), "20260101").orderBy("sequence").collect()] == ["20260101_A1_01_emitidas.csv", "20260101_SIN_CLIENTE_02_recibidas.csv"]
    assert export.warnings(invoices(spark), lines).first().asDict() == {"no_account": 1, "no_account_files": 1, "no_date_or_number": 1, "no_date_or_number_files": 1, "no_lines": 1, "no_lines_files": 1}


def test_artifacts_tell_corrupt_from_absent(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": 1}))
    (tmp_path / "b.json").write_text("{broken")
    got = readers.artifacts(spark, str(tmp_path), "doc_id long").select("doc_id", "corrupt").collect()
    assert sorted((r["doc_id"] or 0, r["corrupt"]) for r in got) == [(0, True), (1, False)]


def test_scan_folder(spark, tmp_path):
    for n in ("b.PDF", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.scan_folder(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PDF"]


def test_yaml_dimension(spark):
    pytest.importorskip("yaml")
    df = dimensions.load_yaml(spark, "conceptos:\n  seguro: {cuenta: '625'}\n  otro: 3\n", "conceptos", "concepto string, cuenta string, pos int")
    assert [tuple(r) for r in df.collect()] == [("seguro", "625", 0)]
    assert dimensions.load_yaml(spark, None, "conceptos", "concepto string").count() == 0


def test_audit_is_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([("compras", "2026-01-02 23:30:00", 1)], "book string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        sinks.append_audit(rows, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).where("book = 'compras' and fecha = '2026-01-02'").count() == 2


def bulk(spark):
    """Invoices of which one client has a third, one has none with lines, and one number and day are of many."""
    own = lambda k: "B1" if k % 3 == 0 else f"B{k % 40}"
    rows = [(k, "ventas" if k % 2 else "compras", own(k), f"S {k % 5}", own(k), f"R;{k % 4}", f"2024-01-{k % 9 + 1:02d}" if k % 7 else None, f"F{k % 10}" if k % 11 else None, "a \"b\"\nc", 12) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, book string, issuer_nif string, issuer_name string, receiver_nif string, receiver_name string, date string, number string, concept string, total int")
    lines = spark.createDataFrame([(k, j, 10 * k + j, 21, 2) for k in range(400) if k % 40 != 2 for j in range(k % 4 + 1)], "doc_id long, line_index int, base int, rate int, tax int")
    return docs.withColumn("total", F.col("total").cast("decimal(18,2)")), lines.select("doc_id", "line_index", *(F.col(c).cast("decimal(14,2)") for c in ("base", "rate", "tax")))


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_parts_one_after_the_other_are_the_file(spark, tmp_path, ranges):
    docs, lines = bulk(spark)
    want = {f"{r['file_nif']}__{r['file_kind']}": r["content"] for r in export.contents(docs, lines).collect()}
    placed = export.file_lines(docs, lines, ranges)
    export.write_parts(placed, str(tmp_path / "out"), ranges)
    folders = {p.name.removeprefix("file="): p for p in (tmp_path / "out").glob("file=*")}
    got = {k: b"".join(f.read_bytes() for f in sorted(p.glob("part-*"))).decode() for k, p in folders.items()}
    assert got == want
    assert any(c.count("\r\n") == 1 for c in want.values()) and all(c.startswith("\ufeffFECHA;") for c in want.values())
    if ranges == 40:
        assert len([*folders["B1__emitidas"].glob("part-*")]) > 2
    again = export.read_parts(spark, str(tmp_path / "out"), ranges)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, placed.collect()))


def test_digests_of_parts_are_of_the_file(spark):
    docs, lines = bulk(spark)
    leaf = export.leaves(export.file_lines(docs, lines, 5), fan=6)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in export.contents(docs, lines).collect():
        parts = [x + "\r\n" for x in r["content"].split("\r\n")[:-1]]
        each = ["".join(parts[k : k + 6]) for k in range(0, len(parts), 6)]
        nodes = [sha("".join(map(sha, each[k : k + 6]))) for k in range(0, len(each), 6)]
        want[r["file_nif"], r["file_kind"]] = (len(parts), len(r["content"].encode()), sha("".join(nodes)))
    got = {(r["file_nif"], r["file_kind"]): (r["lines"], r["bytes"], r["digest"]) for r in export.file_digests(leaf, fan=6).collect()}
    assert got == want


def test_numbers_of_ids_with_one_prefix(spark):
    rows = spark.createDataFrame([(f"B000{k % 90:03d}", k % 2) for k in range(300)], "a string, b int")
    got = ordered.numbered(rows, "a", "b").collect()
    assert sorted(r["place"] for r in got) == list(range(1, 301))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((r["a"], r["b"]) for r in got)
    assert ordered.indexed(rows, "a", "b", ranges=6).groupBy("part").count().count() > 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "uploaded", None), (2, 2, "processing", None), (1, 3, "confirmed", None), (2, 4, "done", None), (2, 5, "confirmed", None)]
    e = log(spark, rows)
    for part, condition in (("a", "seq <= 2"), ("b", "seq > 2")):
        e.where(condition).coalesce(1).write.parquet(str(tmp_path / "in" / part))
    stream = status.read_events(spark, str(tmp_path / "in" / "*"), "doc_id long, seq long, status string, action string")
    q = status.current_status(stream).writeStream.outputMode("complete").format("memory").queryName("s1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("s1").collect())) == sorted(map(tuple, events.last_status(e).collect()))


def test_stream_master_updates(spark, tmp_path):
    s = "nif string, nombre string, fecha_alta string, documentos int, ultima string, libros array<string>, tipos array<string>"
    held = {"m": spark.createDataFrame([("A", "N", "2020", 2, "2026-01-01", ["compras"], ["cliente"])], s)}
    spark.createDataFrame([("A", "X", "2021", 3, "2026-02-01", ["ventas"], [])], s).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s).parquet(str(tmp_path / "in"))
    status.master_updates(stream, lambda: held["m"], lambda df: held.update(m=spark.createDataFrame(df.collect(), s)), str(tmp_path / "state")).awaitTermination()
    r = held["m"].first()
    assert (r["nombre"], r["documentos"], r["libros"]) == ("N", 3, ["compras", "ventas"])


def test_export_sequences_are_never_cut(spark):
    rows = [(k, "ventas", f"B{k:08d}", "A", "X", "B") for k in range(1, 121)]
    got = export.files(spark.createDataFrame(rows, "doc_id long, book string, issuer_nif string, issuer_name string, receiver_nif string, receiver_name string"), "20260101").collect()
    assert {r["file"].split("_")[2] for r in got} == {f"{k:02d}" for k in range(1, 121)}


def test_streams_of_shuffled_files_equal_the_log(spark, monkeypatch):
    from ledgerloom.plans import scalar_queries

    names = sorted(events.TRANSITIONS)
    rows = [(k % 5, k, names[k * k % 11 % len(names)]) for k in range(1, 61)]
    log = spark.createDataFrame(spark.sparkContext.parallelize(rows[::-1], 6), "doc_id long, seq long, status string")
    monkeypatch.setattr(scalar_queries, "view", lambda *_: log)
    last, want = {}, set()
    for k, seq, now in rows:
        if now not in events.TRANSITIONS.get(last.get(k) or "", ()):
            want.add((k, seq, last.get(k), now))
        last[k] = now
    got = scalar_queries.str02_stream_violations(spark, None).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {(r["doc_id"], r["status"]) for r in scalar_queries.str01_stream_last_status(spark, None).collect()} == set(last.items())
