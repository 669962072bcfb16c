"""What a reviewer found on larger tables, on small rows that show the same."""

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import assemble, extraction, listing
from ledgerloom.plans import party_queries
from ledgerloom.sources import folders, readers, sinks
from ledgerloom.streaming import keyed


def test_a_name_listed_twice_is_one_part(spark):
    rows = [("compras", "F-100000__1of2.pdf", "done"), ("compras", "F-100000__2OF2.PDF", None), ("ventas", "F-100000__1of2.pdf", None)]
    files = spark.createDataFrame(rows + rows[:2], "book string, name string, status string")
    asked = spark.createDataFrame([("compras", "F-100000.PDF")] * 2, "book string, name string")
    got = [tuple(r) for r in listing.recovered_children(files, asked).collect()]
    assert got == [("compras", "F-100000.PDF", 2, "F-100000__1of2,F-100000__2OF2", "done,uploaded")] * 2


def test_children_are_deduplicated_by_spark(spark, tmp_path):
    stream = spark.readStream.schema("doc_id long, seq long, book string, sha256_file string, split_into array<long>").parquet(str(tmp_path))
    plan = keyed.children(stream)._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan


class Counted(dict):
    """A state that counts how often it is asked."""

    calls = 0

    def exists(self):
        return bool(self)

    def containsKey(self, k):
        self.calls += 1
        return k in self

    def getValue(self, k):
        self.calls += 1
        return self.get(k)

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v

    def iterator(self):
        return iter(list(self.items()))


class Single:
    value = None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


def test_state_is_asked_by_part_not_by_folder():
    state = Counted()
    handle = SimpleNamespace(getValueState=lambda *_: Single(), getMapState=lambda *_: state)
    holders = keyed.Holders()
    holders.init(handle)
    rows = pd.DataFrame({"folder": [f"f{k}" for k in range(3000)], "finalized_seq": range(3000), "version": 0, "status": "done", "rejected": None})
    for version, status in enumerate(["done", "cancelled"]):
        out = pd.concat(holders.handleInputRows(("h",), iter([rows.assign(version=version, status=[status, *["done"] * 2999])]), None))
        assert set(out["duplicate_of"].dropna()) == {f"f{version}"} and len(out) == 3000
    assert state.calls <= 6 * keyed.FOLDER_PARTS


def test_audit_records_of_a_day_are_one_file(spark, tmp_path):
    rows = spark.range(400).repartition(4).select(F.lit("compras").alias("book"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 2 * 86400).alias("ts"), "id")
    sinks.append_audit(rows, str(tmp_path / "audit"))
    assert len([*(tmp_path / "audit").rglob("*.json")]) == 2


def test_audited_days_are_one_file(spark, tmp_path):
    rows = spark.range(400).repartition(4).selectExpr("'k' || id AS key", "'compras' AS book", "'2026-01-0' || (id % 2 + 1) AS ts", "'{}' AS payload")
    paths = str(tmp_path / "audit"), str(tmp_path / "refused")
    assert sinks.audit(rows.where("key < 'k2'"), *paths)[:3] == (112, 0, 0)
    assert sinks.audit(rows, *paths)[:3] == (288, 112, 0)
    assert len([*(tmp_path / "audit").rglob("*.json")]) == 4


def test_packed_sidecars(spark, tmp_path):
    folders.register(spark)
    path = str(tmp_path / "packed")
    rows = [("a", '{"status": "done"}'), ("b", "{"), ("c", None), ("d", "[1]"), ("é f", '{"x": "ñ"}')] + [(f"n{k}", "{}") for k in range(60)]
    df = spark.createDataFrame(rows, "folder string, content string")
    folders.pack(df, path, 3)
    folders.pack(spark.createDataFrame([("a", '{"status": "again"}'), ("c", None), ("é f", None)], df.schema), path, 3)
    got = {r["folder"]: (r["state"], r["content"]) for r in spark.read.format("packedsidecars").load(path).collect()}
    assert got == {"a": ("ok", '{"status": "again"}'), "b": ("corrupt", None), "c": ("absent", None), "d": ("corrupt", None), "é f": ("ok", rows[4][1])} | {f"n{k}": ("ok", "{}") for k in range(60)}
    assert len([*tmp_path.rglob("*")]) <= 1 + 6
    with pytest.raises(Exception, match="another number"):
        folders.pack(df, path, 4)


def test_module_states_move_a_row_for_each_document(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    some = spark.createDataFrame([(1, "fiscal", False), (1, "fiscal", True), (1, "cliente", False), (2, "other", True)], "doc_id long, module string, corrupt boolean")
    out = assemble.module_states(docs, some)
    want = {(d, m): "pendiente" for d in (1, 2) for m in assemble.MODULES} | {(1, "fiscal"): "error", (1, "cliente"): "ok"}
    assert {(r["doc_id"], r["module"]): r["state"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_wide_documents_shuffle_each_value_once(spark):
    docs = spark.createDataFrame([(1,), (2,), (2,), (None,), (4,)], "doc_id long")
    values = [(1, "fiscal", "total_euros", "10"), (1, "fiscal", "total_euros", "9"), (1, "semantica", "total_euros", "99"), (1, "cliente", "nif_cliente", None), (2, "identidad", "nif_entidad", "A"), (2, "identidad", "other", "x"), (2, None, "concepto", "y"), (3, "cliente", "nombre_cliente", "no such document"), (None, "fiscal", "total_euros", "5")]
    some = spark.createDataFrame([(*v, "auto") for v in values], "doc_id long, module string, field string, value string, verdict string")
    states = assemble.module_states(docs, some.select("doc_id", "module", F.lit(False).alias("corrupt")))
    out = assemble.wide_documents(docs, some)
    long = assemble.wide(assemble.routed_fields(docs, some, states))
    assert out.schema.names == long.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in long.schema]
    assert sorted(map(str, out.collect())) == sorted(map(str, long.collect()))
    got = {r["doc_id"]: {k: v for k, v in r.asDict().items() if v is not None and k != "doc_id"} for r in out.collect()}
    assert got == {1: {"total_euros": "9"}, 2: {"nif_entidad": "A"}, None: {}, 4: {}}


def test_flt04_has_no_join_and_one_shuffle(spark):
    plan = party_queries.flt04_wide_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_files_are_found_by_the_best_name_of_each_part(spark):
    docs = spark.createDataFrame([("7", "a_7"), ("71", "a_71"), ("b1", "a_b1"), ("9", "b_9"), ("8", "a_8"), ("é2", "b_é2")], "doc_id string, folder string")
    names = [("a", "x71.pdf"), ("a", "7.pdf"), ("a", "71.PNG"), ("a", "y_71b1.pdf"), ("a", "77777.tif"), ("a", "9.pdf"), ("a", "8.docx"), ("b", "né2.jpg"), ("b", "none.pdf")]
    origins = spark.createDataFrame([("71", "8.docx"), ("9", "gone.pdf")], "doc_id string, name string")
    out = readers.original_file(docs, origins, spark.createDataFrame(names, "book string, name string"))
    assert {r["doc_id"]: (r["name"], r["found"]) for r in out.collect()} == {"7": ("7.pdf", "stem"), "71": ("8.docx", "origin"), "b1": ("y_71b1.pdf", "part"), "9": (None, None), "8": (None, None), "é2": ("né2.jpg", "part")}
    # a row for each part, not for each part and name, is what goes to the documents
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    parts = plan[plan.index("explode(filter(") :]
    assert "Aggregate [book" in plan[: plan.index("explode(filter(")] and "letters" in parts


def test_final_records_are_written_compressed(spark, tmp_path):
    docs = spark.createDataFrame([(k, "ventas", "auto") for k in range(300)], "doc_id long, libro string, decision string")
    cells = docs.select("doc_id", F.explode(F.array(*map(F.lit, assemble.ROUTES))).alias("field"), F.lit("v").alias("value"), F.lit(True).alias("edited"))
    out = sinks.final_records(docs, cells, docs.select("doc_id", F.lit("a;b\n").alias("csv")))
    sinks.write_final(out, str(tmp_path / "final"))
    size = sum(p.stat().st_size for p in (tmp_path / "final").glob("part-*"))
    assert 0 < size < 100 * 300
    assert spark.read.schema(out.schema).json(str(tmp_path / "final")).exceptAll(out).count() == 0


def test_an_answer_is_not_written_again_to_see_whether_it_is_empty(spark):
    assert extraction.FIELDS == ["nif_entidad", "nombre_entidad", "numero_factura", "fecha_expedicion", "nif_receptor", "nombre_receptor", "total_factura", "lineas_fiscales"]
    rows = [(1, '{"nif_entidad": "A"}'), (2, "{}"), (3, "{broken"), (4, None), (5, '{"lineas_fiscales": []}'), (6, '{"nif_entidad": null}'), (7, '{"other": 1}'), (8, '{"total_factura": "1.00"}')]
    files = spark.createDataFrame(rows, "doc_id long, answer string").select("*", F.lit("f").alias("archivo"), F.lit(1).alias("paginas"), F.lit("c").alias("carpeta"), F.lit("").alias("text"))
    out = extraction.extracted(files)
    assert {r["doc_id"] for r in out.where("error_extraccion is null").collect()} == {1, 5, 8}
    assert "to_json" not in out._jdf.queryExecution().optimizedPlan().toString()
