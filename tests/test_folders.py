"""Sidecars and archives, written in tasks and read again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import folders


def test_sidecars(spark, tmp_path):
    folders.register(spark)
    rows = [("a", '{"status": "done"}'), ("b", "{"), ("c", None), ("d", "[1]"), ("é f", '{"x": "ñ"}')]
    df = spark.createDataFrame(rows, "folder string, content string")
    for _ in range(2):  # a second time replaces
        df.write.format("sidecars").mode("append").save(str(tmp_path))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "notes.json").write_text("{}")
    (tmp_path / "b2").mkdir()
    (tmp_path / "b2" / ".state.json").write_bytes(b'{"x": "\xff"}')
    (tmp_path / "file.txt").write_text("x")
    got = {r["folder"]: (r["state"], r["content"]) for r in spark.read.format("sidecars").load(str(tmp_path)).collect()}
    assert got == {"a": ("ok", rows[0][1]), "b": ("corrupt", None), "c": ("absent", None), "d": ("corrupt", None), "é f": ("ok", rows[4][1]), "e": ("absent", None), "b2": ("corrupt", None)}
    assert not [*tmp_path.rglob("*.tmp")]
    assert spark.read.format("sidecars").option("name", "notes.json").load(str(tmp_path)).where("state = 'ok'").count() == 1


def test_sidecars_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FOLDERS", 2)
    for k in range(5):
        (tmp_path / f"f{k}").mkdir()
    assert [p.names for p in folders.SidecarReader(str(tmp_path), ".state.json").partitions()] == [("f0", "f1"), ("f2", "f3"), ("f4",)]
    assert folders.SidecarReader(str(tmp_path / "f0"), ".state.json").partitions() == [folders.Folders(())]


def test_archives(spark, tmp_path):
    folders.register(spark)
    rows = [(f"f{k}.csv", bytes([k]) * (1000 * k)) for k in range(9)] + [("dir/é.csv", "ñ\r\n".encode())]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    df.write.format("ziparchive").mode("append").save(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*.zip"))
    assert 1 < len(files) <= 4 and not [p for p in (tmp_path / "out").iterdir() if p.suffix != ".zip"]
    found = {}
    for f in files:  # each is whole
        with zipfile.ZipFile(io.BytesIO(f.read_bytes())) as archive:
            assert archive.testzip() is None
            found |= {n: archive.read(n) for n in archive.namelist()}
    assert found == dict(rows)
    read = spark.read.format("ziparchive").load(str(tmp_path / "out"))
    assert {r["name"]: bytes(r["content"]) for r in read.collect()} == dict(rows)
    df.limit(1).write.format("ziparchive").mode("overwrite").save(str(tmp_path / "out"))
    assert spark.read.format("ziparchive").load(str(tmp_path / "out")).count() == 1


def test_an_archive_that_fails_leaves_nothing(spark, tmp_path):
    folders.register(spark)
    bad = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("ziparchive").mode("append").save(str(tmp_path / "out"))
    assert not [*(tmp_path / "out").rglob("*.zip")]
