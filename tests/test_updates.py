"""Status files, audit records and versions on odd rows."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import versions
from ledgerloom.operators import status_files
from ledgerloom.sources import sinks


def test_status_files_equal_updates_one_by_one(spark):
    rng = random.Random(1)
    values = [None, 1, 2.5, "x", 'a"b', [1, {"z": 2}], {"in": {"ner": 1}}, True, "é\n"]
    rows, want, bad = [], {k: {} for k in range(5)}, dict.fromkeys(range(5), 0)
    for seq in range(200):
        k = rng.randrange(5)
        if rng.random() < 0.2:
            rows.append((k, seq, rng.choice([None, "", "{x", "[1]", "3", '"s"', '{"a":1,"a":2}'])))
            bad[k] += 1
        else:
            patch = {rng.choice(["a", "b", 'q"', "é", "with space"]): rng.choice(values) for _ in range(rng.randint(0, 3))}
            rows.append((k, seq, json.dumps(patch, ensure_ascii=rng.random() < 0.5)))
            want[k].update(patch)
    rng.shuffle(rows)
    stored = spark.createDataFrame([(0, '{"a": 9, "kept": 1}'), (7, '{"old": [1]}'), (8, "broken")], "doc_id long, status string")
    got = {r["doc_id"]: r for r in status_files.merged(spark.createDataFrame(rows, "doc_id long, seq long, patch string"), stored).collect()}
    want[0] = {"a": 9, "kept": 1} | want[0]
    assert {k: json.loads(got[k]["status"]) for k in range(5)} == want
    assert {k: got[k]["bad"] for k in range(5)} == bad
    assert json.loads(got[7]["status"]) == {"old": [1]} and got[8]["status"] == "{}" and got[8]["bad"] == 1


RECORDS = "key string, book string, ts string, payload string, reason string"


def test_audit_refuses_bad_records_and_writes_others_once(spark, tmp_path):
    good = [(f"k{k}", "compras" if k % 2 else "ventas", f"2026-01-0{k % 3 + 1} 10:00:00", json.dumps({"n": k}), "mine") for k in range(20)]
    bad = [(None, "b", "2026-01-01", "{}", None), ("x", " ", "2026-01-01", "{}", None), ("y", "b", "noon", "{}", None), ("z", "b", "2026-01-01", "{", None), ("w", "b", "2026-01-01", None, None)]
    path, refused = str(tmp_path / "audit"), str(tmp_path / "refused")
    some = spark.createDataFrame(good[:8], RECORDS)
    assert sinks.audit(some, path, refused) == (8, 0, 0, None)
    assert sinks.audit(spark.createDataFrame(good + good[:3] + bad, RECORDS), path, refused) == (12, 8, 5, None)
    assert sinks.audit(spark.createDataFrame(good, RECORDS), path, refused) == (0, 20, 0, None)
    assert {r["key"] for r in spark.read.json(path).collect()} == {g[0] for g in good} and spark.read.json(path).count() == 20
    assert sorted(r["reason"] for r in spark.read.json(refused).collect()) == ["book", "key", "payload", "payload", "time"]


def test_audit_never_fails_the_run(spark, tmp_path):
    (tmp_path / "file").write_text("not a folder")
    out = sinks.audit(spark.createDataFrame([("k", "b", "2026-01-01", "{}", None)], RECORDS), str(tmp_path / "file" / "audit"), str(tmp_path / "refused"))
    assert out.written == 0 and out.error


def test_versions_are_ordered(spark):
    def key(v):
        base, _, suffix = v.partition("-")
        try:
            return (*(int(p) for p in (base.split(".") + ["", "", ""])[:3]), not suffix)
        except ValueError:
            return None

    names = ["0.0.0-dev", "0.2.5-rc.1", "0.2.5-rc.2", "0.2.5", "0.2.10", "0.10.0", "1.0.0-alpha", "1.0.0", "1.0.0.9", "1.0", "v1.0.0", "", None, "1.0.x", "2.0.0-", "10.0.0"]
    rows = [*itertools.product(names, names)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", versions.is_newer(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        a, b = r["a"], r["b"]
        want = bool(a and b) and (key(a) > key(b) if key(a) and key(b) else a != b)
        assert r["n"] == want, r


@pytest.mark.parametrize(("raw", "want"), [("1.2.3", (1, 2, 3, True)), ("1.2.3-rc.1", (1, 2, 3, False)), ("1.2", None), (None, None)])
def test_version_keys(spark, raw, want):
    got = spark.range(1).select(versions.version_key(F.lit(raw).cast("string")).alias("k")).first()["k"]
    assert (tuple(got) if got else None) == want
