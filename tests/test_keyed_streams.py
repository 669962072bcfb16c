"""Keyed streams that take events in any order, against what the batch operators make of all events at once."""

import random

import pytest

from ledgerloom import scratch
from ledgerloom.operators import duplicates, events
from ledgerloom.streaming import keyed


def played(spark, tmp_path, rows, schema, operator, batches, seed):
    """The changes of an operator over rows in an order of their own, a file and a trigger for each batch; some come twice."""
    rng = random.Random(seed)
    rows = list(rows)
    rng.shuffle(rows)
    own = keyed.session_for(spark, 2)
    for k in range(batches):
        again = rng.sample(rows, min(3, len(rows)))
        spark.createDataFrame(rows[k::batches] + again, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    writer = operator(stream).writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect()))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def last(changes, *keys):
    found = {}
    for r in changes:
        k = tuple(r[c] for c in keys)
        if k not in found or found[k]["change"] < r["change"]:
            found[k] = r
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_in_any_order_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = [*events.TRANSITIONS][1:] + ["lost"]
    rows = [(rng.randrange(6), s, rng.choice(names)) for s in range(160)] + [(9, 1000, None)]
    want = {(r["doc_id"], r["seq"]): (r["previous_status"], r["status"], r["allowed"]) for r in events.transitions(spark.createDataFrame(rows, "doc_id long, seq long, status string")).collect()}
    got = last(played(spark, tmp_path, rows, "doc_id long, seq long, status string", keyed.steps, 5, seed), "doc_id", "seq")
    assert {k: (r["previous_status"], r["status"], r["allowed"]) for k, r in got.items() if k[0] != 9} == {k: v for k, v in want.items() if k[0] != 9}
    assert got[(9, 1000)]["allowed"] is False


SCHEMA = "fiscal_hash string, folder string, finalized_seq long, status string, rejected boolean, version long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_holders_in_any_order_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, now = [], {}
    for k in range(60):
        h, folder, seq = rng.choice(["a", "b", "c", None]), f"f{k}", rng.randrange(40)
        for version in range(rng.randint(1, 3)):  # a folder's later facts: cancelled, rejected, retried
            fact = (h, folder, seq, rng.choice(["done", "review", "cancelled", "error"]), rng.choice([None, False, True, False]), version)
            rows.append(fact)
            now[folder] = fact
    batch = spark.createDataFrame(list(now.values()), SCHEMA)
    want = {r["folder"]: r["duplicate_of"] for r in duplicates.blocked_duplicates(batch).collect() if r["fiscal_hash"]}
    got = last(played(spark, tmp_path, rows, SCHEMA, keyed.holders, 6, seed), "folder")
    assert {k[0]: r["duplicate_of"] for k, r in got.items()} == want


def test_a_cancelled_holder_frees_its_hash(spark, tmp_path):
    one = lambda *r: spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, own = [], keyed.session_for(spark, 1)

    def run():
        stream = own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        keyed.holders(stream).writeStream.foreachBatch(lambda df, n: out.append([(r["folder"], r["duplicate_of"]) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for fact in [("h", "second", 2, "done", False, 0), ("h", "third", 3, "done", False, 0), ("h", "first", 1, "done", False, 0), ("h", "first", 1, "cancelled", False, 1)]:
        one(*fact)
        run()  # each time a stream that goes on from the state kept
    found = [sorted(x, key=str) for x in out if x]
    assert found == [[("second", None)], [("third", "second")], [("first", None), ("second", "first"), ("third", "first")], [("first", None), ("second", None), ("third", "second")]]


def admitted(rows):
    want = {}
    for sha in {r[0] for r in rows}:
        holder = status = None
        for _, seq, doc, what in sorted(r for r in rows if r[0] == sha):
            if what != "uploaded":
                status = what if doc == holder else status
            elif holder is None or status in ("error", "cancelled", "pre_scan_failed"):
                want[(sha, seq)] = (True, None, None)
                holder, status = doc, what
            else:
                want[(sha, seq)] = (False, holder, status)
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_admissions_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "y"]), s, rng.randrange(5), rng.choice(["uploaded", "uploaded", "error", "done", "cancelled", "pre_scan_failed"])) for s in range(120)]
    got = last(played(spark, tmp_path, rows, "sha256 string, seq long, doc_id long, status string", keyed.admissions, 5, seed), "sha256", "seq")
    assert {k: (r["admitted"], r["original"], r["original_status"]) for k, r in got.items()} == admitted(rows)


def test_children_come_once(spark, tmp_path):
    schema = "doc_id long, seq long, book string, sha256_file string, split_into array<long>"
    rows = [(1, 5, "compras", "s1", [10, 11]), (1, 6, "compras", "s1", [11, 12]), (2, 7, None, None, []), (3, 8, "ventas", "s3", None), (4, 9, "ventas", "s4", [11])]
    got = played(spark, tmp_path, rows * 3, schema, keyed.children, 4, 1)
    assert sorted((r["doc_id"], r["child"], r["book"], r["sha256_file"]) for r in got) == [(1, 10, "compras", "s1"), (1, 11, "compras", "s1"), (1, 12, "compras", "s1"), (4, 11, "ventas", "s4")]


def test_replayed_takes_several_triggers_and_its_folder_goes(spark):
    rows = spark.createDataFrame([(k % 7, k, "uploaded" if k < 7 else "review") for k in range(60)], "doc_id long, seq long, status string")
    with scratch.owner(spark):
        root = scratch.folder(spark, "stream")
        changes = keyed.replayed(rows, keyed.steps, root, session=keyed.session_for(spark, 2), files=6, triggers=3)
        assert keyed.latest(changes, "doc_id", "seq").count() == 60
        assert spark.read.parquet(f"{root}/out").select("trigger").distinct().count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{root}/out")
