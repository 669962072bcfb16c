"""A master kept up by a stream: each confirmation counts once, in whatever order and however often its batch runs."""

import random

import pytest

from ledgerloom.operators import parties
from ledgerloom.streaming import registrations

MASTER = "nif string, nombre string, fecha_alta string, documentos long, ultima string, libros array<string>, tipos array<string>"
ROWS = "nif string, nombre string, date string, book string, kind string, decision string, seq long"


def confirmations(rng, n=90):
    for seq in range(n):
        yield (rng.choice(["a1", " A1", "B2", "c3 ", "D4", "", None]), rng.choice(["", " ", None, f"N{seq}"]), rng.choice([None, "", f"2024-{rng.randint(1, 12):02d}-01"]), rng.choice(["compras", "ventas", None, ""]), rng.choice(["cliente", "proveedor"]), rng.choice(["auto", "warn", "block", None]), seq)


def stored(spark):
    return spark.createDataFrame([("A1", "", "2020-01-01", 7, "2024-05-05", ["ventas"], []), ("B2", "Old", "2020-01-02", 0, None, [], None), ("Z9", "Z", None, 3, "2021-01-01", ["x", "w"], ["cliente"])], MASTER)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("nif", "nombre", "fecha_alta", "documentos", "ultima", "libros", "tipos").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_equal_one(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [*confirmations(rng)]
    want = rows_of(parties.register(stored(spark), spark.createDataFrame(rows, ROWS), "2026-01-01"))
    rng.shuffle(rows)
    store = registrations.Store(spark, str(tmp_path / "store"))
    store.begin(stored(spark))
    for k in range(4):
        batch = spark.createDataFrame(rows[k::4], ROWS)
        for _ in range(rng.randint(1, 3)):  # a batch that runs again
            store.apply(batch, k, "2026-01-01")
    assert rows_of(store.master()) == want
    assert rows_of(store.fold(str(tmp_path / "folded")).master()) == want
    touched = {r["nif"] for r in spark.read.parquet(str(tmp_path / "store" / "version=2")).collect()}
    assert "Z9" not in touched


def test_a_batch_that_broke_off_is_applied_once(spark, tmp_path):
    rows = [("A", "n", "2024-01-01", "compras", "cliente", "auto", k) for k in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = registrations.Store(spark, str(tmp_path / "store"))
    store.begin(stored(spark))

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = registrations.registrations(stream, store, str(tmp_path / "state"), "2026-01-01")
        query.awaitTermination()

    apply, calls = store.apply, []

    def fails_after_writing(batch, number, today):
        apply(batch, number, today)
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("lost before the batch was committed")

    store.apply = fails_after_writing
    with pytest.raises(Exception, match="lost before"):
        run()
    run()
    assert calls == [0, 1, 1, 2]
    assert {r["nif"]: r["documentos"] for r in store.master().collect()}["A"] == 12
