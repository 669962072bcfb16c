"""The client master kept up by a stream of confirmations, each counted once.

A count that is added to isn't idempotent, so a batch that runs again must not
add again. The stored master is a set of versions, one for each batch, that hold
the clients which the batch touched and nothing else. A batch is applied to what
the versions *before* its own number say and replaces its own version: however
often it runs, and wherever it broke off, the result is the same. What a version
keeps of a client is merged by sums, maxima and first places, so that batches
may bring confirmations in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parties import REGISTERED

_SETS = "array<struct<seq:long,value:string>>"
#: What is kept of a client: names and set members with the place of their first confirmation; what the master began with comes first.
SCHEMA = f"nif string, names array<struct<seq:long,value:string>>, fecha_alta string, documentos long, ultima string, libros {_SETS}, tipos {_SETS}"
#: Version 0 is the master that the stream began with; batch n writes version n + 1.
_STORED = f"{SCHEMA}, version long"


def _first_of_each(entries: Column) -> Column:
    """Entries (seq, value) in order, of each value the first. Books and kinds are a handful."""
    keep = lambda out, x: F.when(F.exists(out, lambda y: y["value"] == x["value"]), out).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(F.array_sort(entries), F.array().cast(_SETS), keep)


def partials(confirmations: DataFrame, today: str) -> DataFrame:
    """What confirmations (nif, nombre, date, book, kind, decision, seq) add to each client. Sums are combined before the shuffle, a client's many rows come as few.

    Only the decisions that register count, and only with an id; of a name the
    first that isn't empty.
    """
    rows = confirmations.where(F.col("decision").isin(*REGISTERED)).withColumn("nif", F.upper(F.trim("nif"))).where("nif <> ''")
    empty = F.array().cast(_SETS)
    firsts = lambda c: rows.where(F.coalesce(c, F.lit("")) != "").groupBy("nif", c).agg(F.min("seq").alias("seq")).groupBy("nif").agg(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("value")))).alias(c))
    name = F.min(F.when(F.trim("nombre") != "", F.struct(F.col("seq"), F.trim("nombre").alias("value"))))
    out = rows.groupBy("nif").agg(F.count("*").alias("documentos"), F.max(F.nullif(F.col("date"), F.lit(""))).alias("ultima"), name.alias("name"))
    out = out.join(firsts("book"), "nif", "left").join(firsts("kind"), "nif", "left")
    names = F.when(F.col("name").isNull(), empty).otherwise(F.array("name")).cast(_SETS)
    return out.select("nif", names.alias("names"), F.lit(today).alias("fecha_alta"), "documentos", "ultima", F.coalesce("book", empty).alias("libros"), F.coalesce("kind", empty).alias("tipos"))


def started(master: DataFrame) -> DataFrame:
    """A master (nif, nombre, fecha_alta, documentos, ultima, libros, tipos) as it is kept: its own entries come before all confirmations, in their order."""
    numbered = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, k: F.struct((k - F.lit(1 << 20)).cast("long").alias("seq"), x.alias("value")))
    name = F.trim("nombre")
    names = F.when(F.coalesce(name, F.lit("")) == "", F.array().cast(_SETS)).otherwise(F.array(F.struct(F.lit(-(1 << 20)).cast("long").alias("seq"), name.alias("value"))))
    return master.select("nif", names.alias("names"), "fecha_alta", F.coalesce("documentos", F.lit(0)).cast("long").alias("documentos"), "ultima", numbered("libros").alias("libros"), numbered("tipos").alias("tipos"))


class Store:
    """The versions of a master in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def begin(self, master: DataFrame) -> None:
        """Writes the master that the stream starts from."""
        started(master).write.mode("overwrite").parquet(f"{self.path}/version=0")

    def kept(self, before: int | None = None) -> DataFrame:
        """What is kept of each client: its last version, of those below ``before``."""
        rows = self.spark.read.schema(_STORED).parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("version") < before)  # prunes folders
        columns = [c for c in rows.columns if c not in ("nif", "version")]
        return rows.groupBy("nif").agg(F.max_by(F.struct(*columns), "version").alias("x")).select("nif", "x.*")

    def apply(self, confirmations: DataFrame, batch: int, today: str) -> None:
        """Adds a batch. A batch that was applied before is applied to the same versions again and changes nothing."""
        new = partials(confirmations, today)
        touched = self.kept(batch + 1).join(new.select("nif"), "nif", "left_semi")
        both = new.alias("n").join(touched.alias("o"), "nif", "left")
        join = lambda c: _first_of_each(F.concat(F.coalesce(f"o.{c}", F.array().cast(_SETS)), f"n.{c}"))
        out = both.select(
            "nif", F.slice(F.array_sort(F.concat(F.coalesce("o.names", F.array().cast(_SETS)), "n.names")), 1, 1).alias("names"), F.coalesce("o.fecha_alta", "n.fecha_alta").alias("fecha_alta"),
            (F.coalesce("o.documentos", F.lit(0)) + F.col("n.documentos")).alias("documentos"), F.greatest("o.ultima", "n.ultima").alias("ultima"), join("libros").alias("libros"), join("tipos").alias("tipos"),
        )
        out.write.mode("overwrite").parquet(f"{self.path}/version={batch + 1}")

    def master(self) -> DataFrame:
        """(nif, nombre, fecha_alta, documentos, ultima, libros, tipos) as of the last batch."""
        values = lambda c: F.transform(c, lambda x: x["value"]).alias(c)
        return self.kept().select("nif", F.coalesce(F.get("names", F.lit(0))["value"], F.lit("")).alias("nombre"), "fecha_alta", "documentos", "ultima", values("libros"), values("tipos"))

    def fold(self, into: str) -> "Store":
        """A store of one version elsewhere, for a stream that begins anew: what is read grows with the batches otherwise."""
        other = Store(self.spark, into)
        self.kept().write.mode("overwrite").parquet(f"{into}/version=0")
        return other


def registrations(stream: DataFrame, store: Store, checkpoint: str, today: str) -> StreamingQuery:
    """Keeps the store up with a stream of confirmations until all there is is read. The checkpoint belongs to the store: its batch numbers are the versions."""
    return stream.writeStream.foreachBatch(lambda batch, number: store.apply(batch, number, today)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
