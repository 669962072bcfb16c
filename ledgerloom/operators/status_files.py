"""Status files that are updated in part: each update is a JSON object whose fields replace those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merged(updates: DataFrame, stored: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, status, bad): the status object of each key after its updates (key, seq, patch text), in the order of seq.

    A field has the value of its last update, whole: objects aren't merged within,
    and null is a value. Fields are in the order of their names. ``stored`` (key,
    status text) comes before all updates; a key without updates keeps it. An
    update that is null, no JSON, no object, or names a field twice changes nothing and counts as
    ``bad``; a key with none but bad ones, and nothing stored, has the empty
    object. Of two updates of one number the one with the greater text wins.

    Fields are combined before the shuffle: a key with very many updates comes
    as one row for each of its fields.
    """
    rows = updates.select(key, F.col("seq").cast("long").alias("seq"), F.col("patch").alias("patch"))
    if stored is not None:
        rows = rows.unionByName(stored.select(key, F.lit(-(1 << 62)).alias("seq"), F.col("status").alias("patch")))
    parsed = rows.withColumn("v", F.try_parse_json("patch"))
    parsed = parsed.withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    fields = parsed.where("ok").lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.to_json("value").alias("value")))
    last = fields.groupBy(key, "field").agg(F.max_by("value", F.struct("seq", "patch")).alias("value"))
    name = F.to_json(F.array("field"))  # quoted as JSON quotes it
    cells = F.array_sort(F.collect_list(F.struct("field", F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), "value").alias("cell"))))
    objects = last.groupBy(key).agg(F.array_join(F.transform(cells, lambda c: c["cell"]), ",").alias("cells"))
    bad = parsed.groupBy(key).agg(F.count_if(~F.col("ok")).alias("bad"))
    return bad.join(objects, key, "left").select(key, F.concat(F.lit("{"), F.coalesce("cells", F.lit("")), F.lit("}")).alias("status"), "bad")
