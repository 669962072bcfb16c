"""Reference dimensions: configured tables, one small text read on the driver or many in tasks, joined as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_CHART = "concept string, account string, review boolean, pos int"


def parse_lines(lines: DataFrame, *file: str) -> DataFrame:
    """(file columns, line_no, value) text of a dimension without comments and blank lines."""
    text = F.trim(F.regexp_replace("value", r"\s+#.*$|^#.*$", ""))
    return lines.select(*file, "line_no", F.col("value").alias("raw"), text.alias("value")).where("value <> ''")


def whitelist(lines: DataFrame, *file: str) -> DataFrame:
    """(file columns, book_key, code) of ``key:`` lines followed by ``- "a"; "b"`` lines.

    ``lines`` is (line_no, value) and the columns that name the file, if there is
    more than one. A file has a few lines, so an ordered window of it carries the
    key forward.
    """
    from pyspark.sql import Window as W

    rows = parse_lines(lines, *file)
    key = F.when(F.col("value").rlike(r"^[^-].*:\s*$"), F.regexp_replace("value", r":\s*$", ""))
    rows = rows.withColumn("book_key", F.last(key, True).over(W.partitionBy(*file).orderBy("line_no")))
    codes = rows.where(F.col("value").startswith("-")).select(*file, "book_key", F.explode(F.split(F.regexp_replace("value", r"^-\s*", ""), ";")).alias("code"))
    return codes.select(*file, "book_key", F.trim(F.translate("code", "\"'", "")).alias("code")).where("code <> ''")


def lines_of(texts: DataFrame) -> DataFrame:
    """(file, line_no, value) of texts (file, text)."""
    return texts.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def _entries(text: str | None, section: str, names: list[str]) -> list[tuple]:
    """The rows of a section of a YAML text: a list of maps, or a map whose keys become the first column. Of anything unreadable none."""
    try:
        import yaml

        found = (yaml.safe_load(text or "") or {}).get(section) or []
    except Exception:
        found = []
    if isinstance(found, dict):
        found = [{names[0]: k} | v for k, v in found.items() if isinstance(v, dict)]
    return [tuple((r | {"pos": k}).get(c) for c in names) for k, r in enumerate(found) if isinstance(r, dict)]


def load_yaml(spark: SparkSession, text: str | None, section: str, schema: str) -> DataFrame:
    """A section of one YAML text as a table, of anything unreadable an empty one.

    Needs PyYAML; without it, or for other formats, give rows to createDataFrame.
    """
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    return spark.createDataFrame(_entries(text, section, kind.fieldNames()), kind)


def read_yaml(texts: DataFrame, section: str, schema: str) -> DataFrame:
    """(file, columns of schema) of a section of each of very many YAML texts (file, text), parsed in tasks, a file at a time. Unreadable files have no rows."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, *row) for file, text in zip(batch["file"], batch["text"]) for row in _entries(text, section, names)]
            yield pd.DataFrame(rows, columns=["file", *names])

    return texts.select("file", "text").mapInPandas(run, f"file {texts.schema['file'].dataType.simpleString()}, {schema}")


def concept_flags(chart: DataFrame) -> DataFrame:
    """(concept, review): whether a person must look."""
    return chart.groupBy("concept").agg(F.max(F.coalesce("review", F.lit(False))).alias("review"))
