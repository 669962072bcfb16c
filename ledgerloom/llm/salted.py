"""Joins of rows with a fact about their key where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16


def salt(*by: str) -> Column:
    """0 to 15, by columns that differ among the rows of one key."""
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts_of(by: list[str]) -> Column:
    """An aggregate: which salts the rows of a key have, as bits. Like a sum, it is combined before the shuffle."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), salt(*by)))


def spread(facts: DataFrame, mask: str, name: str = "__salt") -> DataFrame:
    """One row of facts for each salt that the mask has: never more rows than the key has in the rows to join."""
    bits = F.sequence(F.lit(0), F.lit(SALTS - 1))
    found = F.filter(bits, lambda k: F.expr(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0)
    return facts.withColumn(name, F.explode(found)).drop(mask)


def with_facts(rows: DataFrame, keys: list[str], by: list[str], aggregates: list[Column], having: str = "true") -> DataFrame:
    """rows with the aggregates of their key, for the keys that ``having`` keeps. A hot key's rows are dealt over 16 tasks by ``by``."""
    facts = rows.groupBy(*keys).agg(*aggregates, salts_of(by).alias("__salts")).where(having)
    return rows.withColumn("__salt", salt(*by)).join(spread(facts, "__salts"), [*keys, "__salt"]).drop("__salt")


def looked_up(rows: DataFrame, key: str, by: list[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with the rows of ``table`` (a column ``key`` too), dealt like :func:`with_facts`."""
    wanted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(salts_of(by).alias("__salts"))
    facts = spread(table.join(wanted, key), "__salts")
    return rows.withColumn("__salt", salt(*by)).join(facts, [key, "__salt"], how).drop("__salt")
