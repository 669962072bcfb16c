"""The verdict lattice. Two orders exist, and each place names its own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values, best first. Fiscal and identity checks rank pendiente above warn; assembly, client and semantics the reverse.
CHECKING = ("auto", "warn", "pendiente", "block")
ASSEMBLING = ("auto", "pendiente", "warn", "block")


def rank(verdict: Column, order=CHECKING, unknown: int = 0) -> Column:
    """The verdict's place in the order."""
    out = F.lit(unknown)
    for k, v in enumerate(order):
        out = F.when(verdict == v, k).otherwise(out)
    return out


def named(place: Column, order=CHECKING) -> Column:
    """The verdict at a place; auto for null."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, order)), (place + 1).cast("int")), F.lit("auto"))


def worst(verdict: Column, order=CHECKING, unknown: int = 0) -> Column:
    """Aggregate: the worst verdict of a group; auto for an empty one."""
    return named(F.max(rank(verdict, order, unknown)), order)


def worse(*verdicts: Column, order=CHECKING, unknown: int = 0) -> Column:
    """The worst of a row's verdicts."""
    return named(F.greatest(*(rank(v, order, unknown) for v in verdicts)), order)
