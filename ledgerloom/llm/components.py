"""Connected components of a link table, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut, drop
from .salted import with_facts


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: list[int] | None = None) -> DataFrame:
    """(id, component_id) for every id that has a link to another; component_id is the smallest id reachable.

    Ids have a random rank, the same in all rounds. In a round an id moves to
    its neighbour of the least rank, if that is less than its own, and on to
    where that one moves; links are renamed accordingly and those within one
    place are dropped. A star ends in two rounds; of a chain, however numbered,
    a third of the places is left by each, so that rounds grow with its
    logarithm. ``rounds`` collects the number of links that each round began with.

    Links and moves stay distributed: the driver only sees how many links are
    left. Sums are combined before each shuffle, and both inputs of each join
    are shuffled as they are read, so that adaptive execution splits the rows
    of an id with very many links. Null ends and links of an id to itself are
    ignored.
    """
    links = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    moves: list[DataFrame] = []
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("to"))
    while left := links.count():
        if rounds is not None:
            rounds.append(left)
        both = links.union(links.select("b", "a"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("n")).select(F.col("a").alias("id"), F.least("n", rank("a"))["to"].alias("to"))
        far = near.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = cut(near.join(far, "to").select("id", F.col("next").alias("to")))
        moves.append(step)
        from_a, from_b = (step.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        renamed = links.join(from_a, "a").join(from_b, "b").where("a_to <> b_to")
        before, links = links, cut(renamed.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        drop(before)
    if not moves:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component_id"))
    # where each id came to lie in the end, from the last round back
    place = moves[-1]
    for step in moves[-2::-1]:
        place = step.join(place.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    out = cut(with_facts(place, ["to"], ["id"], [F.min("id").alias("component_id")]).select("id", "component_id"))
    drop(links, *moves)
    return out
