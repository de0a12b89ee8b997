"""Connected components by alternating stars, each round's edges staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.llm._shared import staged


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node. Staged, so that the join after it can split a hub's edges."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of each node in links (x, y); label is the least node of its component.

    Large star: each node links its larger neighbours to its least neighbour (or itself); small star: it links
    its smaller neighbours and itself to the least. The edges become stars in O(log**2) rounds, most often in two. Only one
    flag reaches the driver in each round. Not done in most_rounds rounds, it fails rather than giving wrong components.
    """
    edges = staged(links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = _both_ways(edges)
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = staged(large, "large-star")
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = staged(small, "small-star")
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    raise RuntimeError(f"components are not done after {most_rounds} rounds")
