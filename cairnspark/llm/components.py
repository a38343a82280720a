"""Connected components as DataFrame rounds (large-star / small-star, Kiveris et al. 2014).

A round is two stars. A star is an aggregate (minimum neighbour of each node, combined map-side) and a
join of the edges with it. The minimum table is written and read again, so both sides of the join arrive
by an exchange of their own and AQE may split a hub that holds a third of all edges. A round's tables are
deleted when the next round's are written; one bit a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). large: v over u point to the least of u and its neighbours. Small (v < u): u and
    its neighbours point to the least neighbour."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = joined.select("u", "v", "m")
        out = out.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(out.filter("v = m").select("u", F.col("m").alias("v")))
    out = materialize(out.distinct(), "cc-star")
    discard(least)
    return out


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each component is a star around its least node."""
    ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: component is the least node reachable.

    Edges with a null end and self-loops are dropped; nodes without edges are not returned. Node values
    may be of any orderable type.
    """
    pairs = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc-edges")
    while not _are_stars(pairs):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        half = _star(both, large=True)
        before, pairs = pairs, _star(half, large=False)
        discard(before, half)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
