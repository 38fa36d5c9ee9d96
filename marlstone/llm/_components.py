"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A round moves one row per edge, takes minima
with a map-side combine, and never gathers a node's neighbours into a list, so a node with a third of all edges is
only a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: each neighbour above a node links to the node's minimum; small: those below."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of any comparable type, either way round -> (node, root), root the least node reached.

    Nodes without an edge do not appear. Self-links and nulls are ignored. Raises if `rounds` are not enough.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = seen
        after = cut(_star(_star(now, True), False))
        drop(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
