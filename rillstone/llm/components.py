"""Connected components over links, by alternating large-star and small-star rounds.

Each round is two aggregations over the links; the links of each round are written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour to the smallest node of the neighbourhood: the larger ones (large star), or
    the smaller ones and the node itself (small star).  A hub's neighbours are not gathered: the minimum
    is an aggregate that is joined back, and the planner splits the hub's rows."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; ``links`` is (u, v) in any order.

    Raises if ``max_rounds`` do not suffice: the rounds needed grow with the logarithm of the
    longest chain.
    """
    now = settle(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = None
    for _ in range(max_rounds):
        now = settle(_star(_star(now, True), False), "links")
        stamp = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if stamp == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = stamp
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
