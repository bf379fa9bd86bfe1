"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsule.sources.staging import stage


#: Least number of edges of a node that is joined by itself; there are never more than 200,000 such nodes.
HUB = 1 << 16


def with_least(both: DataFrame, edges: int) -> DataFrame:
    """`both` (u, v) with `m`, the smallest of a node and its neighbours. Edges of a hub stay where they are: the few hubs are
    broadcast."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    most = max(HUB, edges // 100_000)
    if 2 * edges <= most:
        return both.join(least, "u")
    hubs = stage(least.where(F.col("n") > most).select("u", "m"), "hubs")
    rest = both.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return rest.select("u", "v", "m").unionByName(both.join(F.broadcast(hubs), "u").select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (a, b); root is the smallest node of its component.

    Each round points the larger neighbours of a node at its smallest neighbour, then the smaller ones; a few rounds
    suffice for any shape of graph. Neighbour lists are never gathered, and each round is written, so a lost executor
    costs a re-read.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
              .where("hi > lo").distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or not state[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo")).distinct()
        seen = state
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        large = with_least(both, state[0]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(least.select("hi", "m")).where("hi > lo").distinct())
        e = stage(small, "small-star")
