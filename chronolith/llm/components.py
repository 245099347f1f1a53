"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hot


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _beside(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u. Hubs are few by the total of edges, and are broadcast; their edges stay where they are."""
    hub = hot("n", total)
    near = edges.join(F.broadcast(low.where(hub).select("u", "m")), "u", "left")
    return near.where("m is not null").select("u", "v", "m").unionByName(near.where("m is null").select("u", "v").join(low.where(~hub).select("u", "m"), "u").select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's smallest node, given for itself too.

    Every step is an aggregation that combines before the shuffle and a join
    against one row a node, hubs apart, so a hub is never gathered. Each round is written out; rounds grow
    with the logarithm of the longest path.
    """
    e = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.expr("v > u")).alias("n"))
        large = durable(_beside(both.where("v > u"), low, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _beside(large, low, state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
