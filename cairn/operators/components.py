"""Connected components of an edge table, by rounds of contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.scratch import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (long ``a``, ``b``); a component is named by one of its nodes.

    In each round every node picks the least of itself and its neighbours, in an order that a hash draws anew
    for the round; nodes that picked the same one become one node.  A constant share of the nodes goes in
    each round, whatever the shape (a long path too), and all minima are pre-aggregated.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    names = written(_both_ways(edges).select(F.col("a").alias("node")).distinct().withColumn("now", F.col("node")), "names")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c, n=turn: F.xxhash64(F.lit(n), c)
        near = F.min(F.struct(rank("b").alias("r"), F.col("b").alias("b")))
        picked = _both_ways(edges).groupBy("a").agg(near.alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("b"))
        # Picking goes to smaller ranks only, so it ends at local minima; those take their pickers in.
        to = written(picked.select("a", F.least(own, "m")["b"].alias("to")), "picked")
        end = to.select(F.col("a").alias("to"), F.col("to").alias("top"))
        to = written(to.join(end, "to", "left").select("a", F.coalesce("top", "to").alias("to")), "picked")
        joined = edges.join(to.select("a", F.col("to").alias("x")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = written(joined.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        names = written(names.join(to.select(F.col("a").alias("now"), "to"), "now", "left").select("node", F.coalesce("to", "now").alias("now")), "names")
    return names.select("node", F.col("now").alias("component"))
