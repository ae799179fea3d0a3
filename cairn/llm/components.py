"""Connected components of an edge table by alternating star contraction.

A large-star step points every larger neighbour of a node at the node's least
neighbour, a small-star step does so for the smaller ones; both are a grouped
minimum and a join, so no node's neighbours are ever gathered in one place.
Rounds are written to the shared scratch folder and end when the edges, by then
stars around each component's least node, no longer change.  The minima are written
too, so that each join stands between two plain shuffles and adaptive execution can
split a node with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import discard, materialise, scratch


def _least(edges: DataFrame) -> DataFrame:
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    upper = edges.select(F.least("u", "v").alias("k"), F.greatest("u", "v").alias("v"))
    return upper.join(least, "k").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger ``u`` to the smaller ``v``."""
    joined = edges.join(_least(edges).withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
    lower = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return lower.unionByName(own).where("u <> v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, str]:
    path = scratch(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), path


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (long ``u``, ``v``).

    A component is its least node.  Loops and repeated edges change nothing; a
    null end is left out; no edges give no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = _written(now)
    seen = _digest(now)
    while True:
        before = path
        now, path = _written(_small_star(_large_star(now)))
        discard(now.sparkSession, before)
        if (digest := _digest(now)) == seen:
            break
        seen = digest
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
