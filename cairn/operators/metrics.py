"""Retrieval metrics over ranked results and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Recall at k, precision at k and mean reciprocal rank, as one row.

    ``results(query_id, id, rank)`` and ``gold(query_id, id)``.
    """
    hits = gold.join(results, ["query_id", "id"], "left")
    by_query = hits.groupBy("query_id").agg(
        F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")).alias("recall"),
        (F.sum((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")) / k).alias("precision"),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"),
    )
    return by_query.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall_at_k"), F.round(F.avg("precision"), 6).alias("precision_at_k"), F.round(F.avg("rr"), 6).alias("mrr"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


def savings(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.agg(F.sum(before).alias("tokens_before"), F.sum(after).alias("tokens_after"), F.round(1 - F.sum(after) / F.sum(before), 6).alias("saved"))
