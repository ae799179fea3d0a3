"""Parquet tables, with small files spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are long texts: work on them is worth a shuffle when one task would hold all.
TEXT_TABLES = ("documents", "pages")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark's readers touch the path."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer partitions than cores, such as one small file.

    A large table has more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) // 2 else df
