"""Helpers shared by the training-data operators: paths, scratch tables, bounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.scratch import folder
from cairn.sources.tables import read


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's readers touch the path."""
    return read(spark, sf_dir, name)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name for a written intermediate table.

    It lies under ``spark.checkpoint.dir``, which every executor of a cluster
    shares; see ``cairn.scratch``.
    """
    return folder(spark, what)


def materialise(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # given, as an empty table has no file to tell it


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file-system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: What this worker process keeps from task to task: the tables of one operator.
_kept: dict = {}


def kept(key: tuple, make):
    """``make()``, made once and kept in this worker until another operator's task comes.

    Workers outlive tasks and serve every operator in turn, so tables that each left
    behind would add up.
    """
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what other operators' tasks left in this worker; called as a task begins."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"__{name}".lower() in taken:
            name += "_"
        out.append(f"__{name}")
    return out
