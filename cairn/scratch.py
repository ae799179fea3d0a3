"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders named within each open ``temporary``, innermost last.
_scopes: list[list[str]] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on a local master only:
    on a cluster every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, on whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of the files and folders in a folder, on whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, on whatever file system; one that is gone already is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession):
    """Drops the intermediate tables that are written within, when it ends.

    Results must be written or collected before: frames that still read such tables fail afterwards.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            discard(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read back: a short lineage on lasting files."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
