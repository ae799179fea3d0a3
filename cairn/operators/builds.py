"""Derived tables that are built aside and published whole, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import ingest as N
from cairn.operators.relational import table_digest
from cairn.scratch import exists
from cairn.sources import jsonl

REGISTRY = "index_name string, version long, status string, step int, cutoff long, n_rows long, digest string, path string"
STEPS = {"building": 0, "failed": 1, "published": 2}


def _tell(spark: SparkSession, root: str, name: str, version: int, status: str, cutoff=None, n_rows=None, digest=None, path=None) -> None:
    row = [(name, version, status, STEPS[status], cutoff, n_rows, digest, path)]
    spark.createDataFrame(row, REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")


def publish(df: DataFrame, name: str, root: str, version: int, columns: list[str], cutoff: str | None = None) -> None:
    """Build version ``version`` of a table aside, then publish it with its size and digest.

    Readers keep the version published before until the new one is; a build that fails
    is recorded as failed and changes nothing for them.  The cutoff comes from the
    data.  Building a version again writes the same folder.
    """
    spark, path = df.sparkSession, f"{root}/{name}/version={version}"
    _tell(spark, root, name, version, "building")
    try:
        df.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        seen = table_digest(back, columns).first()
        top = back.agg(F.max(cutoff).cast("long")).first()[0] if cutoff else None
    except Exception:
        _tell(spark, root, name, version, "failed")
        raise
    _tell(spark, root, name, version, "published", top, seen["n_rows"], seen["digest"], path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The registry: each version of each table with its last status."""
    rows = spark.read.schema(REGISTRY).parquet(f"{root}/registry")
    last = rows.groupBy("index_name", "version").agg(F.max_by(F.struct("status", "cutoff", "n_rows", "digest", "path"), "step").alias("r"))
    return last.select("index_name", "version", "r.*")


def current(spark: SparkSession, name: str, root: str) -> DataFrame | None:
    """The newest published version of a table, or None."""
    if not exists(spark, f"{root}/registry"):
        return None
    row = versions(spark, root).where((F.col("index_name") == name) & (F.col("status") == "published")).agg(F.max_by("path", "version")).first()[0]
    return None if row is None else spark.read.parquet(row)


def store_state(spark: SparkSession, log: str, table: str) -> str:
    """How a derived event table (``eid, sequence``) stands to its log, as one of eight states."""
    if not exists(spark, log):
        return "CANONICAL_MISSING"
    lines = jsonl.read_log(spark, log)
    if not lines.where("fault IS NOT NULL").isEmpty():
        return "CANONICAL_MALFORMED"
    if not exists(spark, table):
        return "DERIVED_MISSING"
    try:
        derived = spark.read.parquet(table)
        if not {"eid", "sequence"} <= set(derived.columns):
            return "SCHEMA_INCOMPATIBLE"
        have = derived.select("eid", F.col("sequence").alias("have"))
        first = N.outcomes(jsonl.as_events(lines), "eid", "content_hash", "sequence").where("outcome = 'new_event'")
        both = first.select("eid", F.col("sequence").alias("want")).join(have, "eid", "full_outer")
        odd = both.agg(F.count(F.when(F.col("have").isNull(), 1)).alias("missing"), F.count(F.when(F.col("want").isNull() | (F.col("want") != F.col("have")), 1)).alias("wrong")).first()
    except Exception as e:  # what cannot be read is a state, not an error
        return "DERIVED_CORRUPT" if "CANNOT_READ" in str(e) or "UNABLE_TO_INFER" in str(e) else "DERIVED_UNAVAILABLE"
    return "DERIVED_CORRUPT" if odd["wrong"] else "DERIVED_STALE" if odd["missing"] else "READY"


def recover(spark: SparkSession, log: str, root: str, version: int) -> str:
    """Rebuild the event table from a sound log and publish it; the state found before."""
    live = current(spark, "events", root)
    state = store_state(spark, log, live.inputFiles()[0].rsplit("/", 1)[0] if live is not None and live.inputFiles() else f"{root}/events")
    if state.startswith("CANONICAL"):
        raise ValueError(state)
    if state != "READY":
        events = jsonl.as_events(jsonl.read_log(spark, log))
        first = N.outcomes(events, "eid", "content_hash", "sequence").where("outcome = 'new_event'").select("eid", "sequence")
        publish(events.join(first, ["eid", "sequence"], "left_semi"), "events", root, version, ["eid", "sequence", "content_hash"], "sequence")
    return state
