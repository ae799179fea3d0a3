"""Incremental projection of an append-only log with Structured Streaming.

Each micro-batch is anti-joined with the committed ids, projected by the same
code as a batch, and appended to the table in one write.  A batch that is run
again after a failure finds its own number already written and leaves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ingest import supersessions
from cairn.operators.relational import first_by
from cairn.scratch import exists, written


def project(events: DataFrame) -> DataFrame:
    """The event rows that reads use."""
    return events.select("eid", "trace_id", "created_at", "sequence", "event_type", "profile_id", "project_id", "spaces", "lifecycle", F.sha2("content", 256).alias("content_hash"))


def commit(batch: DataFrame, number: int, table: str, keys: tuple[str, ...] = ("eid",)) -> None:
    """Append the new rows of one micro-batch; first write wins, for good."""
    spark = batch.sparkSession
    new = first_by(project(batch), list(keys), ["sequence", "eid", "content_hash"])
    if exists(spark, table):
        done = spark.read.parquet(table).where(F.col("batch") != number)
        new = new.join(done.select(*keys), list(keys), "left_anti")
    new.write.mode("overwrite").parquet(f"{table}/batch={number}")


#: What the tables of a streamed log hold, by name.
TABLES = {
    "events": "eid string, trace_id string, sequence long, lifecycle string, content_hash string",
    "deletions": "deletion_id string, target_id string, sequence long, status string, target_trace_id string",
    "audit": "deletion_id string, target_id string, detail string",
}


def committed(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """The rows of a table, of the batches below ``before`` only if that is given."""
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], f"{TABLES[name]}, batch int")
    rows = spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{root}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def commit_log(batch: DataFrame, number: int, root: str) -> None:
    """Commit events, deletions and their audit of one micro-batch.

    ``batch`` has ``eid, trace_id, sequence, lifecycle, content_hash,
    tombstone_target``.  The first event of an id wins.  A deletion whose target is not
    there is pending; when the target arrives, in this batch or a later one, it is
    applied and audited a second time.  Each table's part carries the batch's number and
    is read back only by later batches, so a batch that runs again writes the same.
    """
    spark = batch.sparkSession
    known = committed(spark, root, "events", number)
    fresh = first_by(batch, ["eid"], ["sequence"]).join(known.select("eid"), "eid", "left_anti")
    fresh = written(fresh.select("eid", "trace_id", "sequence", "lifecycle", "content_hash", "tombstone_target"), "batch")
    arrived = fresh.select(F.col("eid").alias("target_id"), F.col("trace_id").alias("trace"), F.col("sequence").alias("at"))
    there = known.select(F.col("eid").alias("target_id"), F.col("trace_id").alias("trace"), F.col("sequence").alias("at")).unionByName(arrived)
    asked = fresh.where("tombstone_target IS NOT NULL").select(F.col("eid").alias("deletion_id"), F.col("tombstone_target").alias("target_id"), "sequence")
    late = F.col("at") > F.col("sequence")
    status = F.when(F.col("at").isNull(), "pending").when(late, "applied_on_arrival").otherwise("applied")
    columns = ["deletion_id", "target_id", "sequence", status.alias("status"), F.when(~late, F.col("trace")).alias("target_trace_id")]
    now = asked.join(there, "target_id", "left").select(*columns)
    earlier = committed(spark, root, "deletions", number)
    settled = earlier.where("status <> 'pending'").select("deletion_id")
    waiting = earlier.where("status = 'pending'").join(settled, "deletion_id", "left_anti").select("deletion_id", "target_id", "sequence")
    resolved = waiting.join(arrived, "target_id").select("deletion_id", "target_id", "sequence", F.lit("applied_on_arrival").alias("status"), F.lit(None).cast("string").alias("target_trace_id"))
    detail = lambda df, text: df.select("deletion_id", "target_id", F.lit(text).alias("detail"))
    now = written(now, "deletions")
    audit = detail(now.where("status = 'applied'"), "").unionByName(detail(now.where("status <> 'applied'"), "target_not_yet_present"))
    audit = audit.unionByName(detail(now.where("status = 'applied_on_arrival'"), "")).unionByName(detail(resolved, ""))
    parts = {"deletions": now.unionByName(resolved), "audit": audit, "events": fresh.drop("tombstone_target")}
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")


def deletions_now(spark: SparkSession, root: str) -> DataFrame:
    """Every deletion with its last status."""
    rows = committed(spark, root, "deletions")
    return rows.groupBy("deletion_id").agg(F.max_by(F.struct("target_id", "sequence", "status", "target_trace_id"), "batch").alias("r")).select("deletion_id", "r.*")


def lifecycle_now(spark: SparkSession, root: str) -> DataFrame:
    """Every event with the state that deletions and supersession have left it in."""
    events, gone = committed(spark, root, "events"), deletions_now(spark, root)
    chain = supersessions(events, gone.select("target_id", "sequence")).select("eid", "supersedes", "superseded_by", F.col("current_state").alias("state"))
    applied = gone.where("status <> 'pending'").select(F.col("target_id").alias("eid")).distinct().withColumn("gone", F.lit(True))
    state = F.when(F.col("gone"), "deleted").otherwise(F.coalesce("state", "lifecycle"))
    return events.join(chain, "eid", "left").join(applied, "eid", "left").select("eid", "trace_id", state.alias("current_state"), "supersedes", "superseded_by")


def start_log(source: DataFrame, root: str, checkpoint: str):
    """Start the projection of a streaming log into the tables under ``root``."""
    return source.writeStream.foreachBatch(lambda df, n: commit_log(df, n, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(spark: SparkSession, source: DataFrame, table: str, checkpoint: str):
    """Start the projection of a streaming frame of canonical events."""
    return source.writeStream.foreachBatch(lambda df, n: commit(df, n, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def freshness(canonical: DataFrame, derived: DataFrame) -> DataFrame:
    """Sequence watermarks of log and projection, the lag, and the state."""
    both = canonical.select("sequence", F.lit(True).alias("log")).unionByName(derived.select("sequence", F.lit(False).alias("log")))
    last = lambda log: F.max(F.when(F.col("log") == log, F.col("sequence")))
    size = lambda log: F.count(F.when(F.col("log") == log, 1))
    seen = both.agg(last(True).alias("canonical_sequence"), size(True).alias("canonical_rows"), last(False).alias("derived_sequence"), size(False).alias("derived_rows"))
    lag = F.coalesce("canonical_sequence", F.lit(-1)) - F.coalesce("derived_sequence", F.lit(-1))
    state = F.when((F.col("lag") == 0) & (F.col("canonical_rows") == F.col("derived_rows")), "CURRENT").when(F.col("derived_rows") == 0, "UNAVAILABLE").otherwise("PENDING")
    return seen.withColumn("lag", lag).withColumn("state", state)


def admit(state: str, mode: str) -> bool:
    """Whether a read may go ahead: ``require_current``, ``bounded_wait``, ``allow_stale``."""
    if mode not in ("require_current", "bounded_wait", "allow_stale"):
        raise ValueError(f"unknown consistency mode: {mode}")
    return state == "CURRENT" or (mode == "allow_stale" and state == "PENDING")


def await_current(state, seconds: float = 10.0, pause: float = 0.5) -> bool:
    """The bounded wait: ask ``state()`` until it is ``CURRENT``, no longer than ``seconds``."""
    import time

    end = time.monotonic() + seconds
    while not (now := state() == "CURRENT") and time.monotonic() + pause <= end:
        time.sleep(pause)
    return now


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts in event-time windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
