"""The canonical log: one JSON envelope per line, exact line numbers, faults kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import vocabulary as V
from cairn.functions.identity import utf8_json_text

ENVELOPE = (
    "event_id string, trace_id string, source string, event_type string, schema_version int, created_at string, observed_at string, sequence long,"
    " lifecycle_status string, verification_status string, confidence string, sensitivity string, retention string, sanitized_content_hash string,"
    " session_id string, profile_id string, project_id string, task_id string, turn_id string, parent_trace_id string, relation_ids array<string>,"
    " knowledge_space_ids array<string>, knowledge_space_id string, sanitized_content string, redaction_audit string, superseded_by string,"
    " artifact_refs array<struct<artifact_id:string,content_hash:string,kind:string,retention:string>>,"
    " deletion struct<target_event_id:string,reason_code:string,approved_scope:string>, _corrupt string"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line, complete`` of every line: numbers from the top of each file.

    Lines of a block are consecutive within their task, so a line's number is its
    distance from the block's first plus the lines of the blocks before it; only one
    row for each block is moved.  The last line of a file is incomplete if the file
    does not end with a line feed, which its size tells.
    """
    m = lambda name: F.col(f"_metadata.{name}").alias(name)
    raw = spark.read.option("lineSep", "\n").text(path).select(m("file_path"), m("file_size"), m("file_block_start"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    blocks = raw.groupBy("file_path", "file_block_start").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("held"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("file_size").alias("size"))
    whole = Window.partitionBy("file_path")
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("file_path", "file_block_start", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("above"), F.sum("held").over(whole).alias("lines"), (F.sum("bytes").over(whole) == F.col("size")).alias("ended"))
    rows = raw.join(placed, ["file_path", "file_block_start"])
    number = F.col("above") + F.col("n") - F.col("first") + 1
    return rows.select(F.col("file_path").alias("file"), number.alias("line_no"), "line", (F.col("ended") | (number < F.col("lines"))).alias("complete"))


def line_fault(line: Column, complete: Column) -> Column:
    """What is wrong with a line before its envelope is looked at, or null."""
    parsed = F.try_parse_json(line)
    return (
        F.when(~F.is_valid_utf8(line), "invalid_utf8")
        .when(parsed.isNull() & ~complete, "truncated_line")
        .when(parsed.isNull(), "malformed_json")
        .when(~F.ltrim(line).startswith("{"), "invalid_top_level")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line, fault`` and the envelope of every line of a log.

    Blank lines are skipped but counted.  A line that is not UTF-8, is cut off, is not
    JSON or no object, or breaks a rule of the envelope, keeps its text and carries
    the code of its first fault.
    """
    from cairn.operators.ingest import fault

    rows = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("e", F.from_json("line", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    flat = rows.select("file", "line_no", "line", "complete", "e.*")
    spaces = F.when(F.size("knowledge_space_ids") > 0, F.col("knowledge_space_ids")).when(F.col("knowledge_space_id").isNotNull(), F.array("knowledge_space_id")).otherwise(F.array().cast("array<string>"))
    broken = F.coalesce(line_fault(F.col("line"), F.col("complete")), F.when(F.col("_corrupt").isNotNull(), "envelope_invalid_value"))
    columns = [c for c in flat.columns if c not in ("knowledge_space_id", "_corrupt", "complete")]
    return flat.withColumn("fault", F.coalesce(broken, fault(flat.columns))).withColumn("knowledge_space_ids", spaces).select(*columns, "fault")


def strict(log: DataFrame) -> DataFrame:
    """The log if it has no fault; its first fault is an error otherwise."""
    bad = log.where("fault IS NOT NULL").agg(F.min(F.struct("file", "line_no", "fault")).alias("b")).first()["b"]
    if bad is not None:
        raise ValueError(f"{bad['fault']} in {bad['file']} line {bad['line_no']}")
    return log.drop("fault")


def as_events(log: DataFrame) -> DataFrame:
    """Sound envelopes in the shape that reads use."""
    return log.where("fault IS NULL").select(
        F.col("event_id").alias("eid"), "trace_id", "created_at", "observed_at", "sequence", "event_type", "profile_id", "project_id", "session_id", "parent_trace_id", "relation_ids",
        F.coalesce("knowledge_space_ids", F.array().cast("array<string>")).alias("spaces"), F.col("lifecycle_status").alias("lifecycle"), F.col("verification_status").alias("verification"), "sensitivity",
        F.col("sanitized_content").alias("content"), F.col("sanitized_content_hash").alias("content_hash"), F.col("deletion.target_event_id").alias("tombstone_target"), F.col("redaction_audit").isNotNull().alias("redaction_applied"), "artifact_refs",
    )


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of appended files: ``file, line, fault`` and the envelope of every line.

    Numbers and the completeness of last lines need the whole of a file and are left
    to ``read_log``; here a cut line is malformed JSON.
    """
    from cairn.operators.ingest import fault

    raw = spark.readStream.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    flat = rows.select("file", "line", "e.*")
    broken = F.coalesce(line_fault(F.col("line"), F.lit(True)), F.when(F.col("_corrupt").isNotNull(), "envelope_invalid_value"))
    return flat.withColumn("fault", F.coalesce(broken, fault(flat.columns))).drop("_corrupt")


def normalized_events(payloads: DataFrame, event_type: Column, source: str, content: str = "sanitized_content") -> DataFrame:
    """Envelopes of payloads: ids where none are given, one clock, the content's hash, spaces once each.

    ``payloads`` has ``sequence``, the content as a text and any identity columns; what
    it lacks is null.
    """
    have = lambda n, kind="string": F.col(n).cast(kind) if n in payloads.columns else F.lit(None).cast(kind)
    now = F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    spaces = F.array_distinct(have("knowledge_space_ids", "array<string>"))
    return payloads.select(
        F.coalesce(have("event_id"), F.uuid()).alias("event_id"), F.coalesce(have("trace_id"), F.uuid()).alias("trace_id"), event_type.alias("event_type"), F.lit(source).alias("source"), F.lit(1).alias("schema_version"),
        now.alias("created_at"), now.alias("observed_at"), F.col("sequence").cast("long").alias("sequence"), *[have(n).alias(n) for n in ("session_id", "profile_id", "project_id", "task_id", "turn_id", "parent_trace_id")],
        spaces.alias("knowledge_space_ids"), F.col(content).alias("sanitized_content"), F.concat(F.lit("sha256:"), F.sha2(utf8_json_text(F.col(content)), 256)).alias("sanitized_content_hash"),
    )


def accept_append(log: DataFrame) -> DataFrame:
    """Events that may be written to the log at all."""
    return log.where(~F.col("sensitivity").isin("secret") & ~F.col("retention").isin("never_store") & F.col("event_type").isin(*V.EVENT_TYPES))
