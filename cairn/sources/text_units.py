"""Plain-text sources: one unit for each line that is not blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X


def units_of_text(sources: DataFrame, ref: str = "source_ref", body: str = "text") -> DataFrame:
    """``line_no, location_id, raw_text, text`` beside the source's other columns.

    Line numbers count from 1 and count blank lines too.
    """
    # An empty last line is blank like any other, so the lines are cut once and never measured.
    keep = [c for c in sources.columns if c != body]
    cut = sources.select(*keep, F.posexplode(F.split(body, X.LINE_END)).alias("at", "raw_text")).where(F.col("raw_text").rlike(X.NOT_BLANK))
    return cut.select(
        *keep,
        (F.col("at") + 1).cast("int").alias("line_no"),
        F.concat(F.col(ref), F.lit("#L"), (F.col("at") + 1).cast("string")).alias("location_id"),
        "raw_text",
        X.collapse(F.col("raw_text")).alias("text"),
    )


def format_kind(name):
    """The adapter that a file name or kind calls for, or null."""
    n = F.lower(name)
    return F.when(n.rlike(r"(^|\.)(txt|text|plaintext)$"), "txt").when(n.rlike(r"(^|\.)pdf$"), "pdf")


# What a failed extraction means for its units.
STATUS = {
    "complete": "complete", "partial": "complete", "unsupported_format": "unsupported", "parser_unavailable": "unsupported", "empty_source": "empty",
    "corrupt_source": "failed", "missing_source": "failed", "permission_denied": "failed", "adapter_failed": "failed",
}


def normalized_extraction(rows: DataFrame, ref: str = "source_ref") -> tuple[DataFrame, DataFrame]:
    """Extracted rows (``source_ref, status, text``) as normalized units, and each source's status.

    Only sound extractions give units, blank ones are dropped; a sound source left with
    none is ``empty``.  An unknown status is a failure.
    """
    known = F.coalesce(*[F.when(F.col("status") == a, F.lit(b)) for a, b in STATUS.items()], F.lit("failed"))
    told = rows.withColumns({"normalized_status": known, "text": X.normalize_text(F.col("text"))})
    units = told.where("normalized_status = 'complete' AND text <> ''").drop("status", "normalized_status")
    kept = F.count(F.when((F.col("normalized_status") == "complete") & (F.col("text") != ""), 1))
    worst = F.max("normalized_status").alias("given")
    status = told.groupBy(ref).agg(worst, kept.alias("n_units"), F.min("status").alias("extraction"))
    sound = F.when((F.col("given") == "complete") & (F.col("n_units") == 0), "empty").otherwise(F.col("given"))
    return units, status.select(ref, sound.alias("status"), "n_units", F.when(~F.col("given").isin("complete"), F.concat(F.lit("extraction_"), F.coalesce("extraction", F.lit("unknown")))).alias("error_reason"))
