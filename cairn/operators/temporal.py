"""Two time dimensions: when a fact was recorded, and when it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = "resource_type string, resource_id string, created_at string, effective_at string, valid_from string, valid_until string, lifecycle_status string"


def index(*sources: DataFrame) -> DataFrame:
    """One table out of sources that may lack columns; unknown times stay null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    for field in FACTS.split(", "):
        name, kind = field.split()
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(*[f.split()[0] for f in FACTS.split(", ")]).withColumn("lifecycle_status", F.coalesce("lifecycle_status", F.lit("candidate")))


def as_of(dimension: str, when: str) -> Column:
    """Facts known at, or holding at, an instant; times are sortable UTC texts.

    Validity is a point if there is an effective time, else ``[from, until)`` with
    open ends; without any valid time nothing holds.
    """
    at = F.lit(when)
    if dimension == "transaction":
        return F.coalesce(F.col("created_at") <= at, F.lit(False))
    none = F.col("valid_from").isNull() & F.col("valid_until").isNull()
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))
    return F.when(F.col("effective_at").isNotNull(), F.col("effective_at") == at).when(none, False).otherwise(inside)


def within(dimension: str, start: str | None, end: str | None) -> Column:
    """Facts whose time lies in ``[start, end)``; unknown times never do."""
    value = F.col("created_at") if dimension == "transaction" else F.coalesce("effective_at", "valid_from")
    out = value.isNotNull()
    if start is not None:
        out = out & (value >= F.lit(start))
    if end is not None:
        out = out & (value < F.lit(end))
    return out


def has_valid_time() -> Column:
    return F.col("effective_at").isNotNull() | F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull()


def annotate(items: DataFrame, facts: DataFrame, when: str) -> DataFrame:
    """Selected items with their times and whether they hold at an instant."""
    keyed = facts.select("resource_type", "resource_id", "created_at", "effective_at", "valid_from", "valid_until").withColumn("holds", as_of("valid", when))
    return items.join(keyed, ["resource_type", "resource_id"], "left")


def annotate_allowed(items: DataFrame, facts: DataFrame, allowed: DataFrame, when: str) -> tuple[DataFrame, DataFrame]:
    """Annotated items that ``allowed(resource_type, resource_id)`` names, and how many were denied.

    A denied item is counted but never shown, nor are its times.
    """
    keys = ["resource_type", "resource_id"]
    told = items.join(allowed.select(*keys).distinct().withColumn("allowed", F.lit(True)), keys, "left")
    denied = told.agg(F.count(F.when(F.col("allowed").isNull(), 1)).alias("denied"))
    return annotate(told.where("allowed").drop("allowed"), facts, when), denied


# ------------------------------------------------------- many instants at once


def interval_bins(facts: DataFrame, begin: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """``level, bin`` beside facts with ``[begin, end)``: an index for any number of instants.

    An interval's level is the least power of two of microseconds not below its length, so it falls into at most
    two bins of that level.  Intervals open on a side have a level of their own (-1) and meet every instant, about half
    of which they hold at; empty ones drop out.
    """
    at = lambda c: F.unix_micros(F.to_timestamp(F.col(c)))
    rows = facts.withColumns({"__begin": at(begin), "__end": at(end)})
    open_ = F.col("__begin").isNull() | F.col("__end").isNull()
    length = F.col("__end") - F.col("__begin")
    level = F.when(open_, -1).otherwise(F.ceil(F.log2(length.cast("double")))).cast("int")
    rows = rows.where(open_ | (length > 0)).withColumn("level", level)
    spread = F.when(F.col("level") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(F.expr("shiftright(__begin, level)"), F.expr("shiftright(__end - 1, level)"))))
    return rows.withColumn("bin", F.explode(spread))


def holding_at(binned: DataFrame, instants: DataFrame, instant: str = "instant") -> DataFrame:
    """Every fact of an index of intervals at every one of many instants: equal joins of levels and bins only.

    An instant meets one bin of each level that the facts have; a bin holds no more than what begins within twice its
    length, so what is met is close to what holds.
    """
    levels = binned.where("level >= 0").select("level").distinct()
    at = F.unix_micros(F.to_timestamp(F.col(instant)))
    asked = instants.withColumn("__at", at).where("__at IS NOT NULL")
    every = asked.crossJoin(F.broadcast(levels)).withColumn("bin", F.expr("shiftright(__at, level)"))  # at most 63 levels
    every = every.unionByName(asked.withColumns({"level": F.lit(-1), "bin": F.lit(0).cast("long")}))
    met = every.join(binned, ["level", "bin"])
    inside = (F.col("__begin").isNull() | (F.col("__begin") <= F.col("__at"))) & (F.col("__end").isNull() | (F.col("__at") < F.col("__end")))
    return met.where(inside).drop("level", "bin", "__at", "__begin", "__end")
