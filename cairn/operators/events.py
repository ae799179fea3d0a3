"""Structured reads over events: filters, deletion, pages, traces, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import vocabulary as V
from cairn.operators.relational import page

ORDER = ["created_at", "eid"]
EQUAL = ("eid", "trace_id", "session_id", "profile_id", "project_id", "event_type", "lifecycle", "verification", "sensitivity", "source", "task_id", "turn_id", "confidence", "retention")


def condition(**wanted) -> Column:
    """Equality filters and inclusive text ranges, all of which must hold.

    Ranges are ``created_from``, ``created_to``, ``observed_from``, ``observed_to``.
    Unknown names and vocabulary values are errors, as is asking for deleted rows.
    """
    out = F.lit(True)
    for name, value in wanted.items():
        if name in EQUAL:
            vocabulary = {"event_type": V.EVENT_TYPES, "lifecycle": V.LIFECYCLES, "verification": V.VERIFICATIONS, "sensitivity": V.SENSITIVITIES}.get(name)
            if vocabulary and value not in vocabulary:
                raise ValueError(f"unknown {name}: {value}")
            if name == "lifecycle" and value == "deleted":
                raise ValueError("deleted events cannot be asked for")
            out = out & (F.col(name) == F.lit(value))
        elif name.rpartition("_")[2] in ("from", "to") and name.rpartition("_")[0] in ("created", "observed"):
            column = F.col(f"{name.rpartition('_')[0]}_at")
            out = out & (column >= F.lit(value) if name.endswith("from") else column <= F.lit(value))
        else:
            raise ValueError(f"unknown filter: {name}")
    return out


def deleted_ids(events: DataFrame) -> DataFrame:
    """Ids whose current state is deleted: by their own lifecycle or by a tombstone."""
    own = events.where(F.col("lifecycle") == "deleted").select("eid")
    if "tombstone_target" in events.columns:
        own = own.unionByName(events.where(F.col("tombstone_target").isNotNull()).select(F.col("tombstone_target").alias("eid"))).distinct()
    return own


def visible(events: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Events that are not deleted."""
    return events.join(deleted if deleted is not None else deleted_ids(events), "eid", "left_anti")


def query(events: DataFrame, limit: int = 50, cursor: dict | None = None, secured: Column | None = None, look_ahead: bool = False, **wanted) -> DataFrame:
    """A page of visible events; the scope is applied before order and limit."""
    rows = events.where(condition(**wanted))
    if secured is not None:
        rows = rows.where(secured)
    return page(visible(rows, deleted_ids(events)), ORDER, limit, cursor, look_ahead)


def total(events: DataFrame, **wanted) -> DataFrame:
    return visible(events.where(condition(**wanted)), deleted_ids(events)).agg(F.count(F.lit(1)).alias("total"))


def in_space(events: DataFrame, space: str) -> DataFrame:
    """Visible events that belong to a knowledge space, whatever their first one is."""
    return visible(events.where(F.array_contains("spaces", space)), deleted_ids(events))


def junction(events: DataFrame) -> DataFrame:
    """One row for each event and space."""
    return events.select("eid", F.explode(F.array_distinct("spaces")).alias("space"))
