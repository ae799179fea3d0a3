"""From envelopes to projections: validation, outcomes, relations, tombstones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import vocabulary as V
from cairn.functions.timestamps import utc_instant
from cairn.operators.components import components
from cairn.scratch import written


def fault(columns: list[str]) -> Column:
    """The first rule that an envelope breaks, or null for a sound one."""
    c = F.col
    blank = lambda n: c(n).isNull() | (F.trim(c(n)) == "")
    tests: list[tuple[Column, str]] = [(c(n).isNull(), f"missing_field:{n}") for n in V.REQUIRED_FIELDS]
    tests += [(blank(n), f"blank:{n}") for n in ("event_id", "trace_id", "source", "sanitized_content_hash")]
    tests.append((c("schema_version") != 1, "schema_version"))
    closed = {"event_type": V.EVENT_TYPES, "lifecycle_status": V.LIFECYCLES, "verification_status": V.VERIFICATIONS, "confidence": V.CONFIDENCES, "sensitivity": V.SENSITIVITIES, "retention": V.RETENTIONS}
    tests += [(~c(n).isin(*values), f"value:{n}") for n, values in closed.items()]
    tests += [(utc_instant(c(n)).isNull(), f"time:{n}") for n in ("created_at", "observed_at")]
    tests.append((c("sequence") < 0, "sequence"))
    if "relation_ids" in columns:
        tests.append((F.exists("relation_ids", lambda x: x.isNull() | (F.trim(x) == "")), "relation_ids"))
    tests.append(((c("event_type") == "verified_state") & c("verification_status").isin("none", "direct_tool_output"), "verified_state_unverified"))
    tests.append(((c("event_type") == "assistant_claim") & (c("verification_status") != "none"), "claim_verified"))
    tests.append(((c("event_type") == "assistant_claim") & (c("lifecycle_status") == "active"), "claim_active"))
    if "deletion" in columns:
        tests.append((c("deletion").isNotNull() & (c("lifecycle_status") != "deleted"), "deletion_block"))
        tests.append((c("deletion").isNotNull() & F.coalesce(F.trim(c("deletion.target_event_id")) == "", F.lit(True)), "deletion_target"))
    if "knowledge_space_ids" in columns:
        ks = c("knowledge_space_ids")
        bad = F.exists(ks, lambda x: x.isNull() | (F.trim(x) == "") | (F.length(x) > V.MAX_SPACE_LENGTH))
        tests.append(((F.size(ks) > V.MAX_SPACES) | bad | (F.size(F.array_distinct(ks)) < F.size(ks)), "knowledge_spaces"))
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for test, code in tests])


#: Lines of a component that one task replays; components beyond it are settled in rounds.
TASK_LINES = 100_000


def _peeled(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are the first both of their id and of their content, and what neither shares with them."""
    first_i = rest.groupBy("i").agg(F.min("p").alias("pi"))
    first_h = rest.groupBy("h").agg(F.min("p").alias("ph"))
    now = written(rest.join(first_i, "i").join(first_h, "h").where("p = pi AND p = ph").select("i", "h", "p"), "accepted")
    return now, written(rest.join(now.select("i"), "i", "left_anti").join(now.select("h"), "h", "left_anti").select("i", "h", "p"), "rest")


def _replayed(table: pa.Table) -> pa.Table:
    """The accepted lines of one component, in order."""
    table = table.sort_by("p")
    ids, contents, kept = set(), set(), []
    for at, (i, h) in enumerate(zip(table.column("i").to_pylist(), table.column("h").to_pylist(), strict=True)):
        if i not in ids and h not in contents:
            ids.add(i)
            contents.add(h)
            kept.append(at)
    return table.take(pa.array(kept, pa.int64())).select(["i", "h", "p"])


def accepted_lines(rows: DataFrame, task_lines: int = TASK_LINES) -> DataFrame:
    """The lines ``i, h, p`` that first-write-wins accepts, over ids and over contents at once.

    Lines whose id and content come once are accepted at once; a log without repeats is grouped twice and never joined.
    Of the others, one round accepts the lines that come first on both sides, which settles logs without crossing repeats and takes
    hot ids and contents away.  What is left hangs together through ids and contents: its components are
    replayed apart, each in its own task.  Only components that are too large for a task go on in rounds.
    """
    many = lambda c: written(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c), "many")
    many_i, many_h = many("i"), many("h")
    void = F.col("i").isNull() | F.col("h").isNull()
    same_i, same_h = rows.where(~void).join(many_i, "i", "left_semi"), rows.where(~void).join(many_i, "i", "left_anti").join(many_h, "h", "left_semi")
    odd = written(same_i.unionByName(same_h).unionByName(rows.where(void)).select("i", "h", "p"), "odd")
    if odd.isEmpty():
        return rows
    once = rows.where(~void).join(many_i, "i", "left_anti").join(many_h, "h", "left_anti").select("i", "h", "p")
    return once.unionByName(_settled(odd, task_lines))


def _settled(rows: DataFrame, task_lines: int) -> DataFrame:
    """The accepted ones of lines that share ids or contents."""
    accepted, rest = _peeled(rows)
    if (left := rest.count()) == 0:
        return accepted
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.select("i", "h", "p").schema)
    if left <= task_lines:
        return accepted.unionByName(rest.withColumn("component", F.lit(0)).groupBy("component").applyInArrow(_replayed, fields))
    # Numbers that meet by chance join two components, which changes no result.
    ends = rest.withColumns({"a": F.xxhash64(F.lit("i"), "i"), "b": F.xxhash64(F.lit("h"), "h")})
    found = components(ends.select("a", "b"))
    told = written(ends.join(found.withColumnRenamed("node", "a"), "a").select("i", "h", "p", "component"), "told")
    sizes = told.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > task_lines).select("component"), "large")
    accepted = accepted.unionByName(told.join(large, "component", "left_anti").groupBy("component").applyInArrow(_replayed, fields))
    rest = written(told.join(large, "component", "left_semi").select("i", "h", "p"), "rest")
    while not rest.isEmpty():
        now, rest = _peeled(rest)
        accepted = accepted.unionByName(now)
    return accepted


def classified(rows: DataFrame, accepted: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """``i, h, p, outcome`` of every line, given the accepted lines; ``contents`` tells contents if the others do not."""
    by_i = accepted.select("i", F.col("h").alias("ih"), F.col("p").alias("ip"))
    by_h = (accepted if contents is None else contents).select("h", F.col("i").alias("hi"), F.col("p").alias("hp"))
    told = rows.join(by_i, "i", "left").join(by_h, "h", "left")
    outcome = (
        F.when((F.col("p") == F.col("ip")) & (F.col("p") == F.col("hp")), "new_event")
        .when((F.col("ip") < F.col("p")) & (F.col("ih") == F.col("h")), "duplicate_event_id")
        .when(F.col("ip") < F.col("p"), "event_id_content_conflict")
        .otherwise("duplicate_content_hash")
    )
    return told.select("i", "h", "p", outcome.alias("outcome"))


def outcomes(lines: DataFrame, ident: str = "event_id", content: str = "content_hash", position: str = "position", task_lines: int = TASK_LINES) -> DataFrame:
    """What becomes of each line: first write wins, over ids and over contents at once.

    A line is accepted if no accepted line before it has its id or its content; the others are told apart by the
    accepted lines before them.
    """
    rows = written(lines.select(F.col(ident).alias("i"), F.col(content).alias("h"), F.col(position).alias("p")), "lines")
    told = classified(rows, written(accepted_lines(rows, task_lines), "accepted"))
    return told.select(F.col("p").alias(position), F.col("i").alias(ident), F.col("h").alias(content), "outcome")


def lifecycle_seed(accepted: DataFrame) -> DataFrame:
    return accepted.select("eid", F.col("lifecycle").alias("current_state"), F.lit("deterministic_check").alias("verifier"), F.col("trace_id").alias("evidence_ref"))


def supersessions(events: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """Within a trace the newest active event supersedes the active one before it.

    With ``deletions`` (``target_id, sequence``) an event that was deleted before the
    next one came is not superseded by it; one that arrives already awaited by a
    deletion supersedes its predecessor and is deleted at once.
    """
    chain = Window.partitionBy("trace_id").orderBy("sequence")
    active = events.where(F.col("lifecycle") == "active")
    if deletions is None:
        return active.select("trace_id", "eid", F.lag("eid").over(chain).alias("supersedes"), F.lead("eid").over(chain).alias("superseded_by"))
    first = deletions.groupBy(F.col("target_id").alias("eid")).agg(F.min("sequence").alias("asked"))
    return chained(active.join(first, "eid", "left")).drop("sequence", "lifecycle", "asked")


def chained(active: DataFrame) -> DataFrame:
    """The chains of active events that know (``asked``) when they are first deleted; one shuffle, by trace."""
    chain = Window.partitionBy("trace_id").orderBy("sequence")
    dated = active.withColumn("gone", F.when(F.col("asked").isNotNull(), F.greatest("asked", "sequence")))
    own, before, behind = F.struct("eid", "gone", "sequence"), F.col("before"), F.col("behind")
    near = dated.select("trace_id", "eid", "gone", "sequence", "lifecycle", "asked", F.lag(own).over(chain).alias("before"), F.lead(own).over(chain).alias("behind"))
    alive = lambda gone, at: gone.isNull() | (gone > at)
    return near.select(
        "trace_id", "eid", "sequence", "lifecycle", "asked", F.when(alive(before["gone"], F.col("sequence")), before["eid"]).alias("supersedes"), F.when(alive(F.col("gone"), behind["sequence"]), behind["eid"]).alias("superseded_by"),
        F.when(F.col("gone").isNotNull(), "deleted").when(behind["eid"].isNotNull(), "superseded").otherwise("active").alias("current_state"),
    )


def child_of(events: DataFrame, parent: str = "parent_trace_id") -> DataFrame:
    """From an event to the earliest event of its parent trace that came before it.

    A running minimum over the parent trace's own order: linear in the events,
    whatever the size of a trace.
    """
    first = F.struct(F.col("sequence").alias("s"), F.col("eid").alias("e"))
    known = events.select(F.col("trace_id").alias("t"), F.col("sequence").alias("p"), F.lit(0).alias("asks"), first.alias("known"), F.lit(None).cast("string").alias("child"))
    asks = events.where(F.col(parent).isNotNull()).select(F.col(parent).alias("t"), F.col("sequence").alias("p"), F.lit(1).alias("asks"), F.lit(None).cast(known.schema["known"].dataType).alias("known"), F.col("eid").alias("child"))
    before = Window.partitionBy("t").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    out = known.unionByName(asks).withColumn("first", F.min("known").over(before)).where("asks = 1 AND first IS NOT NULL")
    return out.select(F.col("child").alias("from_id"), F.lit("child_of").alias("relation"), F.col("first.e").alias("to_id")).where("from_id <> to_id")


def derived_from(events: DataFrame, refs: str = "relation_ids") -> DataFrame:
    """Named relations, to an event of that id or else to the first of that trace."""
    asked = events.select(F.col("eid").alias("from_id"), F.explode(refs).alias("ref"))
    ids = events.select(F.col("eid").alias("ref"), F.col("eid").alias("by_id"))
    traces = events.groupBy(F.col("trace_id").alias("ref")).agg(F.min_by("eid", F.struct("sequence", "eid")).alias("by_trace"))
    to = F.coalesce("by_id", "by_trace")
    out = asked.join(ids, "ref", "left").join(traces, "ref", "left").select("from_id", F.lit("derived_from").alias("relation"), to.alias("to_id"))
    return out.where("to_id IS NOT NULL AND from_id <> to_id").distinct()


def scopes(events: DataFrame) -> DataFrame:
    """Every profile, project and space seen, once, with the event that named it first."""
    seen = (
        events.select(F.lit("profile").alias("scope_type"), F.col("profile_id").alias("scope_id"), "sequence", "eid")
        .unionByName(events.select(F.lit("project").alias("scope_type"), F.col("project_id").alias("scope_id"), "sequence", "eid"))
        .unionByName(events.select(F.lit("knowledge_space").alias("scope_type"), F.explode("spaces").alias("scope_id"), "sequence", "eid"))
    )
    return seen.where("scope_id IS NOT NULL").groupBy("scope_type", "scope_id").agg(F.min_by("eid", F.struct("sequence", "eid")).alias("first_event"))


def first_artifacts(refs: DataFrame) -> DataFrame:
    """The first mention of each artifact id."""
    return refs.groupBy("artifact_id").agg(F.min_by("eid", "sequence").alias("origin_event_id"), F.min("sequence").alias("sequence"))


def tombstones(deletions: DataFrame, events: DataFrame) -> DataFrame:
    """What each deletion does: applied, applied when its target arrived, or pending."""
    target = events.select(F.col("eid").alias("target_id"), F.col("sequence").alias("target_sequence"), F.col("trace_id").alias("target_trace"))
    out = deletions.join(target, "target_id", "left")
    late = F.col("target_sequence") > F.col("sequence")
    status = F.when(F.col("target_sequence").isNull(), "pending").when(late, "applied_on_arrival").otherwise("applied")
    return out.select("deletion_id", "target_id", "sequence", status.alias("status"), F.when(~late, F.col("target_trace")).alias("target_trace_id"))


def deletion_audit(tombs: DataFrame) -> DataFrame:
    """One audit row for each deletion, a second one where the target came late."""
    first = F.when(F.col("status") == "applied", "").otherwise("target_not_yet_present")
    rows = tombs.select("deletion_id", "target_id", first.alias("detail"))
    late = tombs.where("status = 'applied_on_arrival'").select("deletion_id", "target_id", F.lit("").alias("detail"))
    return rows.unionByName(late)


def dense_numbers(rows: DataFrame, order: list[str], name: str, start: Column | None = None) -> DataFrame:
    """Rows numbered without gaps in a total order, from one behind ``start``.

    Ordered ranges number their own rows; only the ranges' counts are added up.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    number = F.col("__before") + own + (start if start is not None else F.lit(0))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, number.cast("long")).drop("__range", "__before")


def append_receipts(log: DataFrame, batch: DataFrame) -> DataFrame:
    """What an append does with each event of a batch: ``eid, outcome, basis, sequence``.

    ``log`` has ``eid, content_hash, sequence``; ``batch`` has those columns with
    ``position`` in place of the sequence, and ``sensitivity, retention,
    redaction_audit``.  Events that may never be stored or lack an audit are rejected;
    an id or else a content that the log or an accepted earlier event holds is a
    duplicate and gets that one's sequence; the rest follow the log without gaps.
    """
    c = F.col
    why = F.when((c("sensitivity") == "secret") | (c("retention") == "never_store"), "never_store_policy").when(c("redaction_audit").isNull(), "missing_redaction_audit")
    told = written(batch.select("eid", "content_hash", "position", why.alias("why")), "batch")
    sound = told.where("why IS NULL").drop("why")
    by_id = log.groupBy("eid").agg(F.min("sequence").alias("seq_id"))
    by_hash = log.groupBy("content_hash").agg(F.min("sequence").alias("seq_hash"))
    known = sound.join(by_id, "eid", "left").join(by_hash, "content_hash", "left")
    fresh = known.where("seq_id IS NULL AND seq_hash IS NULL").select("eid", "content_hash", "position")
    first = outcomes(fresh, "eid", "content_hash", "position")
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(-1))).scalar()
    new = written(dense_numbers(first.where("outcome = 'new_event'").select("eid", "content_hash", "position"), ["position"], "sequence", last), "appended")
    again = known.join(new.select("position"), "position", "left_anti")
    again = again.join(new.select("eid", F.col("sequence").alias("si"), F.col("position").alias("pi")), "eid", "left").join(new.select("content_hash", F.col("sequence").alias("sh")), "content_hash", "left")
    by_event = F.coalesce(c("seq_id"), F.when(c("pi") < c("position"), c("si")))
    receipt = lambda outcome, basis, sequence: ["eid", "position", F.lit(outcome).alias("outcome"), basis.cast("string").alias("basis"), sequence.cast("long").alias("sequence")]
    return (
        told.where("why IS NOT NULL").select(*receipt("rejected", c("why"), F.lit(None)))
        .unionByName(again.select(*receipt("duplicate", F.when(by_event.isNotNull(), "event_id").otherwise("content_hash"), F.coalesce(by_event, "seq_hash", "sh"))))
        .unionByName(new.select(*receipt("appended", F.lit(None), c("sequence"))))
    )


def project_rows(log: DataFrame, origin: str) -> DataFrame:
    """Sound envelopes as the 24 columns of the event table; absent identities stay null."""
    plain = ["event_id", "trace_id", "event_type", "source", "schema_version", "created_at", "observed_at", "sequence", "session_id", "profile_id", "project_id", "task_id", "turn_id", "parent_trace_id", "lifecycle_status", "verification_status", "confidence", "sensitivity", "retention"]
    audited = F.coalesce(F.trim("redaction_audit"), F.lit("")).isin("", "{}", "[]", "null", "false", "0")
    return log.where("fault IS NULL").select(
        *plain, F.col("sanitized_content_hash").alias("content_hash"), F.when(audited, 0).otherwise(1).alias("redaction_applied"),
        F.current_timestamp().alias("ingested_at"), F.lit(origin).alias("origin_jsonl"), F.get("knowledge_space_ids", F.lit(0)).alias("knowledge_space_id"),
    )


def projections(events: DataFrame) -> dict[str, DataFrame]:
    """Every table that is derived from the log, by name.

    ``events`` has the columns of reads and ``parent_trace_id, relation_ids,
    artifact_refs, tombstone_target``.
    """
    deletions = events.where("tombstone_target IS NOT NULL").select(F.col("eid").alias("deletion_id"), F.col("tombstone_target").alias("target_id"), "sequence")
    # Several tables are made of these two, with other columns each time, so no shuffle of theirs would be shared.
    tombs = written(tombstones(deletions, events), "tombs")
    chain = written(supersessions(events, deletions), "chain")
    gone = tombs.where("status <> 'pending'").select(F.col("target_id").alias("eid"))
    state = chain.select("eid", "superseded_by", F.col("current_state").alias("state"))
    life = events.join(state, "eid", "left").join(gone.distinct().withColumn("gone", F.lit(True)), "eid", "left")
    refs = events.select("eid", "sequence", F.explode("artifact_refs").alias("r")).select("eid", "sequence", F.col("r.artifact_id").alias("artifact_id"))
    supersedes = chain.where("supersedes IS NOT NULL").select(F.col("eid").alias("from_id"), F.lit("supersedes").alias("relation"), F.col("supersedes").alias("to_id"))
    return {
        "artifacts": first_artifacts(refs.where("artifact_id IS NOT NULL")),
        "deletion_audit": deletion_audit(tombs),
        "lifecycle": life.select("eid", F.when(F.col("gone"), "deleted").otherwise(F.coalesce("state", "lifecycle")).alias("current_state"), "superseded_by"),
        "meta": events.select("eid", "trace_id", "lifecycle", "verification"),
        "postings": events.join(gone, "eid", "left_anti").select("eid", "content"),
        "provenance": events.select("eid", "verification", F.lit("deterministic_check").alias("verifier"), F.col("trace_id").alias("evidence_ref")),
        "relations": child_of(events).unionByName(derived_from(events)).unionByName(supersedes),
        "scopes": scopes(events),
        "tombstones": tombs.select("deletion_id", "target_id", "status"),
    }
