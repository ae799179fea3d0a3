"""Project records: operation logs replayed into decisions, states and checks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.components import components
from cairn.operators.relational import first_by, page
from cairn.scratch import written


def _apart(key: list[str], ident: str) -> Column:
    """Tells records with a null in their key from each other."""
    return F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key]), F.col(ident))


def supersede_chain(ops: DataFrame, key: list[str], order: list[str], ident: str, status: str) -> DataFrame:
    """Create-then-supersede logs: each record's links, and its state at the end.

    The newest record of a key keeps its own status; all before it are superseded.
    Keys that are null in any part never meet: such a record is a chain of its own.
    """
    chain = Window.partitionBy(*key, _apart(key, ident)).orderBy(*order)
    after = F.lead(ident).over(chain)
    return ops.withColumns({
        "supersedes_id": F.lag(ident).over(chain),
        "replaced_by": after,
        "version": F.row_number().over(chain).cast("long"),
        "lifecycle_status": F.when(after.isNotNull(), "superseded").otherwise(F.col(status)),
    })


def state_history(ops: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Retire-then-insert per key; an operation that repeats the active value does nothing.

    Keys that are null in any part never meet; ``order`` tells every two operations of a key apart.
    """
    apart = F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key]), F.xxhash64(*order))
    chain = Window.partitionBy(*key, apart).orderBy(*order)
    changed = ops.withColumn("__before", F.lag(value).over(chain)).where(~F.col(value).eqNullSafe(F.col("__before")))
    now = Window.partitionBy(*key, apart).orderBy(*order)
    end = F.lead(order[0]).over(now)
    return changed.drop("__before").withColumns({"version": F.row_number().over(now).cast("long"), "valid_until": end, "lifecycle_status": F.when(end.isNull(), "active").otherwise("superseded")})


def latest(ops: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last content of each key."""
    return first_by(ops, key, [F.desc(c) for c in order])


def linked(records: DataFrame, ident: str, links: str, others: DataFrame, other_id: str) -> DataFrame:
    """Records with each existing record that their comma or JSON list names."""
    from cairn.functions.text import link_list

    named = records.select(ident, F.explode(link_list(F.col(links))).alias(other_id))
    return named.join(others, other_id)


REPLAY = "key string, decision_id string, lifecycle_status string, statement string, supersedes_id string, replaced_by string, outcome string, position long"


def replay_decisions(ops: DataFrame) -> DataFrame:
    """The whole operation grammar, key by key, in log order.

    ``ops`` has ``key, position, op, decision_id, lifecycle_status, statement,
    supersedes_id``.  Every operation yields a row with its outcome (created,
    transitioned, superseded, deleted, noop, conflict, rejected) and the record as
    it stands at the end of the log.  Records that supersede each other share a
    key, so a key's log is the largest thing that a task holds.  Null keys never meet: each
    record without a key is replayed with those that it supersedes only.  Keys pass in sorted
    batches, however many there are.
    """
    fields = ("lifecycle_status", "statement", "supersedes_id", "replaced_by")
    names = [c.split()[0] for c in REPLAY.split(", ")]

    def one(log, unique):
        now: dict[str, dict] = {}
        active: set[str] = set()
        out = []
        for r in log:
            have, ident = now.get(r["decision_id"]), r["decision_id"]
            wants = r["lifecycle_status"] or "candidate"
            others = active - {ident, r["supersedes_id"] if r["op"] == "supersede" else ident} if wants == "active" and r["op"] != "create" else active
            if r["op"] == "create":
                if have is not None:
                    same = have["statement"] == r["statement"] and have["lifecycle_status"] == wants
                    outcome = "noop" if same else "rejected"
                elif wants == "active" and active:
                    outcome = "conflict"
                else:
                    now[ident], outcome = {"lifecycle_status": wants, "statement": r["statement"], "supersedes_id": None, "replaced_by": None}, "created"
            elif r["op"] == "supersede":
                old = now.get(r["supersedes_id"])
                if old is None:
                    outcome = "rejected"
                elif have is not None:
                    outcome = "noop"
                elif wants == "active" and others:
                    outcome = "conflict"
                else:
                    old["lifecycle_status"], old["replaced_by"] = "superseded", ident
                    now[ident], outcome = {"lifecycle_status": wants, "statement": r["statement"], "supersedes_id": r["supersedes_id"], "replaced_by": None}, "superseded"
            elif have is None:
                outcome = "rejected"
            elif r["op"] == "transition":
                if have["lifecycle_status"] == "deleted" and wants != "deleted":
                    outcome = "rejected"
                elif wants == "active" and others:
                    outcome = "conflict"
                else:
                    have["lifecycle_status"], outcome = wants, "transitioned"
                    have["statement"] = r["statement"] if r["statement"] is not None else have["statement"]
            elif r["op"] == "delete":
                have["lifecycle_status"], outcome = "deleted", "deleted"
            else:
                outcome = "rejected"
            for d in (ident, r["supersedes_id"]):
                if unique and d in now:
                    (active.add if now[d]["lifecycle_status"] == "active" else active.discard)(d)
            out.append((ident, outcome, r["position"]))
        key, none = log[0]["key"], dict.fromkeys(fields)
        for i, o, p in out:
            end = now.get(i) or none
            yield (key, i, end["lifecycle_status"], end["statement"], end["supersedes_id"], end["replaced_by"], o, p)

    def run(unique):
        def replay(batches):
            def made(rows):
                kinds = [pa.string()] * 7 + [pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

            group, log = object(), []
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if r["group"] != group:
                        rows += one(log, unique) if log else []
                        group, log = r["group"], []
                    log.append(r)
                yield made(rows)
            yield made(list(one(log, unique)) if log else [])

        return replay

    log = written(ops.select("key", "position", "op", "decision_id", "lifecycle_status", "statement", "supersedes_id"), "log")
    replayed = lambda rows, unique: rows.repartition("group").sortWithinPartitions("group", "position").mapInArrow(run(unique), REPLAY)
    keyed = replayed(log.where("key IS NOT NULL").withColumn("group", F.col("key")), True)
    if (loose := log.where("key IS NULL")).isEmpty():
        return keyed
    # Without a key several may be active, so what is active never stands in the way.
    return keyed.unionByName(replayed(_linked_groups(loose, "decision_id", "supersedes_id"), False))


def _linked_groups(log: DataFrame, ident: str, link: str) -> DataFrame:
    """A log with ``group``, one for all records that links hold together."""
    node = lambda c: F.xxhash64(c)
    log = written(log, "log")
    found = components(log.where(F.col(link).isNotNull()).select(node(ident).alias("a"), node(link).alias("b")))
    found = found.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return log.join(found, node(ident) == F.col("__node"), "left").withColumn("group", F.coalesce("__component", node(ident))).drop("__node", "__component")


REQUIREMENT_FIELDS = ("statement", "lifecycle_status", "state", "verification_status", "linked_decision_ids", "linked_artifact_ids", "linked_verification_ids")
REQUIREMENT = "requirement_id string, position long, outcome string, " + ", ".join(f"{f} string" for f in REQUIREMENT_FIELDS) + ", supersedes string, replaced_by string"


def replay_requirements(ops: DataFrame) -> DataFrame:
    """The requirement grammar in log order: each operation's outcome and its requirement after it.

    ``ops`` has ``position, op, requirement_id, supersedes, replaced_by`` and ``REQUIREMENT_FIELDS``.  Outcomes are
    created, transitioned, superseded, deleted, noop and rejected.  A create of equal content and a repeated
    supersession do nothing; a deleted requirement changes only by being superseded.  Requirements that links hold
    together are replayed in order, by sorted batches; only their latest rows are kept.
    """
    held = [*REQUIREMENT_FIELDS, "supersedes", "replaced_by"]
    columns = [c.split()[0] for c in REQUIREMENT.split(", ")]

    def run(batches):
        group, now = object(), {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["group"] != group:
                    group, now = r["group"], {}
                have, prior, op = now.get(r["requirement_id"]), now.get(r["supersedes"]), r["op"]
                outcome = "rejected"
                if op == "create":
                    same = have is not None and all(have[f] == (r[f] or None) for f in REQUIREMENT_FIELDS[:4])
                    outcome = "created" if have is None else "noop" if same else "rejected"
                elif op == "supersede" and prior is not None:
                    outcome = "superseded" if have is None else "noop"
                elif op == "transition" and have is not None and (have["lifecycle_status"] != "deleted" or r["lifecycle_status"] == "deleted"):
                    outcome = "transitioned"
                elif op == "delete" and have is not None:
                    outcome = "deleted"
                if outcome in ("created", "superseded"):
                    now[r["requirement_id"]] = {f: r[f] for f in held}
                if outcome == "superseded":
                    prior["lifecycle_status"], prior["replaced_by"] = "superseded", r["requirement_id"]
                elif outcome == "transitioned":
                    have |= {f: r[f] for f in REQUIREMENT_FIELDS[1:4]} | {f: r[f] for f in held if f not in REQUIREMENT_FIELDS[1:4] and r[f] is not None}
                elif outcome == "deleted":
                    have["lifecycle_status"] = "deleted"
                after = now.get(r["requirement_id"]) or dict.fromkeys(held)
                out.append((r["requirement_id"], r["position"], outcome, *(after[f] for f in held)))
            kinds = [pa.string(), pa.int64(), *[pa.string()] * (1 + len(held))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(columns), kinds, strict=True)], names=columns)

    log = _linked_groups(ops.select("position", "op", "requirement_id", *held), "requirement_id", "supersedes")
    return log.repartition("group").sortWithinPartitions("group", "position").mapInArrow(run, REQUIREMENT)


STATE_FIELDS = ("state_value", "state_ref", "lifecycle_status", "verification_status", "effective_at")
STATE = "project_id string, scope string, state_key string, position long, outcome string, row long, active long, state_value string, lifecycle_status string"


def replay_states(ops: DataFrame) -> DataFrame:
    """The grammar of current states in log order: each operation's outcome, the row it wrote, and the active row after it.

    ``ops`` has ``position, op, project_id, scope, state_key`` and ``STATE_FIELDS``.  A row is named by the position
    that inserted it.  A create on an active key with other content is a conflict and keeps the old row (unless it is
    not active itself); an update or supersession retires the active row.  Null keys never meet: such creates and
    updates always insert, the rest is rejected.
    """
    columns = [c.split()[0] for c in STATE.split(", ")]
    key = ("project_id", "scope", "state_key")
    same = STATE_FIELDS[:4]

    def run(batches):
        group, active = object(), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                loose = r["state_key"] is None
                if (own := tuple(r[c] for c in key)) != group or loose:
                    group, active = own, None
                op, outcome, row = r["op"], "rejected", None
                equal = active is not None and all(active[f] == (r[f] or None) for f in same)
                if op in ("create", "update") or (op == "supersede" and active is not None):
                    if equal:
                        outcome, row = "noop", active["row"]
                    elif op == "create" and active is not None and r["lifecycle_status"] == "active":
                        outcome = "conflict"
                    else:
                        outcome, row = "superseded" if op == "supersede" else "created", r["position"]
                        if op != "create":
                            active = None
                        if r["lifecycle_status"] == "active":
                            active = {f: r[f] for f in STATE_FIELDS} | {"row": row}
                elif op == "transition" and active is not None:
                    outcome, row = "transitioned", active["row"]
                    active |= {f: r[f] for f in ("lifecycle_status", "verification_status")} | {f: r[f] for f in ("state_value", "state_ref", "effective_at") if r[f] is not None}
                    active = active if active["lifecycle_status"] == "active" else None
                elif op == "delete" and active is not None:
                    outcome, row, active = "deleted", active["row"], None
                now = active or {}
                out.append((*own, r["position"], outcome, row, now.get("row"), now.get("state_value"), now.get("lifecycle_status")))
                if loose:
                    active = None
            kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(columns), kinds, strict=True)], names=columns)

    # Operations without a key need no order among themselves and are dealt by their position.
    spread = F.when(F.col("state_key").isNull(), F.col("position"))
    log = ops.select("position", "op", *key, *STATE_FIELDS)
    return log.repartition(*key, spread).sortWithinPartitions(*key, "position").mapInArrow(run, STATE)


def active_conflicts(records: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one active record, which the model forbids."""
    return records.where(F.col("lifecycle_status") == "active").groupBy(*key).agg(F.count(F.lit(1)).alias("n_active")).where("n_active > 1")


def charters(ops: DataFrame, order: list[str], ident: str) -> DataFrame:
    """Every create or update is a new version; the last one of a project is active.

    A project's log is cut into ordered ranges; each range's count and outermost
    rows are carried to its neighbours, so no task holds a whole project.
    ``order`` tells every two operations of a project apart.
    """
    width = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(ops.repartitionByRange(width, "project_id", *order).withColumn("__range", F.spark_partition_id()), "charters")
    chain = Window.partitionBy("project_id", "__range").orderBy(*order)
    ends = ranged.groupBy("project_id", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min_by(ident, F.struct(*order)).alias("__first"), F.max_by(ident, F.struct(*order)).alias("__last"))
    along = Window.partitionBy("project_id").orderBy("__range")
    carried = ends.select(
        F.col("project_id").alias("__project"), F.col("__range").alias("__at"), F.lag("__last").over(along).alias("__before"), F.lead("__first").over(along).alias("__after"),
        F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
    )
    local = ranged.withColumns({"__row": F.row_number().over(chain), "__lag": F.lag(ident).over(chain), "__lead": F.lead(ident).over(chain)})
    known = local.join(carried, (F.col("__range") == F.col("__at")) & F.col("project_id").eqNullSafe(F.col("__project")))
    return known.select(
        *ops.columns, (F.col("__offset") + F.col("__row")).cast("long").alias("version"), F.coalesce("__lag", "__before").alias("supersedes"),
        F.when(F.coalesce("__lead", "__after").isNull(), "active").otherwise("superseded").alias("lifecycle_status"),
    )


CHARTER = "project_id string, charter_id string, position long, outcome string, version long, lifecycle_status string, state string, content string"


def replay_charters(ops: DataFrame) -> DataFrame:
    """The charter grammar in log order: each operation's outcome and its charter after it.

    ``ops`` has ``project_id, position, op, charter_id, supersedes, version,
    lifecycle_status, state, content``.  Outcomes are created, versioned,
    transitioned, deleted, noop, conflict (a second active charter) and rejected.
    A project's log passes in sorted batches; only its charters are kept.
    """
    columns = [c.split()[0] for c in CHARTER.split(", ")]

    def run(batches):
        import pandas as pd

        project, now, active = object(), {}, set()
        for batch in batches:
            out = []
            for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if r["project_id"] != project:
                    project, now, active = r["project_id"], {}, set()
                ident, status = r["charter_id"], r["lifecycle_status"]
                have, prior = now.get(ident), now.get(r["supersedes"])
                clash = lambda *own: status == "active" and bool(active - set(own))  # noqa: E731, B023
                new, outcome = {"version": 1 if r["version"] is None else int(r["version"]), "lifecycle_status": status, "state": r["state"], "content": r["content"]}, "rejected"
                same = have is not None and all(have[f] == new[f] for f in ("lifecycle_status", "state", "content"))
                if r["op"] == "create":
                    outcome = ("noop" if same else "rejected") if have else "conflict" if clash() else "created"
                elif r["op"] == "supersede" and prior:
                    outcome = "noop" if have else "conflict" if clash(r["supersedes"]) else "versioned"
                    if outcome == "versioned":
                        prior["lifecycle_status"] = "superseded"
                        active.discard(r["supersedes"])
                elif r["op"] == "update" and have:
                    outcome = "noop" if same else "conflict" if clash(ident) else "versioned"
                    new["version"] = have["version"] + 1
                elif r["op"] in ("transition", "delete") and have and (have["lifecycle_status"] != "deleted" or status == "deleted"):
                    outcome = "conflict" if clash(ident) else "deleted" if r["op"] == "delete" else "transitioned"
                    new = have | {"lifecycle_status": status, "state": r["state"]}
                if outcome in ("created", "versioned", "transitioned", "deleted"):
                    now[ident] = new
                    (active.add if status == "active" else active.discard)(ident)
                after = now.get(ident) or dict.fromkeys(("version", "lifecycle_status", "state", "content"))
                out.append((project, ident, r["position"], outcome, *(after[f] for f in ("version", "lifecycle_status", "state", "content"))))
            frame = pd.DataFrame(out, columns=columns)
            frame["version"] = frame["version"].astype("Int64")
            yield frame

    log = ops.select("project_id", "position", "op", "charter_id", "supersedes", "version", "lifecycle_status", "state", "content")
    return log.repartition("project_id").sortWithinPartitions("project_id", "position").mapInPandas(run, CHARTER)


def partial_updates(ops: DataFrame, key: str, position: str, fields: list[str], op: str = "op") -> DataFrame:
    """Transitions that carry only some fields: each field's last value, up to a deletion.

    Deletion is final: what comes after it changes nothing.  Two grouped passes
    that pre-aggregate, no per-key log.
    """
    ends = ops.where(F.col(op) == "delete").groupBy(key).agg(F.min(position).alias("__end"))
    live = ops.join(ends, key, "left").where(F.col("__end").isNull() | (F.col(position) <= F.col("__end")))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in fields]
    return live.groupBy(key).agg(*last, F.count(F.lit(1)).alias("n_ops"), F.max(F.col("__end").isNotNull()).alias("deleted"))


def registered_artifacts(refs: DataFrame, registry: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """The last reference of each artifact that the registry knows, and the unknown ones."""
    known = refs.join(registry.select("artifact_id").distinct(), "artifact_id", "left_semi")
    unknown = refs.join(registry.select("artifact_id").distinct(), "artifact_id", "left_anti")
    return first_by(known, ["artifact_id"], [F.desc(position)]), unknown.select("artifact_id").distinct()


# Record domains and the field that holds each one's identity.
IDENTITIES = {"charter": "charter_id", "requirement": "requirement_id", "decision": "decision_id", "state": "state_key", "verification": "verification_id", "artifact": "artifact_id"}
BLOCK = (
    "domain string, identity string, project_id string, op string, lifecycle_status string, state string, state_key string, content string, statement string,"
    " version long, supersedes string, verification_status string, subject_id string, links array<string>"
)


def operations(events: DataFrame, block: str = "record") -> DataFrame:
    """Operations out of events: their kind, domain fields, provenance and fault.

    ``block`` is the event's JSON block of record fields.  Its declared domain tells
    the kind and its identity becomes the domain's id; nothing is inferred from the
    event's type or trace, which are carried as provenance.  Events without a block
    are ``not_a_record``; a block of a known domain without identity, project or
    operation is ``invalid_record``, which a strict replay refuses.
    """
    r = lambda name: F.col(f"r.{name}")
    known = r("domain").isin(*IDENTITIES)
    ident = F.when(r("domain") == "state", F.coalesce(r("state_key"), r("identity"))).otherwise(r("identity"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    broken = blank(ident) | blank(r("project_id")) | blank(r("op"))
    kind = F.when(~F.coalesce(known, F.lit(False)), "not_a_record").when(broken, "invalid_record").otherwise(r("domain"))
    rows = events.withColumn("r", F.from_json(block, BLOCK))
    return rows.select(
        kind.alias("kind"), F.when(kind.isin(*IDENTITIES), ident).alias("identity"), *[r(n).alias(n) for n in ("project_id", "op", "lifecycle_status", "state", "content", "statement", "version", "supersedes", "verification_status", "subject_id", "links")],
        F.col("eid").alias("source_event_id"), "trace_id", "session_id", "profile_id", "created_at", "sequence", F.col("event_type").alias("derived_from_event_type"),
    )


def strict_operations(ops: DataFrame) -> DataFrame:
    """The operations of records; an invalid one is an error that stops the replay before it writes."""
    bad = ops.where("kind = 'invalid_record'").agg(F.min("source_event_id").alias("e")).first()["e"]
    if bad is not None:
        raise ValueError(f"invalid_record in {bad}")
    return ops.where("kind <> 'not_a_record'")


def replay_summary(ops: DataFrame) -> DataFrame:
    """Operations projected and skipped by kind."""
    return ops.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("identity").alias("identities"))


#: The total order in which each kind of record is listed, and what it may be filtered by.
SORTS = {
    "requirement": (["requirement_id", "created_at"], ("state", "lifecycle_status")),
    "decision": (["decision_id", "effective_at"], ("lifecycle_status", "scope", "decision_key")),
    "verification": (["verification_id", "timestamp"], ("subject_type", "subject_id", "verification_status")),
    "artifact": (["artifact_id", "created_at"], ("lifecycle_status",)),
    "state": (["state_key", "effective_at"], ("lifecycle_status", "scope")),
}


def listed(records: DataFrame, kind: str, project: str, limit: int = 50, cursor: dict | None = None, **filters) -> DataFrame:
    """A page of a project's records of one kind, in the kind's own order.

    Deleted records are left out unless a lifecycle is asked for.  A scope is compared
    with nulls as values, so ``scope=None`` asks for records without one.
    """
    if not isinstance(project, str) or not project.strip():
        raise ValueError("project required")
    order, known = SORTS[kind]
    if unknown := sorted(set(filters) - set(known)):
        raise ValueError(f"no filter {unknown[0]!r} for a {kind}")
    rows = records.where(F.col("project_id") == project)
    for name, value in filters.items():
        if name == "scope":
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        elif value is not None:
            rows = rows.where(F.col(name) == value)
    if filters.get("lifecycle_status") is None and "lifecycle_status" in records.columns:
        rows = rows.where(F.col("lifecycle_status") != "deleted")
    return page(rows, order, limit, cursor)


def with_artifacts(registered: DataFrame, registry: DataFrame) -> DataFrame:
    """A project's artifacts with what the registry knows of them; unknown ones keep nulls."""
    return registered.join(registry, "artifact_id", "left")
