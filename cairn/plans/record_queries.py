"""Catalogue: ingest projections, project records, graph and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import ingest as N
from cairn.operators import records as R
from cairn.operators import temporal as T
from cairn.plans import views as V
from cairn.plans.registry import Area
from cairn.scratch import written

area = Area()
query = area.query

# ----------------------------------------------------------------------- ingest


@query()
def ingest_outcomes(spark, sf):
    """The log followed by every ninth line again: as it was, or with another's content."""
    e = V.events(spark, sf).select("eid", F.sha2("content", 256).alias("content_hash"), F.col("sequence").alias("position"))
    again = e.where("position % 9 = 0").select("eid", F.when(F.col("position") % 2 == 0, F.col("content_hash")).otherwise(F.sha2(F.concat("content_hash", F.lit("x")), 256)).alias("content_hash"), (F.col("position") + 1_000_000_000).alias("position"))
    return N.outcomes(e.unionByName(again), ident="eid").select("position", "eid", "outcome")


@query("SELECT trace_id, eid, lag(eid) OVER w AS supersedes, lead(eid) OVER w AS superseded_by FROM v_events WHERE lifecycle = 'active' WINDOW w AS (PARTITION BY trace_id ORDER BY sequence)", V.EVENTS)
def supersession_chain(spark, sf):
    return N.supersessions(V.events(spark, sf))


PARENT = "v_child AS (SELECT *, CASE WHEN sequence % 3 <> 0 THEN 't' || ((CAST(substr(trace_id, 2) AS BIGINT) * 7 + 1) % 150) END AS parent_trace_id FROM v_events)"


def _children(spark, sf):
    t = F.substring("trace_id", 2, 20).cast("long")
    return V.events(spark, sf).withColumn("parent_trace_id", F.when(F.col("sequence") % 3 != 0, F.concat(F.lit("t"), ((t * 7 + 1) % 150).cast("string"))))


@query("""SELECT c.eid AS from_id, 'child_of' AS relation, f.eid AS to_id FROM v_child c
  JOIN (SELECT trace_id, eid, sequence FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY sequence, eid) AS rn FROM v_events) WHERE rn = 1) f ON f.trace_id = c.parent_trace_id AND f.sequence < c.sequence""", V.EVENTS, PARENT)
def child_of_edges(spark, sf):
    return N.child_of(_children(spark, sf))


REFS = "v_refs AS (SELECT *, CASE WHEN sequence % 4 = 0 THEN ['e' || lpad(CAST(sequence // 2 AS VARCHAR), 9, '0'), 't' || (sequence % 200)] ELSE CAST([] AS VARCHAR[]) END AS relation_ids FROM v_events)"


@query("""SELECT DISTINCT from_id, 'derived_from' AS relation, coalesce(i.eid, t.eid) AS to_id FROM (SELECT eid AS from_id, unnest(relation_ids) AS ref FROM v_refs) r
  LEFT JOIN v_events i ON i.eid = r.ref LEFT JOIN (SELECT trace_id, arg_min(eid, sequence) AS eid FROM v_events GROUP BY trace_id) t ON t.trace_id = r.ref
  WHERE coalesce(i.eid, t.eid) IS NOT NULL AND coalesce(i.eid, t.eid) <> from_id""", V.EVENTS, REFS)
def derived_from_edges(spark, sf):
    s = F.col("sequence")
    refs = F.when(s % 4 == 0, F.array(F.concat(F.lit("e"), F.lpad(F.floor(s / 2).cast("string"), 9, "0")), F.concat(F.lit("t"), (s % 200).cast("string")))).otherwise(F.array().cast("array<string>"))
    return N.derived_from(V.events(spark, sf).withColumn("relation_ids", refs))


@query("""SELECT scope_type, scope_id, arg_min(eid, sequence) AS first_event FROM (
  SELECT 'profile' AS scope_type, profile_id AS scope_id, sequence, eid FROM v_events UNION ALL SELECT 'project', project_id, sequence, eid FROM v_events
  UNION ALL SELECT 'knowledge_space', unnest(spaces), sequence, eid FROM v_events) WHERE scope_id IS NOT NULL GROUP BY ALL""", V.EVENTS)
def scopes_observed(spark, sf):
    return N.scopes(V.events(spark, sf))


@query("SELECT 'a' || (sequence % 97) AS artifact_id, arg_min(eid, sequence) AS origin_event_id, min(sequence) AS sequence FROM v_events GROUP BY 1", V.EVENTS)
def artifact_first_wins(spark, sf):
    refs = V.events(spark, sf).select(F.concat(F.lit("a"), (F.col("sequence") % 97).cast("string")).alias("artifact_id"), "eid", "sequence")
    return N.first_artifacts(refs)


TOMBS = """v_tombs AS (SELECT d.eid AS deletion_id, d.target_id, d.sequence, CASE WHEN t.sequence IS NULL THEN 'pending' WHEN t.sequence > d.sequence THEN 'applied_on_arrival' ELSE 'applied' END AS status,
    CASE WHEN t.sequence <= d.sequence THEN t.trace_id END AS target_trace_id
  FROM (SELECT eid, sequence, 'e' || lpad(CAST(CASE sequence % 3 WHEN 0 THEN sequence // 2 WHEN 1 THEN sequence + 7 ELSE sequence + 100000000 END AS VARCHAR), 9, '0') AS target_id FROM v_events WHERE lifecycle = 'deleted') d
  LEFT JOIN v_events t ON t.eid = d.target_id)"""


def _tombs(spark, sf):
    ev, s = V.events(spark, sf), F.col("sequence")
    target = F.when(s % 3 == 0, F.floor(s / 2)).when(s % 3 == 1, s + 7).otherwise(s + 100_000_000)
    deletions = ev.where("lifecycle = 'deleted'").select(F.col("eid").alias("deletion_id"), F.concat(F.lit("e"), F.lpad(target.cast("string"), 9, "0")).alias("target_id"), "sequence")
    return N.tombstones(deletions, ev)


@query("SELECT deletion_id, target_id, sequence, status, target_trace_id FROM v_tombs", V.EVENTS, TOMBS)
def tombstone_apply(spark, sf):
    return _tombs(spark, sf)


@query("SELECT deletion_id, target_id, CASE status WHEN 'applied' THEN '' ELSE 'target_not_yet_present' END AS detail FROM v_tombs UNION ALL SELECT deletion_id, target_id, '' FROM v_tombs WHERE status = 'applied_on_arrival'", V.EVENTS, TOMBS)
def tombstone_audit(spark, sf):
    return N.deletion_audit(_tombs(spark, sf))


@query("SELECT current_state, verifier, count(*) AS n, count(DISTINCT evidence_ref) AS traces FROM (SELECT lifecycle AS current_state, 'deterministic_check' AS verifier, trace_id AS evidence_ref FROM v_events) GROUP BY ALL", V.EVENTS)
def lifecycle_seed_counts(spark, sf):
    return N.lifecycle_seed(V.events(spark, sf)).groupBy("current_state", "verifier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("evidence_ref").alias("traces"))


BAD = "CASE WHEN s % 17 = 0 THEN 'missing_field:source' WHEN s % 19 = 0 THEN 'value:event_type' WHEN s % 23 = 0 THEN 'time:created_at' WHEN s % 29 = 0 THEN 'claim_active' WHEN s % 31 = 0 THEN 'knowledge_spaces' END"


@query(f"SELECT fault, count(*) AS n FROM (SELECT {BAD} AS fault FROM (SELECT sequence AS s FROM v_events)) GROUP BY fault", V.EVENTS)
def envelope_faults(spark, sf):
    s = F.col("sequence")
    rows = V.events(spark, sf).select(
        F.col("eid").alias("event_id"), "trace_id", F.when(s % 17 != 0, F.lit("hook")).alias("source"), F.when(s % 19 == 0, "gossip").when(s % 29 == 0, "assistant_claim").otherwise(F.lit("tool_observation")).alias("event_type"),
        F.lit(1).alias("schema_version"), F.when(s % 23 == 0, "yesterday").otherwise(F.col("created_at")).alias("created_at"), F.col("created_at").alias("observed_at"), "sequence",
        F.when(s % 29 == 0, "active").otherwise(F.lit("observed")).alias("lifecycle_status"), F.lit("none").alias("verification_status"), F.lit("high").alias("confidence"), F.lit("public").alias("sensitivity"),
        F.lit("persistent").alias("retention"), F.sha2("content", 256).alias("sanitized_content_hash"), F.when(s % 31 == 0, F.array(F.lit("k1"), F.lit("k1"))).otherwise(F.array(F.lit("k1"))).alias("knowledge_space_ids"),
    )
    return rows.select(N.fault(rows.columns).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- records

CHAIN = """v_chain AS (SELECT *, lag(decision_id) OVER w AS supersedes_id, lead(decision_id) OVER w AS replaced_by, row_number() OVER w AS version,
    CASE WHEN lead(decision_id) OVER w IS NOT NULL THEN 'superseded' ELSE status END AS lifecycle_status FROM v_decisions WINDOW w AS (PARTITION BY decision_key ORDER BY effective_at, decision_id))"""


def _chain(spark, sf):
    return R.supersede_chain(V.decisions(spark, sf), ["decision_key"], ["effective_at", "decision_id"], "decision_id", "status")


@query("SELECT decision_id, decision_key, project_id, supersedes_id, replaced_by, version, lifecycle_status FROM v_chain", V.DECISIONS, CHAIN)
def decisions_superseded(spark, sf):
    return _chain(spark, sf).select("decision_id", "decision_key", "project_id", "supersedes_id", "replaced_by", "version", "lifecycle_status")


@query("SELECT decision_key, decision_id, effective_at FROM v_chain WHERE lifecycle_status = 'active'", V.DECISIONS, CHAIN)
def decisions_active(spark, sf):
    return _chain(spark, sf).where("lifecycle_status = 'active'").select("decision_key", "decision_id", "effective_at")


@query("SELECT decision_key, count(*) AS n_active FROM v_chain WHERE lifecycle_status = 'active' GROUP BY decision_key HAVING count(*) > 1", V.DECISIONS, CHAIN)
def decisions_active_unique(spark, sf):
    return R.active_conflicts(_chain(spark, sf), ["decision_key"])


@query("SELECT project_id, decision_id, effective_at, lifecycle_status FROM v_chain WHERE project_id = 'n3' AND lifecycle_status <> 'deleted' ORDER BY decision_id, effective_at LIMIT 50", V.DECISIONS, CHAIN)
def decisions_page(spark, sf):
    from cairn.operators.relational import page

    return page(_chain(spark, sf).where("project_id = 'n3' AND lifecycle_status <> 'deleted'"), ["decision_id", "effective_at"]).select("project_id", "decision_id", "effective_at", "lifecycle_status")


STATE = """v_state AS (SELECT decision_key AS state_key, effective_at, value, row_number() OVER w AS version, lead(effective_at) OVER w AS valid_until, CASE WHEN lead(effective_at) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS lifecycle_status
  FROM (SELECT decision_key, decision_id, effective_at, statement AS value, lag(statement) OVER (PARTITION BY decision_key ORDER BY effective_at, decision_id) AS before FROM v_decisions)
  WHERE before IS NULL OR before <> value WINDOW w AS (PARTITION BY decision_key ORDER BY effective_at, decision_id))"""


def _state(spark, sf):
    ops = V.decisions(spark, sf).select(F.col("decision_key").alias("state_key"), "decision_id", "effective_at", F.col("statement").alias("value"))
    return R.state_history(ops, ["state_key"], ["effective_at", "decision_id"], "value")


@query("SELECT state_key, effective_at, value, version, valid_until, lifecycle_status FROM v_state", V.DECISIONS, STATE)
def state_history(spark, sf):
    return _state(spark, sf).select("state_key", "effective_at", "value", "version", "valid_until", "lifecycle_status")


@query("SELECT state_key, value, effective_at FROM v_state WHERE lifecycle_status = 'active'", V.DECISIONS, STATE)
def state_current(spark, sf):
    return _state(spark, sf).where("lifecycle_status = 'active'").select("state_key", "value", "effective_at")


@query("SELECT subject_id, verification_id, verification_status, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY timestamp DESC, verification_id DESC) AS rn FROM v_verifications) WHERE rn = 1", V.VERIFICATIONS)
def verification_latest(spark, sf):
    return R.latest(V.verifications(spark, sf), ["subject_id"], ["timestamp", "verification_id"]).select("subject_id", "verification_id", "verification_status", "timestamp")


@query("SELECT requirement_id, p_partkey, p_brand FROM (SELECT p_partkey AS requirement_id, unnest([CAST(p_partkey + 1 AS VARCHAR), CAST(p_partkey * 2 AS VARCHAR)]) AS link FROM part WHERE p_partkey > 1) JOIN part ON CAST(p_partkey AS VARCHAR) = link")
def requirement_links(spark, sf):
    parts = V.table(spark, sf, "part")
    p = F.col("p_partkey")
    records = parts.where("p_partkey > 1").select(p.alias("requirement_id"), F.concat((p + 1).cast("string"), F.lit(" , "), (p * 2).cast("string"), F.lit(",")).alias("links"))
    others = parts.select(p.cast("string").alias("link"), "p_partkey", "p_brand")
    return R.linked(records, "requirement_id", "links", others, "link").select("requirement_id", "p_partkey", "p_brand")


@query()
def decisions_replayed(spark, sf):
    """The whole grammar: every order creates or supersedes, some are then changed or deleted."""
    from pyspark.sql import Window

    d = V.decisions(spark, sf)
    chain = Window.partitionBy("decision_key").orderBy("effective_at", "decision_id")
    n = F.row_number().over(chain)
    base = d.select(F.col("decision_key").cast("string").alias("key"), (n * 2).cast("long").alias("position"), F.when(n == 1, "create").otherwise("supersede").alias("op"), "decision_id", F.col("status").alias("lifecycle_status"), "statement", F.lag("decision_id").over(chain).alias("supersedes_id"))
    later = base.where("position % 6 = 0").select("key", (F.col("position") + 1).alias("position"), F.when(F.col("position") % 12 == 0, "delete").otherwise("transition").alias("op"), "decision_id", F.lit("active").alias("lifecycle_status"), F.lit(None).cast("string").alias("statement"), F.lit(None).cast("string").alias("supersedes_id"))
    return R.replay_decisions(base.unionByName(later))


@query("""SELECT state_key, position, CASE WHEN state_key IS NULL THEN CASE WHEN op IN ('create', 'update') THEN 'created' ELSE 'rejected' END WHEN op = 'create' THEN CASE WHEN n = 1 THEN 'created' ELSE 'conflict' END
    WHEN statement = before THEN 'noop' WHEN op = 'supersede' THEN 'superseded' ELSE 'created' END AS outcome
  FROM (SELECT *, lag(statement) OVER (PARTITION BY state_key ORDER BY position) AS before, row_number() OVER (PARTITION BY state_key ORDER BY position) AS n FROM v_state_ops)""", V.DECISIONS,
  """v_state_ops AS (SELECT CASE WHEN decision_key % 5 <> 0 THEN CAST(decision_key AS VARCHAR) END AS state_key, position, statement, CASE WHEN decision_key % 5 = 0 THEN CASE position % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'supersede' END
    WHEN n = 1 THEN 'create' WHEN position % 2 = 0 THEN 'update' ELSE 'supersede' END AS op FROM (SELECT *, CAST(substr(decision_id, 2) AS BIGINT) AS position, row_number() OVER (PARTITION BY decision_key ORDER BY decision_id) AS n FROM v_decisions))""")
def states_replayed(spark, sf):
    """The state grammar over all decisions: a key's first creates, later ones update or supersede; a fifth has no key."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("decision_key").orderBy("decision_id"))
    d = V.decisions(spark, sf).withColumns({"position": F.substring("decision_id", 2, 20).cast("long"), "n": n, "loose": F.col("decision_key") % 5 == 0})
    third = F.col("position") % 3
    op = F.when(F.col("loose"), F.when(third == 0, "create").when(third == 1, "update").otherwise("supersede")).when(F.col("n") == 1, "create").when(F.col("position") % 2 == 0, "update").otherwise("supersede")
    none = F.lit(None).cast("string")
    ops = d.select("position", op.alias("op"), none.alias("project_id"), none.alias("scope"), F.when(~F.col("loose"), F.col("decision_key").cast("string")).alias("state_key"), F.col("statement").alias("state_value"), none.alias("state_ref"), F.lit("active").alias("lifecycle_status"), none.alias("verification_status"), none.alias("effective_at"))
    return R.replay_states(ops).select("state_key", "position", "outcome")


@query("""SELECT requirement_id, op, count(*) AS n, CASE WHEN requirement_id = 'r0' THEN 'rejected' ELSE outcome END AS outcome FROM (
  SELECT 'r' || p_partkey AS requirement_id, 'create' AS op, 'created' AS outcome FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT 'r' || p_partkey, 'supersede', 'superseded' FROM part WHERE p_partkey % 4 <> 1
  UNION ALL SELECT 'r' || p_partkey, 'transition', 'transitioned' FROM part
  UNION ALL SELECT 'r' || p_partkey, 'delete', 'deleted' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'r' || p_partkey, 'transition', CASE WHEN p_partkey % 3 = 0 THEN 'rejected' ELSE 'transitioned' END FROM part) GROUP BY ALL""")
def requirements_replayed(spark, sf):
    """The requirement grammar: parts in fours, the first created, each later one superseding the one before it."""
    p = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("r"), n.cast("string"))
    parts = V.table(spark, sf, "part").select("p_partkey", "p_brand")
    last = parts.agg(F.max("p_partkey")).scalar()
    none = F.lit(None).cast("string")

    def rows(kept, at, op, status, supersedes=none):
        fields = {f: none for f in R.REQUIREMENT_FIELDS} | {"statement": F.col("p_brand") if op in ("create", "supersede") else none, "lifecycle_status": F.lit(status)}
        return kept.select(at.cast("long").alias("position"), F.lit(op).alias("op"), name(p).alias("requirement_id"), supersedes.alias("supersedes"), none.alias("replaced_by"), *[c.alias(f) for f, c in fields.items()])

    first = p % 4 == 1
    ops = rows(parts.where(first), p, "create", "active").unionByName(rows(parts.where(~first), p, "supersede", "active", name(p - 1)))
    ops = ops.unionByName(rows(parts, p + last, "transition", "candidate"))
    ops = ops.unionByName(rows(parts.where(p % 3 == 0), p + last * 2, "delete", "deleted")).unionByName(rows(parts, p + last * 3, "transition", "active"))
    done = R.replay_requirements(ops).join(ops.select("position", "op", "requirement_id"), ["requirement_id", "position"])
    return done.groupBy("requirement_id", "op", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------ graph

EDGES = """v_typed AS (
  SELECT DISTINCT 'decision' AS from_type, 'o' || o_orderkey AS from_id, 'decision_for' AS relation, 'customer' AS to_type, 'c' || o_custkey AS to_id FROM orders
  UNION SELECT DISTINCT 'customer', 'c' || c_custkey, 'belongs_to_project', 'nation', 'n' || c_nationkey FROM customer
  UNION SELECT DISTINCT 'supplier', 's' || s_suppkey, 'belongs_to_project', 'nation', 'n' || s_nationkey FROM supplier
  UNION SELECT DISTINCT 'part', 'p' || l_partkey, 'artifact_of', 'decision', 'o' || l_orderkey FROM lineitem
  UNION SELECT DISTINCT 'supplier', 's' || l_suppkey, 'source_of', 'part', 'p' || l_partkey FROM lineitem)"""
EDGE_ID = """v_edges AS (SELECT *, 'edg_' || left(sha256('zm8.graph_edge|v1|{"from_id":"' || from_id || '","from_type":"' || from_type || '","relation":"' || relation || '","to_id":"' || to_id || '","to_type":"' || to_type || '"}'), 32) AS edge_id FROM v_typed)"""


def _unnamed(spark, sf):
    """The edges without their ids."""
    t = lambda n: V.table(spark, sf, n)
    pairs = lambda table, a, b: t(table).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return G.typed_edges(
        (pairs("orders", "o_orderkey", "o_custkey"), "decision", "decision_for", "customer", "o", "c"),
        (pairs("customer", "c_custkey", "c_nationkey"), "customer", "belongs_to_project", "nation", "c", "n"),
        (pairs("supplier", "s_suppkey", "s_nationkey"), "supplier", "belongs_to_project", "nation", "s", "n"),
        (pairs("lineitem", "l_partkey", "l_orderkey"), "part", "artifact_of", "decision", "p", "o"),
        (pairs("lineitem", "l_suppkey", "l_partkey"), "supplier", "source_of", "part", "s", "p"),
    )


def _edges(spark, sf):
    return G.named(_unnamed(spark, sf))


@query("SELECT relation, count(*) AS n, min(edge_id) AS least_id, max(edge_id) AS greatest_id FROM v_edges GROUP BY relation", EDGES, EDGE_ID)
def edges_typed(spark, sf):
    return _edges(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("least_id"), F.max("edge_id").alias("greatest_id"))


@query("""SELECT relation, coalesce(skip_reason, 'kept') AS outcome, count(*) AS n FROM (
  SELECT r.relation, CASE WHEN relation NOT IN ('derived_from', 'supersedes') THEN 'unmapped_relation_type' WHEN from_id = to_id THEN 'self_link' WHEN e.eid IS NULL THEN 'missing_endpoint' END AS skip_reason
  FROM (SELECT 'e' || lpad(CAST(CASE WHEN sequence % 10 = 0 THEN sequence + 100000000 ELSE sequence END AS VARCHAR), 9, '0') AS from_id, CASE WHEN sequence % 7 = 0 THEN eid ELSE 'e000000001' END AS to_id,
    CASE sequence % 3 WHEN 0 THEN 'derived_from' WHEN 1 THEN 'supersedes' ELSE 'child_of' END AS relation FROM v_events) r LEFT JOIN v_events e ON e.eid = r.from_id) GROUP BY ALL""", V.EVENTS)
def edges_skipped_reason(spark, sf):
    ev, s = V.events(spark, sf), F.col("sequence")
    rel = ev.select(F.concat(F.lit("e"), F.lpad(F.when(s % 10 == 0, s + 100_000_000).otherwise(s).cast("string"), 9, "0")).alias("from_id"), F.when(s % 7 == 0, F.col("eid")).otherwise("e000000001").alias("to_id"), F.when(s % 3 == 0, "derived_from").when(s % 3 == 1, "supersedes").otherwise("child_of").alias("relation"))
    return G.classify_edges(rel, ev).groupBy("relation", F.coalesce("skip_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT to_id AS other_id, relation, 'out' AS direction FROM v_typed WHERE from_id = 'c7' UNION ALL SELECT from_id, relation, 'in' FROM v_typed WHERE to_id = 'c7'", EDGES)
def related_both(spark, sf):
    return G.related(_edges(spark, sf), "c7")


def _hop(n: int, before: str) -> str:
    return f"""step{n} AS (SELECT to_id AS next FROM (SELECT e.*, row_number() OVER (PARTITION BY from_id ORDER BY relation, edge_id) AS rn FROM v_edges e WHERE from_id IN (SELECT node FROM {before}) AND to_id NOT LIKE '%7') WHERE rn <= 20
  UNION SELECT from_id FROM (SELECT e.*, row_number() OVER (PARTITION BY to_id ORDER BY relation, edge_id) AS rn FROM v_edges e WHERE to_id IN (SELECT node FROM {before}) AND from_id NOT LIKE '%7') WHERE rn <= 20)"""


@query("SELECT node, depth FROM seen2", EDGES, EDGE_ID, "seen0 AS (SELECT 'c11' AS node, CAST(0 AS BIGINT) AS depth)", _hop(1, "seen0"), "seen1 AS (SELECT * FROM seen0 UNION ALL SELECT DISTINCT next, CAST(1 AS BIGINT) FROM step1 WHERE next NOT IN (SELECT node FROM seen0))", "front1 AS (SELECT node FROM seen1 WHERE depth = 1)", _hop(2, "front1"), "seen2 AS (SELECT * FROM seen1 UNION ALL SELECT DISTINCT next, CAST(2 AS BIGINT) FROM step2 WHERE next NOT IN (SELECT node FROM seen1))")
def subgraph_bounded_2hop(spark, sf):
    """Two hops from one customer; nodes whose name ends in 7 are hidden."""
    edges = written(_unnamed(spark, sf), "edges")
    seeds = spark.createDataFrame([("c11",)], "node string")
    return G.neighbourhood(edges, seeds, lambda node: ~node.endswith("7"))


# ------------------------------------------------------------------------- time

TEMPORAL = """v_temporal AS (
  SELECT 'decision' AS resource_type, decision_id AS resource_id, CASE WHEN decision_key % 10 <> 0 THEN effective_at END AS created_at, CASE WHEN decision_key % 3 = 0 THEN effective_at END AS effective_at, NULL AS valid_from, NULL AS valid_until, status AS lifecycle_status FROM v_decisions
  UNION ALL SELECT 'verification', verification_id, NULL, NULL, CASE WHEN subject_id % 7 <> 0 THEN timestamp END, CASE WHEN subject_id % 5 <> 0 THEN strftime(CAST(replace(replace(timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP) + to_days(CAST(quantity AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%fZ') END, 'candidate' FROM v_verifications)"""


def _temporal(spark, sf):
    from cairn.functions.timestamps import stamp

    d, v = V.decisions(spark, sf), V.verifications(spark, sf)
    until = stamp(F.expr("to_timestamp(timestamp) + make_interval(0, 0, 0, cast(quantity as int))"))
    return T.index(
        d.select(F.lit("decision").alias("resource_type"), F.col("decision_id").alias("resource_id"), F.when(F.col("decision_key") % 10 != 0, F.col("effective_at")).alias("created_at"), F.when(F.col("decision_key") % 3 == 0, F.col("effective_at")).alias("effective_at"), F.col("status").alias("lifecycle_status")),
        v.select(F.lit("verification").alias("resource_type"), F.col("verification_id").alias("resource_id"), F.when(F.col("subject_id") % 7 != 0, F.col("timestamp")).alias("valid_from"), F.when(F.col("subject_id") % 5 != 0, until).alias("valid_until")),
    )


@query("SELECT resource_type, lifecycle_status, count(*) AS n, count(created_at) AS n_created, count(effective_at) AS n_effective, count(valid_from) AS n_from, max(valid_until) AS last_until FROM v_temporal GROUP BY ALL", V.DECISIONS, V.VERIFICATIONS, TEMPORAL)
def temporal_index(spark, sf):
    return _temporal(spark, sf).groupBy("resource_type", "lifecycle_status").agg(F.count(F.lit(1)).alias("n"), F.count("created_at").alias("n_created"), F.count("effective_at").alias("n_effective"), F.count("valid_from").alias("n_from"), F.max("valid_until").alias("last_until"))


@query("""SELECT instant, count(*) AS n, count(valid_until) AS n_until FROM (SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS instant FROM orders) JOIN v_temporal
  ON resource_type = 'verification' AND (valid_from IS NULL OR valid_from <= instant) AND (valid_until IS NULL OR instant < valid_until) GROUP BY 1""", V.DECISIONS, V.VERIFICATIONS, TEMPORAL)
def held_at_instants(spark, sf):
    """What held at the first of every month: intervals in bins, met by all instants at once."""
    from cairn.functions.timestamps import stamp

    facts = T.interval_bins(_temporal(spark, sf).where("resource_type = 'verification'"))
    months = V.table(spark, sf, "orders").select(stamp(F.date_trunc("month", "o_orderdate")).alias("instant")).distinct()
    return T.holding_at(facts, months).groupBy("instant").agg(F.count(F.lit(1)).alias("n"), F.count("valid_until").alias("n_until"))


@query("SELECT resource_type, count(*) AS n FROM v_temporal WHERE created_at <= '1996-06-30T00:00:00.000000Z' GROUP BY resource_type", V.DECISIONS, V.VERIFICATIONS, TEMPORAL)
def asof_transaction(spark, sf):
    return _temporal(spark, sf).where(T.as_of("transaction", "1996-06-30T00:00:00.000000Z")).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT resource_type, resource_id FROM v_temporal WHERE CASE WHEN effective_at IS NOT NULL THEN effective_at = '1996-06-30T00:00:00.000000Z' WHEN valid_from IS NULL AND valid_until IS NULL THEN false
  ELSE (valid_from IS NULL OR valid_from <= '1996-06-30T00:00:00.000000Z') AND (valid_until IS NULL OR valid_until > '1996-06-30T00:00:00.000000Z') END""", V.DECISIONS, V.VERIFICATIONS, TEMPORAL)
def asof_valid(spark, sf):
    return _temporal(spark, sf).where(T.as_of("valid", "1996-06-30T00:00:00.000000Z")).select("resource_type", "resource_id")


@query("SELECT resource_type, resource_id FROM v_temporal WHERE coalesce(effective_at, valid_from) >= '1996-01-01' AND coalesce(effective_at, valid_from) < '1996-02-01'", V.DECISIONS, V.VERIFICATIONS, TEMPORAL)
def temporal_window(spark, sf):
    return _temporal(spark, sf).where(T.within("valid", "1996-01-01", "1996-02-01")).select("resource_type", "resource_id")


# ------------------------------------------------- charters, requirements, artifacts


@query("SELECT project_id, decision_id, row_number() OVER w AS version, lag(decision_id) OVER w AS supersedes, CASE WHEN lead(decision_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS lifecycle_status FROM v_decisions WINDOW w AS (PARTITION BY project_id ORDER BY effective_at, decision_id)", V.DECISIONS)
def charter_versions(spark, sf):
    """Every decision of a nation's customers is a version of its charter."""
    return R.charters(V.decisions(spark, sf), ["effective_at", "decision_id"], "decision_id").select("project_id", "decision_id", "version", "supersedes", "lifecycle_status")


area.also("charter_versions_all", "charter_versions")


@query()
def charters_replayed(spark, sf):
    """The whole charter grammar over all decisions, in the order of their numbers."""
    n = F.substring("decision_id", 2, 20).cast("long")
    d = V.decisions(spark, sf).withColumn("n", n)
    op = F.when(n % 7 == 0, "delete").when(n % 5 == 0, "transition").when(n % 3 == 0, "update").otherwise("create")
    status = F.when(n % 7 == 0, "deleted").otherwise(F.col("status"))
    ops = d.select("project_id", F.col("n").alias("position"), op.alias("op"), F.concat(F.lit("h"), F.col("decision_key").cast("string")).alias("charter_id"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("long").alias("version"), status.alias("lifecycle_status"), F.lit(None).cast("string").alias("state"), F.col("statement").alias("content"))
    return R.replay_charters(ops)


@query("""SELECT subject_id, arg_max(state, pos) FILTER (WHERE state IS NOT NULL) AS state, arg_max(statement, pos) FILTER (WHERE statement IS NOT NULL) AS statement, count(*) AS n_ops, bool_or(gone IS NOT NULL) AS deleted
  FROM (SELECT v.*, min(CASE WHEN quantity = 50 THEN pos END) OVER (PARTITION BY subject_id) AS gone FROM (
    SELECT subject_id, quantity, timestamp || verification_id AS pos, CASE WHEN quantity % 3 <> 0 THEN verification_status END AS state, CASE WHEN quantity % 4 = 0 THEN 'q' || quantity END AS statement FROM v_verifications) v)
  WHERE gone IS NULL OR pos <= gone GROUP BY subject_id""", V.VERIFICATIONS)
def requirements_current(spark, sf):
    q = F.col("quantity")
    ops = V.verifications(spark, sf).select("subject_id", F.concat("timestamp", "verification_id").alias("pos"), F.when(q == 50, "delete").otherwise("transition").alias("op"), F.when(q % 3 != 0, F.col("verification_status")).alias("state"), F.when(q % 4 == 0, F.concat(F.lit("q"), q.cast("string"))).alias("statement"))
    return R.partial_updates(ops, "subject_id", "pos", ["state", "statement"])


@query("SELECT artifact_id, arg_max(verification_id, verification_id) AS verification_id FROM (SELECT supplier_key AS artifact_id, verification_id FROM v_verifications) WHERE artifact_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) GROUP BY artifact_id", V.VERIFICATIONS)
def artifacts_registered(spark, sf):
    refs = V.verifications(spark, sf).select(F.col("supplier_key").alias("artifact_id"), "verification_id")
    registry = V.table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("artifact_id"))
    return R.registered_artifacts(refs, registry, "verification_id")[0]


@query("SELECT artifact_ref, n FROM (SELECT CASE p_size % 6 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'C:x' WHEN 3 THEN 'password=x' WHEN 4 THEN 'docs/' || p_brand ELSE '' END AS artifact_ref, count(*) AS n FROM part GROUP BY 1) WHERE artifact_ref LIKE 'docs/%'")
def safe_artifact_refs(spark, sf):
    from cairn.functions.text import safe_reference

    s = F.col("p_size") % 6
    ref = F.when(s == 0, "/etc/x").when(s == 1, "a/../b").when(s == 2, "C:x").when(s == 3, "password=x").when(s == 4, F.concat(F.lit("docs/"), "p_brand")).otherwise("")
    return V.table(spark, sf, "part").select(ref.alias("artifact_ref")).where(safe_reference(F.col("artifact_ref"))).groupBy("artifact_ref").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.resource_type, e.resource_id, t.valid_until, coalesce(t.valid_from <= '1996-06-30T00:00:00.000000Z', true) AND coalesce(t.valid_until > '1996-06-30T00:00:00.000000Z', true) AND NOT (t.valid_from IS NULL AND t.valid_until IS NULL) AS holds FROM (SELECT 'verification' AS resource_type, verification_id AS resource_id FROM v_verifications) e LEFT JOIN v_temporal t ON t.resource_type = e.resource_type AND t.resource_id = e.resource_id", V.DECISIONS, V.VERIFICATIONS, TEMPORAL)
def temporal_annotation(spark, sf):
    items = V.verifications(spark, sf).select(F.lit("verification").alias("resource_type"), F.col("verification_id").alias("resource_id"))
    return T.annotate(items, _temporal(spark, sf), "1996-06-30T00:00:00.000000Z").select("resource_type", "resource_id", "valid_until", "holds")


area.also("temporal_annotation_all", "temporal_annotation")
