"""Catalogue: structured event reads and access control."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import access as A
from cairn.operators import events as E
from cairn.operators.relational import first_by
from cairn.plans import views as V
from cairn.plans.registry import Area

area = Area()
query = area.query


SCOPES = [A.Scope(requester="p3", global_read=True, profiles=("p3",)), A.Scope(spaces=("k2",), is_grant=True)]
SECURED = "(profile_id IN ('p3') OR profile_id IS NULL OR EXISTS (SELECT 1 FROM v_space s WHERE s.eid = v_events.eid AND s.space = 'k2'))"
SPACE = "v_space AS (SELECT DISTINCT eid, unnest(spaces) AS space FROM v_events)"
LIVE = "eid NOT IN (SELECT eid FROM v_events WHERE lifecycle = 'deleted')"
CURSOR = {"created_at": "2024-01-05T00:00:00.000000Z", "eid": "e000000000"}
BEHIND = "(created_at > '2024-01-05T00:00:00.000000Z' OR (created_at = '2024-01-05T00:00:00.000000Z' AND eid > 'e000000000'))"


@query(f"SELECT eid, trace_id, created_at, event_type, profile_id FROM v_events WHERE event_type = 'external_source' AND created_at >= '2024-01-02' AND created_at <= '2024-01-25' AND {SECURED} AND {LIVE} AND {BEHIND} ORDER BY created_at, eid LIMIT 50", V.EVENTS, SPACE)
def events_page(spark, sf):
    rows = E.query(V.events(spark, sf), 50, CURSOR, A.any_of(SCOPES), event_type="external_source", created_from="2024-01-02", created_to="2024-01-25")
    return rows.select("eid", "trace_id", "created_at", "event_type", "profile_id")


@query(f"SELECT eid, created_at, event_type FROM v_events WHERE trace_id = 't7' AND {LIVE}", V.EVENTS)
def events_by_trace(spark, sf):
    ev = V.events(spark, sf)
    return E.visible(ev.where("trace_id = 't7'"), E.deleted_ids(ev)).select("eid", "created_at", "event_type")


@query(f"SELECT eid, session_id, sequence FROM v_events WHERE session_id = 's3' AND {LIVE}", V.EVENTS)
def events_by_session(spark, sf):
    ev = V.events(spark, sf)
    return E.visible(ev.where("session_id = 's3'"), E.deleted_ids(ev)).select("eid", "session_id", "sequence")


@query(f"SELECT v_events.eid, created_at FROM v_events JOIN v_space s ON s.eid = v_events.eid WHERE s.space = 'k4' AND v_events.{LIVE}", V.EVENTS, SPACE)
def events_in_space(spark, sf):
    return E.in_space(V.events(spark, sf), "k4").select("eid", "created_at")


@query(f"SELECT count(*) AS total FROM v_events WHERE event_type = 'decision' AND {LIVE}", V.EVENTS)
def events_total(spark, sf):
    return E.total(V.events(spark, sf), event_type="decision")


@query("SELECT eid, spaces[1] AS first_space FROM v_events WHERE spaces[1] = 'k1' AND lifecycle <> 'deleted'", V.EVENTS)
def events_primary_space(spark, sf):
    first = F.get("spaces", 0)
    return V.events(spark, sf).where((first == "k1") & (F.col("lifecycle") != "deleted")).select("eid", first.alias("first_space"))


@query("SELECT eid, created_at FROM v_events WHERE lifecycle = 'deleted'", V.EVENTS)
def deleted_admin(spark, sf):
    ev = V.events(spark, sf)
    return ev.join(E.deleted_ids(ev), "eid", "left_semi").select("eid", "created_at")


@query("SELECT lifecycle, verification, count(*) AS n FROM v_events GROUP BY ALL", V.EVENTS)
def lifecycle_counts(spark, sf):
    return V.events(spark, sf).groupBy("lifecycle", "verification").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trace_id, eid, created_at FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY sequence DESC) AS rn FROM v_events WHERE lifecycle = 'active') WHERE rn = 1", V.EVENTS)
def active_for_key(spark, sf):
    rows = V.events(spark, sf).where("lifecycle = 'active'").select("trace_id", "eid", "created_at", "sequence")
    return first_by(rows, ["trace_id"], [F.desc("sequence")]).select("trace_id", "eid", "created_at")


@query("SELECT max(created_at) AS last_created, count(*) AS n, count(DISTINCT trace_id) AS traces FROM v_events", V.EVENTS)
def source_cutoff(spark, sf):
    return V.events(spark, sf).agg(F.max("created_at").alias("last_created"), F.count(F.lit(1)).alias("n"), F.countDistinct("trace_id").alias("traces"))


@query(f"SELECT eid, profile_id, project_id FROM v_events WHERE {SECURED}", V.EVENTS, SPACE)
def scope_secured_events(spark, sf):
    return A.secured(V.events(spark, sf), SCOPES).select("eid", "profile_id", "project_id")


@query("SELECT count(*) AS n_rows, count(DISTINCT eid) AS n_ids FROM v_events WHERE EXISTS (SELECT 1 FROM v_space s WHERE s.eid = v_events.eid AND s.space IN ('k0','k2'))", V.EVENTS, SPACE)
def scope_union_no_dup(spark, sf):
    rows = A.secured(V.events(spark, sf), [A.Scope(spaces=("k0",), is_grant=True), A.Scope(spaces=("k2",), is_grant=True)])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("eid").alias("n_ids"))


@query("SELECT trace_id, count(*) AS n FROM v_events GROUP BY trace_id HAVING count(*) FILTER (WHERE NOT coalesce(project_id IN ('j1','j2'), false)) = 0", V.EVENTS)
def trace_withheld_if_hidden(spark, sf):
    rows = A.whole_or_nothing(V.events(spark, sf), "trace_id", [A.Scope(projects=("j1", "j2"), is_grant=True)])
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT eid, array_to_string(list_sort(list(space)), ',') AS spaces FROM v_space GROUP BY eid", V.EVENTS, SPACE)
def event_space_map(spark, sf):
    rows = E.junction(V.events(spark, sf)).groupBy("eid").agg(F.array_sort(F.collect_list("space")).alias("s"))
    return rows.select("eid", F.array_join("s", ",").alias("spaces"))


POLICY = """
SELECT request_id, reason, reason LIKE 'ALLOW%' AS allow FROM (
  SELECT *, CASE
    WHEN requester IS NULL THEN CASE
      WHEN len(profiles) + len(projects) + len(spaces) > 0 OR operation = 'WRITE' THEN 'DENY_UNBOUND_PROTECTED'
      WHEN isolated AND include_global THEN 'DENY_ISOLATED_SCOPE_ESCAPE'
      WHEN include_global AND NOT isolated THEN 'ALLOW_GLOBAL_READ' ELSE 'DENY_UNBOUND_PROTECTED' END
    WHEN isolated AND len(profiles) + len(projects) + len(spaces) = 0 THEN 'DENY_ISOLATED_SCOPE_ESCAPE'
    WHEN isolated AND len(spaces) > 0 AND len(profiles) + len(projects) = 0 THEN 'DENY_ISOLATED_SCOPE_ESCAPE'
    WHEN len(list_filter(profiles, lambda p: p <> requester)) > 0 THEN CASE operation WHEN 'WRITE' THEN 'DENY_CROSS_PROFILE_WRITE' ELSE 'DENY_CROSS_PROFILE_READ' END
    WHEN NOT (len(profiles) = 1 AND profiles[1] = requester) AND len(projects) > 0 THEN 'DENY_CROSS_PROJECT'
    WHEN operation = 'WRITE' THEN CASE WHEN len(profiles) = 1 AND profiles[1] = requester THEN 'ALLOW_LOCAL_WRITE' ELSE 'DENY_GLOBAL_WRITE' END
    WHEN len(profiles) = 1 AND profiles[1] = requester THEN 'ALLOW_LOCAL_PROFILE_READ'
    WHEN include_global AND NOT isolated THEN 'ALLOW_GLOBAL_READ' ELSE 'ALLOW_LOCAL_PROFILE_READ' END AS reason
  FROM v_requests)
"""


@query(POLICY, V.REQUESTS)
def policy_decisions(spark, sf):
    return A.decide(V.requests(spark, sf)).select("request_id", "reason", "allow")


ACTIVE = "v_active AS (SELECT * FROM v_grants WHERE lifecycle_status = 'active' AND (state IS NULL OR state <> 'revoked') AND grant_id NOT IN (SELECT supersedes FROM v_grants WHERE supersedes IS NOT NULL))"


@query("SELECT grant_id, subject_profile, target_type, target_id FROM v_active WHERE operation = 'READ' AND (resource_types IS NULL OR resource_types LIKE '%\"event\"%')", V.GRANTS, ACTIVE)
def grants_effective(spark, sf):
    return A.read_grants(V.grants(spark, sf), resource_type="event").select("grant_id", "subject_profile", "target_type", "target_id")


@query("""
SELECT subject_profile, target_type, target_id, n_grants, CASE WHEN n_grants = 1 THEN grant_id END AS grant_id,
  CASE WHEN n_grants > 1 THEN 'conflict' WHEN ref IS NULL THEN 'unverified' WHEN status = 'verified' THEN 'granted' ELSE 'unverified' END AS outcome
FROM (SELECT subject_profile, target_type, target_id, count(*) AS n_grants, min(grant_id) AS grant_id, min(verification_ref) AS ref FROM v_active WHERE operation = 'WRITE' GROUP BY ALL)
LEFT JOIN (SELECT 'r' || r AS verification_id, CASE WHEN r % 2 = 0 THEN 'verified' ELSE 'none' END AS status FROM (SELECT DISTINCT s_suppkey % 10 AS r FROM supplier)) ON ref = verification_id
""", V.GRANTS, ACTIVE)  # fmt: skip
def grants_conflict_write(spark, sf):
    r = F.col("s_suppkey") % 10
    checks = V.table(spark, sf, "supplier").select(F.concat(F.lit("r"), r.cast("string")).alias("verification_id"), F.when(r % 2 == 0, "verified").otherwise("none").alias("verification_status")).distinct()
    return A.write_grants(V.grants(spark, sf), checks)


@query("""
SELECT grant_id, arg_max(subject_profile, position) FILTER (WHERE subject_profile IS NOT NULL) AS subject_profile,
  arg_max(CASE op WHEN 'revoke' THEN 'revoked' WHEN 'create' THEN 'enabled' END, position) FILTER (WHERE op IN ('revoke','create')) AS state,
  CASE WHEN grant_id IN (SELECT supersedes FROM v_ops WHERE op = 'supersede' AND supersedes IS NOT NULL) THEN 'superseded' ELSE 'active' END AS lifecycle_status
FROM v_ops GROUP BY grant_id
""", V.GRANTS, """v_ops AS (
  SELECT grant_id, CAST(1 AS BIGINT) AS position, CASE WHEN supersedes IS NULL THEN 'create' ELSE 'supersede' END AS op, subject_profile, supersedes FROM v_grants
  UNION ALL SELECT grant_id, CAST(2 AS BIGINT), 'revoke', NULL, NULL FROM v_grants WHERE state = 'revoked')""")  # fmt: skip
def grants_replayed(spark, sf):
    g = V.grants(spark, sf)
    made = g.select("grant_id", F.lit(1).cast("long").alias("position"), F.when(F.col("supersedes").isNull(), "create").otherwise("supersede").alias("op"), "subject_profile", "supersedes")
    none = F.lit(None).cast("string")
    revoked = g.where("state = 'revoked'").select("grant_id", F.lit(2).cast("long").alias("position"), F.lit("revoke").alias("op"), none.alias("subject_profile"), none.alias("supersedes"))
    return A.latest_grants(made.unionByName(revoked)).select("grant_id", "subject_profile", "state", "lifecycle_status")


@query("SELECT profile_id, project_id, count(*) AS n FROM v_events WHERE (profile_id = 'p1' AND project_id = 'j1') OR (profile_id IS NULL AND project_id IS NULL AND len(spaces) = 0) GROUP BY ALL", V.EVENTS)
def corpus_scope_triples(spark, sf):
    rows = V.events(spark, sf).withColumn("space_id", F.get("spaces", 0))
    return rows.where(A.corpus_scope([("p1", "j1", None), (None, None, None)])).groupBy("profile_id", "project_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT profile_id, project_id, count(*) AS n FROM v_events WHERE profile_id = 'p1' AND project_id = 'j1' AND len(spaces) = 0 GROUP BY ALL", V.EVENTS)
def graph_scope_triples(spark, sf):
    rows = V.events(spark, sf).withColumn("space_id", F.get("spaces", 0))
    return rows.where(A.corpus_graph_scope([("p1", "j1", None)])).groupBy("profile_id", "project_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT profile_id, project_id FROM v_events UNION SELECT DISTINCT source AS profile_id, lang AS project_id FROM documents", V.EVENTS)
def space_owners(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("source").alias("profile_id"), F.col("lang").alias("project_id"))
    return A.owners(V.events(spark, sf), docs)


@query("""
SELECT request_id, reason, reason LIKE 'ALLOW%' AS allow FROM (
  SELECT q.request_id, CASE WHEN q.requester IS NULL THEN 'DENY_UNBOUND_PROTECTED' WHEN q.target_type = 'profile' AND q.target_id = q.requester THEN 'ALLOW_LOCAL_WRITE'
    WHEN n > 1 THEN 'DENY_POLICY_CONFLICT' WHEN n = 1 AND ref IN ('r0', 'r2', 'r4', 'r6', 'r8') THEN 'ALLOW_EXPLICIT_CROSS_PROFILE_WRITE' ELSE 'DENY_CROSS_PROFILE_WRITE' END AS reason
  FROM (SELECT request_id, requester, CASE WHEN request_id % 2 = 0 THEN 'profile' ELSE 'project' END AS target_type, CASE WHEN request_id % 2 = 0 THEN 'p' || (request_id % 16 // 2) ELSE 'j' || (request_id % 5) END AS target_id FROM v_requests) q
  LEFT JOIN (SELECT subject_profile, target_type, target_id, count(*) AS n, min(verification_ref) AS ref FROM v_active WHERE operation = 'WRITE' GROUP BY ALL) g
    ON g.subject_profile = q.requester AND g.target_type = q.target_type AND g.target_id = q.target_id)
""", V.GRANTS, ACTIVE, V.REQUESTS)  # fmt: skip
def write_authorization(spark, sf):
    r = F.col("request_id")
    asks = V.requests(spark, sf).select("request_id", "requester", F.when(r % 2 == 0, "profile").otherwise("project").alias("target_type"), F.when(r % 2 == 0, F.concat(F.lit("p"), F.floor(r % 16 / 2).cast("string"))).otherwise(F.concat(F.lit("j"), (r % 5).cast("string"))).alias("target_id"))
    k = F.col("s_suppkey") % 10
    checks = V.table(spark, sf, "supplier").select(F.concat(F.lit("r"), k.cast("string")).alias("verification_id"), F.when(k % 2 == 0, "verified").otherwise("none").alias("verification_status")).distinct()
    return A.authorize_writes(asks, A.write_grants(V.grants(spark, sf), checks))
