"""Catalogue: routing, eligibility, scoring, selection, notes, integrity, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import vocabulary as W
from cairn.functions import text as X
from cairn.operators import evidence as D
from cairn.operators import integrity as Y
from cairn.operators import metrics as M
from cairn.operators import relational as L
from cairn.operators import search as S
from cairn.operators import vault as U
from cairn.plans import views as V
from cairn.plans.registry import Area

area = Area()
query = area.query

# ---------------------------------------------------------------------- routing

def _like(name: str) -> str:
    pattern = next(p for n, _, p in W.ROUTES if n == name).replace("'", "''")
    return f"regexp_matches(regexp_replace(lower(coalesce(ask, '')), '\\s+', ' ', 'g'), '{pattern}')"


ROUTE = "CASE " + " ".join(f"WHEN {_like(n)} THEN '{n}'" for n, _, _ in W.ROUTES) + " ELSE 'no_memory' END"
ROUTED = f"v_routed AS (SELECT *, {ROUTE} AS route, CASE " + " ".join(f"WHEN {_like(n)} THEN '{r}'" for n, r, _ in W.ROUTES) + " ELSE 'GENERIC_STANDALONE' END AS reason FROM v_asks)"


ASKED = "v_asks AS (SELECT *, CASE WHEN number % 2 = 0 THEN 'j1' END AS project, CASE WHEN number % 3 = 0 THEN 's1' END AS session, CASE WHEN number % 5 = 0 THEN 'p1' END AS profile FROM (SELECT 'd' || doc_id AS item_id, doc_id AS number, text AS ask FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, conv_id, text FROM conversations))"


def _asks(spark, sf):
    n = F.col("number")
    rows = V.bodies(spark, sf).select("item_id", F.col("body").alias("ask"), F.when(n % 2 == 0, "j1").alias("project"), F.when(n % 3 == 0, "s1").alias("session"), F.when(n % 5 == 0, "p1").alias("profile"))
    name, why = D.route(F.col("ask"))
    return rows.withColumns({"route": name, "reason": why})


@query("SELECT item_id, route, reason FROM v_routed", ASKED, ROUTED)
def route_text(spark, sf):
    """The whole text of every document and conversation turn."""
    return _asks(spark, sf).select("item_id", "route", "reason")


@query(f"""SELECT item_id, CASE WHEN route = 'no_memory' THEN '' ELSE array_to_string(list_filter([
    CASE WHEN route = 'external_current' OR {_like('external_current')} THEN 'freshness' END, CASE WHEN route = 'global_memory' OR {_like('global_memory')} THEN 'multi_scope' END,
    CASE WHEN route IN ('project_memory', 'external_current') OR project IS NOT NULL THEN 'project' END, CASE WHEN route = 'research_memory' OR {_like('research_memory')} THEN 'research_source' END,
    CASE WHEN route = 'session_memory' OR session IS NOT NULL OR {_like('session_memory')} THEN 'session' END, CASE WHEN route = 'user_memory' OR profile IS NOT NULL OR {_like('user_memory')} THEN 'user_profile' END], lambda x: x IS NOT NULL), ',') END AS hints,
  CASE route WHEN 'project_memory' THEN project IS NULL WHEN 'user_memory' THEN profile IS NULL WHEN 'session_memory' THEN session IS NULL WHEN 'global_memory' THEN true ELSE false END AS insufficient FROM v_routed""", ASKED, ROUTED)
def scope_hints(spark, sf):
    c = F.col
    hints = D.scope_hints(c("ask"), c("route"), c("project"), c("session"), c("profile"))
    return _asks(spark, sf).select("item_id", F.array_join(hints, ",").alias("hints"), D.insufficient(c("route"), c("project"), c("session"), c("profile"), F.lit(0)).alias("insufficient"))


for _name in ("route_text", "scope_hints"):
    area.also(f"{_name}_all", _name)


# ------------------------------------------------------- eligibility and scores

ELIGIBLE = """v_items AS (SELECT *, CASE WHEN lifecycle = 'deleted' THEN 'lifecycle_excluded:deleted' WHEN sensitivity = 'secret' THEN 'sensitivity_ceiling_exceeded' ELSE 'eligible' END AS reason,
    CASE WHEN lifecycle = 'deleted' OR sensitivity = 'secret' THEN NULL WHEN ((lifecycle = 'active' AND verification <> 'none') OR event_type IN ('decision', 'tool_observation'))
      AND lifecycle NOT IN ('superseded', 'observed') AND event_type <> 'user_statement' THEN 'primary' ELSE 'supporting' END AS role FROM v_events)"""


def _items(spark, sf):
    return V.events(spark, sf).withColumn("resource_type", F.lit("event")).withColumns(D.eligibility())


@query("SELECT eid, reason, role FROM v_items", V.EVENTS, ELIGIBLE)
def eligibility_roles(spark, sf):
    return _items(spark, sf).select("eid", "reason", "role")


SCORED = """v_scored AS (SELECT *, CASE WHEN scope_match = 'unauthorized' THEN 'excluded_unauthorized_scope' WHEN lifecycle = 'deleted' THEN 'excluded_lifecycle_ineligible' WHEN sequence % 10 = 9 THEN 'excluded_relation_beyond_bounds' END AS excluded,
    1.0::DOUBLE * CASE scope_match WHEN 'exact' THEN 1.0 WHEN 'composed' THEN 0.9 ELSE 0.8 END::DOUBLE * CASE event_type WHEN 'decision' THEN 0.9 WHEN 'tool_observation' THEN 0.9 WHEN 'user_statement' THEN 0.8
      ELSE CASE verification WHEN 'none' THEN 0.5 WHEN 'deterministic_verification' THEN 1.0 ELSE 0.9 END END::DOUBLE * CASE WHEN sequence % 2 = 0 THEN 1.0 ELSE 0.75 END::DOUBLE * CASE WHEN sequence % 5 = 0 THEN 1.0 ELSE 0.75 END::DOUBLE
      * 1.0::DOUBLE * CASE WHEN lifecycle = 'conflicted' THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN sequence % 10 = 1 THEN 0.9 WHEN sequence % 10 = 2 THEN 0.8 ELSE 1.0 END::DOUBLE AS product
  FROM (SELECT *, CASE WHEN profile_id = 'p3' AND project_id = 'j1' THEN 'exact' WHEN (profile_id IS NOT NULL AND profile_id <> 'p3' AND profile_id NOT IN ('p1')) OR (project_id <> 'j1' AND project_id NOT IN ('j2', 'j3')) THEN 'unauthorized'
      WHEN (profile_id = 'p1') OR project_id IN ('j2', 'j3') THEN 'composed' ELSE 'unauthorized' END AS scope_match FROM v_events))"""


def _scored(spark, sf):
    s = F.col("sequence")
    items = V.events(spark, sf).withColumn("space_id", F.lit(None).cast("string"))
    items = items.withColumns({
        "scope_match": D.classify_scope(("p3", "j1", None), ("p1",), ("j2", "j3")), "memory_type": F.col("event_type"), "provenance_class": F.when(s % 2 == 0, "complete").otherwise("required_only"),
        "temporal_validity": F.when(s % 5 == 0, "valid").otherwise("unknown"), "has_conflict": F.lit(False), "retrieval_relevance": F.lit(None).cast("double"),
        "relation_distance": F.when(s % 10 == 9, 3).when(s % 10 == 1, 1).when(s % 10 == 2, 2).when(s % 10 == 0, 0),
    })
    return D.calibrate(items)


@query("SELECT eid, scope_match, excluded, CASE WHEN excluded IS NULL THEN round(product, 6) END AS score FROM v_scored", V.EVENTS, SCORED)
def calibrated_scores(spark, sf):
    return _scored(spark, sf).select("eid", "scope_match", "excluded", F.round("score", 6).alias("score"))


@query("""SELECT eid, array_to_string(list_sort(list_filter([CASE WHEN verification = 'deterministic_verification' AND event_type NOT IN ('decision', 'tool_observation', 'user_statement') THEN 'VERIFIED_SOURCE' ELSE 'UNVERIFIED_SOURCE' END,
    CASE WHEN sequence % 2 = 0 THEN 'EXPLICIT_PROVENANCE_COMPLETE' END, CASE WHEN sequence % 5 = 0 THEN 'TEMPORAL_VALID_TIME_PRESENT' ELSE 'TEMPORAL_VALID_TIME_ABSENT' END, 'LIFECYCLE_ELIGIBLE', CASE WHEN lifecycle = 'conflicted' THEN 'CONFLICT_PRESENT' END], lambda x: x IS NOT NULL)), ',') AS codes
  FROM v_scored WHERE excluded IS NULL""", V.EVENTS, SCORED)
def reason_codes(spark, sf):
    return _scored(spark, sf).where("excluded IS NULL").select("eid", F.array_join("reason_codes", ",").alias("codes"))


@query("SELECT eid, score FROM (SELECT eid, round(product, 6) AS score FROM v_scored WHERE excluded IS NULL) ORDER BY score DESC, eid LIMIT 50", V.EVENTS, SCORED)
def calibrated_top(spark, sf):
    return _scored(spark, sf).where("excluded IS NULL").select("eid", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "eid").limit(50)


@query("""SELECT session_id, eid, role, rank, cost FROM (
  SELECT *, coalesce(sum(CASE WHEN role = 'primary' AND fits THEN cost END) OVER (PARTITION BY session_id), 0) AS used FROM (
    SELECT *, rank = 1 OR spent <= 30 AS fits FROM (
      SELECT *, sum(cost) OVER (PARTITION BY session_id, role ORDER BY rank) AS spent FROM (
        SELECT session_id, eid, role, row_number() OVER (PARTITION BY session_id, role ORDER BY CASE WHEN verification <> 'none' THEN 0 ELSE 1 END, CASE WHEN lifecycle = 'active' THEN 0 ELSE 1 END, created_at, eid) AS rank,
          greatest(1, length(content) // 4) AS cost FROM v_items WHERE role IS NOT NULL) WHERE rank <= CASE role WHEN 'primary' THEN 5 ELSE 3 END)))
  WHERE CASE WHEN role = 'primary' THEN fits ELSE rank = 1 OR spent <= 30 - used END""", V.EVENTS, ELIGIBLE)
def evidence_topk_budget(spark, sf):
    order = [F.when(F.col("verification") != "none", 0).otherwise(1), F.when(F.col("lifecycle") == "active", 0).otherwise(1), "created_at", "eid"]
    return D.select_evidence(_items(spark, sf), ["session_id"], order, X.estimate_tokens(F.col("content")), budget=30).select("session_id", "eid", "role", "rank", "cost")


@query("SELECT coalesce(trace_id, eid) AS conflict_key, count(*) AS n_items, count(DISTINCT lifecycle) AS n_lifecycles, bool_or(lifecycle = 'conflicted') AS any_conflicted, min(eid) AS first_item FROM v_events GROUP BY ALL HAVING count(*) > 1 AND (count(DISTINCT lifecycle) > 1 OR bool_or(lifecycle = 'conflicted'))", V.EVENTS)
def conflict_groups(spark, sf):
    return D.conflict_groups(V.events(spark, sf), F.coalesce("trace_id", "eid"))


area.also("conflict_groups_all", "conflict_groups")


@query("SELECT eid, '[' || role || ':' || rank || '] ' || content AS line FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY created_at, eid) AS rank FROM v_items WHERE role IS NOT NULL) WHERE rank <= CASE role WHEN 'primary' THEN 5 ELSE 3 END", V.EVENTS, ELIGIBLE)
def evidence_lines(spark, sf):
    chosen = D.select_evidence(_items(spark, sf), ["session_id"], ["created_at", "eid"], F.lit(1).cast("long"))
    return D.serialize(chosen).select("eid", "line")


# ------------------------------------------------------------------------ notes


@query("SELECT eid FROM v_events WHERE sensitivity IN ('public', 'internal') AND lifecycle IN ('active', 'superseded', 'conflicted')", V.EVENTS)
def vault_eligible(spark, sf):
    return V.events(spark, sf).where(U.eligible()).select("eid")


@query("""SELECT note_id, pos, resource_id, coalesce('Decisions/' || o.k, '(not available)') AS target FROM (
    SELECT 'n' || p_partkey AS note_id, unnest([0, 1]) AS pos, unnest([CAST(p_partkey AS VARCHAR), CAST(p_partkey * 10 + 10000 AS VARCHAR)]) AS resource_id FROM part WHERE p_partkey > 0)
  LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders) o ON o.k = resource_id""")
def link_resolution(spark, sf):
    p = F.col("p_partkey")
    records = V.table(spark, sf, "part").where("p_partkey > 0").select(F.concat(F.lit("n"), p.cast("string")).alias("note_id"), F.to_json(F.array(p.cast("string"), (p * 10 + 10000).cast("string"))).alias("links"))
    key = F.col("o_orderkey").cast("string")
    registry = V.table(spark, sf, "orders").select(key.alias("resource_id"), F.concat(F.lit("Decisions/"), key).alias("note_path"))
    return U.resolve_links(records, "links", registry)


NOTES = """v_rec AS (SELECT note_id, CASE WHEN NOT on_disk THEN 'missing_expected_file' WHEN NOT marker THEN 'human_owned' WHEN NOT listed THEN 'unknown_ownership' WHEN disk_fp <> recorded_fp THEN 'generated_human_modified' WHEN NOT wanted THEN 'stale_generated' ELSE 'generated_unchanged' END AS ownership, * EXCLUDE (note_id)
  FROM (SELECT p_partkey AS note_id, p_partkey % 2 = 0 AS wanted, p_partkey % 3 <> 0 AS listed, p_partkey % 5 <> 0 AS on_disk, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS marker,
    'f' || (p_partkey % 4) AS fp, 'f' || (p_partkey % 8 % 4) AS recorded_fp, 'f' || (CASE WHEN p_partkey % 11 = 0 THEN 9 ELSE p_partkey % 8 % 4 END) AS disk_fp FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0 OR p_partkey % 5 <> 0))"""


def _reconciled(spark, sf):
    p = F.col("p_partkey")
    t = V.table(spark, sf, "part")
    fp = lambda n: F.concat(F.lit("f"), n.cast("string"))
    wanted = t.where(p % 2 == 0).select(p.alias("note_id"), fp(p % 4).alias("fp"))
    listed = t.where(p % 3 != 0).select(p.alias("note_id"), fp(p % 8 % 4).alias("recorded_fp"))
    disk = t.where(p % 5 != 0).select(p.alias("note_id"), fp(F.when(p % 11 == 0, 9).otherwise(p % 8 % 4)).alias("disk_fp"), (p % 7 != 0).alias("marker"))
    return U.reconcile(wanted, listed, disk)


@query("""SELECT note_id, ownership, CASE WHEN wanted AND NOT on_disk THEN 'create' WHEN wanted AND ownership IN ('human_owned', 'unknown_ownership') THEN 'edit_conflict'
    WHEN wanted AND ownership = 'generated_human_modified' THEN CASE WHEN fp = recorded_fp THEN 'human_modified' ELSE 'edit_conflict' END WHEN wanted AND fp = disk_fp THEN 'unchanged' WHEN wanted THEN 'update'
    WHEN listed AND ownership = 'stale_generated' THEN 'retire' WHEN listed AND NOT on_disk THEN 'forget' WHEN listed THEN 'preserve' ELSE 'ignore' END AS action FROM v_rec""", NOTES)
def reconcile_actions(spark, sf):
    return _reconciled(spark, sf)


@query("SELECT ownership, count(*) AS n FROM v_rec GROUP BY ownership", NOTES)
def ownership_class(spark, sf):
    return _reconciled(spark, sf).groupBy("ownership").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT decision_id, sha256('---\ntype: decision\nid: ' || decision_id || '\nmanaged: true\n---\n\n# ' || statement || '\n' || '\n- project: ' || project_id || '\n- status: ' || status || '\n') AS fp,
  'Decisions/' || left(trim(regexp_replace(lower(statement), '[^a-z0-9]+', '-', 'g'), '-'), 60) || '-' || left(sha256(decision_id), 8) || '.md' AS note_path FROM v_decisions""", V.DECISIONS)
def decision_notes(spark, sf):
    d = V.decisions(spark, sf)
    body = U.render("decision", F.col("decision_id"), F.col("statement"), {"project": F.col("project_id"), "status": F.col("status")})
    return d.select("decision_id", U.fingerprint(body).alias("fp"), U.note_path(F.lit("decision"), F.col("statement"), F.col("decision_id")).alias("note_path"))


@query("SELECT coalesce(CASE WHEN sequence % 6 <> 0 THEN 'event|' || project_id || '|' || trace_id END, 'alone|' || eid) AS conflict_key, count(*) AS n, min(eid) AS first_id, max(eid) AS last_id FROM v_events WHERE lifecycle = 'conflicted' GROUP BY 1", V.EVENTS)
def conflict_notes(spark, sf):
    key = F.when(F.col("sequence") % 6 != 0, F.concat_ws("|", F.lit("event"), "project_id", "trace_id"))
    return U.conflict_notes(V.events(spark, sf), "eid", key)


# -------------------------------------------------------- integrity and metrics

DIGEST_PARTS = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(d, {1 + 12 * i}, 12) AS HUGEINT)), 0) AS VARCHAR)" for i in range(5))


@query(f"SELECT count(*) AS n_rows, sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {DIGEST_PARTS})) AS digest FROM (SELECT sha256(concat_ws(chr(31), '=' || eid, '=' || trace_id, coalesce('=' || profile_id, '~'))) AS d FROM v_events)", V.EVENTS)
def projection_digest(spark, sf):
    return L.table_digest(V.events(spark, sf), ["eid", "trace_id", "profile_id"])


@query("SELECT CASE WHEN sequence % 21 = 0 THEN 'missing' WHEN sequence % 22 = 0 THEN 'changed' ELSE 'equal' END AS state, count(*) AS n FROM v_events GROUP BY 1", V.EVENTS)
def canonical_vs_derived(spark, sf):
    ev = V.events(spark, sf).select("eid", "sequence", F.sha2("content", 256).alias("h"))
    derived = ev.where("sequence % 21 <> 0").select("eid", F.when(F.col("sequence") % 22 == 0, F.reverse("h")).otherwise(F.col("h")).alias("h"))
    return Y.diagnose(ev, derived)


@query("SELECT table_name, token, count(*) AS n FROM (SELECT 'documents' AS table_name, text AS t FROM documents UNION ALL SELECT 'conversations', text FROM conversations), (SELECT unnest(['token = ', 'password']) AS token) WHERE contains(lower(t), token) GROUP BY ALL")
def derived_secret_scan(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    hits = Y.secret_scan({"documents": (t("documents"), "doc_id", ["text"]), "conversations": (t("conversations"), "conv_id", ["text"])}, ["token = ", "password"])
    return hits.groupBy("table_name", "token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT eid AS row_id, CASE WHEN sequence % 1501 = 7 THEN 'missing' ELSE 'changed' END AS state FROM v_events WHERE sequence % 1501 = 7 OR sequence % 1999 = 3", V.EVENTS)
def tree_compared(spark, sf):
    """Events against a derived copy: written digests are descended where they differ, only odd leaves are read."""
    from cairn.scratch import folder

    ev, a, b = V.events(spark, sf).select("eid", "trace_id", "content", "sequence"), folder(spark, "tree"), folder(spark, "tree")
    changed = ev.where("sequence % 1501 <> 7").withColumn("content", F.when(F.col("sequence") % 1999 == 3, F.upper("content")).otherwise(F.col("content")))
    Y.write_tree(ev, "eid", ["trace_id", "content"], a, 12)
    Y.write_tree(changed, "eid", ["trace_id", "content"], b, 12)
    return Y.tree_difference(spark, a, b, 12)


@query("SELECT token, count(*) AS n FROM documents, (SELECT lpad(CAST(i AS VARCHAR), 3, '0') AS token FROM (SELECT unnest(range(0, 1000)) AS i)) WHERE contains(text, token) GROUP BY token")
def tokens_scanned(spark, sf):
    """A thousand tokens over all documents in one pass."""
    hits = Y.token_scan(V.table(spark, sf, "documents"), "doc_id", ["text"], [f"{i:03d}" for i in range(1_000)])
    return hits.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall_at_k, round(avg(prec), 6) AS precision_at_k, round(avg(rr), 6) AS mrr FROM (
  SELECT query_id, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall, sum(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) / 10 AS prec, coalesce(1.0 / min(rank), 0.0) AS rr FROM (
    SELECT trace_id AS query_id, eid, row_number() OVER (PARTITION BY trace_id ORDER BY sha256(eid)) AS rank, lifecycle FROM v_events) WHERE lifecycle = 'active' GROUP BY query_id)""", V.EVENTS)
def recall_mrr_metrics(spark, sf):
    from pyspark.sql import Window

    ev = V.events(spark, sf)
    results = ev.select(F.col("trace_id").alias("query_id"), F.col("eid").alias("id"), F.row_number().over(Window.partitionBy("trace_id").orderBy(F.sha2("eid", 256))).alias("rank"))
    gold = ev.where("lifecycle = 'active'").select(F.col("trace_id").alias("query_id"), F.col("eid").alias("id"))
    return M.ranking(results, gold, 10)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return M.percentiles(V.table(spark, sf, "events"), "value", ["event_type"])


@query("SELECT sum(b) AS tokens_before, sum(a) AS tokens_after, round(1 - sum(a) / sum(b), 6) AS saved FROM (SELECT CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS b, CASE WHEN length(left(text, 280)) = 0 THEN 0 ELSE greatest(1, length(left(text, 280)) // 4) END AS a FROM documents WHERE text IS NOT NULL)")
def token_savings(spark, sf):
    d = V.table(spark, sf, "documents").where("text IS NOT NULL")
    return M.savings(d.select(X.estimate_tokens(F.col("text")).alias("b"), X.estimate_tokens(X.summary(F.col("text"))).alias("a")), "b", "a")


@query("SELECT *, canonical_sequence - coalesce(derived_sequence, -1) AS lag, CASE WHEN canonical_sequence = derived_sequence AND canonical_rows = derived_rows THEN 'CURRENT' WHEN derived_rows = 0 THEN 'UNAVAILABLE' ELSE 'PENDING' END AS state FROM (SELECT max(sequence) AS canonical_sequence, count(*) AS canonical_rows, max(sequence) FILTER (WHERE sequence % 50 <> 49) AS derived_sequence, count(*) FILTER (WHERE sequence % 50 <> 49) AS derived_rows FROM v_events)", V.EVENTS)
def freshness_watermark(spark, sf):
    from cairn.streaming.projection import freshness

    ev = V.events(spark, sf)
    return freshness(ev, ev.where(F.col("sequence") % 50 != 49))


@query()
def snippets(spark, sf):
    hits = S.find(V.table(spark, sf, "documents"), "doc_id", ["text"], S.prefix("schach"), fold=False).withColumnRenamed("id", "doc_id")
    return V.table(spark, sf, "documents").join(hits, "doc_id", "left_semi").select("doc_id", S.snippet(F.col("text"), ["schach"]).alias("snippet"))
