"""Catalogue: bounded subgraphs, source registration, deletions in chains, parity of all projections, notes and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import text as X
from cairn.operators import access as A
from cairn.operators import corpus as C
from cairn.operators import evidence as D
from cairn.operators import graph as G
from cairn.operators import ingest as N
from cairn.operators import integrity as Y
from cairn.operators import notes as O
from cairn.operators import records as R
from cairn.plans import views as V
from cairn.plans.corpus_queries import DEDUP, RULE
from cairn.plans.event_queries import POLICY
from cairn.plans.evidence_queries import ELIGIBLE, _items
from cairn.plans.record_queries import EDGE_ID, EDGES, TOMBS, _children, _tombs, _unnamed
from cairn.plans.registry import Area
from cairn.scratch import folder, written
from cairn.sources import jsonl
from cairn.sources.text_units import normalized_extraction

area = Area()
query = area.query

# ------------------------------------------------------------------------ graph

WALK = (
    EDGES,
    EDGE_ID,
    "v_ok AS (SELECT * FROM v_edges WHERE from_id NOT LIKE '%7' AND to_id NOT LIKE '%7')",
    """v_steps AS (SELECT from_id AS node, 0 AS way, edge_id, from_id, relation, to_id, to_id AS next, rn > 20 AS over FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY relation, edge_id) AS rn FROM v_ok) WHERE rn <= 21
  UNION ALL SELECT to_id, 1, edge_id, from_id, relation, to_id, from_id, rn > 20 FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY relation, edge_id) AS rn FROM v_ok) WHERE rn <= 21)""",
    "v_asked AS (SELECT DISTINCT 's' || s_suppkey AS seed FROM supplier)",
    "v_start AS (SELECT seed FROM v_asked WHERE seed NOT LIKE '%7' AND seed IN (SELECT from_id FROM v_ok UNION SELECT to_id FROM v_ok))",
    "w1 AS (SELECT seed, {'hop': 1, 'above': 0, 'way': way, 'relation': relation, 'edge_id': edge_id} AS met, s.* FROM v_start JOIN v_steps s ON node = seed)",
    "n1 AS (SELECT seed, next AS node, min(met) AS met FROM w1 WHERE NOT over AND next <> seed GROUP BY ALL)",
    "f1 AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY met) AS above FROM n1)",
    "w2 AS (SELECT seed, {'hop': 2, 'above': above, 'way': way, 'relation': relation, 'edge_id': edge_id} AS met, s.* FROM f1 JOIN v_steps s USING (node))",
    "n2 AS (SELECT seed, next AS node, min(met) AS met FROM w2 WHERE NOT over AND next <> seed AND (seed, next) NOT IN (SELECT (seed, node) FROM n1) GROUP BY ALL)",
    "w AS (SELECT seed, met, edge_id, relation, over FROM w1 UNION ALL SELECT seed, met, edge_id, relation, over FROM w2)",
    "nodes AS (SELECT *, 1 + row_number() OVER (PARTITION BY seed ORDER BY met) AS n FROM (SELECT *, 1 AS depth FROM n1 UNION ALL SELECT *, 2 FROM n2) UNION ALL SELECT seed, seed, NULL, 0, 1 FROM v_start)",
    "lines AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY met) AS n FROM (SELECT seed, edge_id, relation, min(met) AS met FROM w WHERE NOT over GROUP BY ALL))",
    "told_nodes AS (SELECT seed, string_agg(node || ':' || depth, ' ' ORDER BY node) FILTER (WHERE n <= 40) AS nodes, max(n) > 40 AS more_nodes, max(depth) >= 2 AS deep FROM nodes GROUP BY seed)",
    "told_lines AS (SELECT seed, string_agg(edge_id, ' ' ORDER BY relation, edge_id) FILTER (WHERE n <= 80) AS edges, max(n) > 80 AS more_edges FROM lines GROUP BY seed)",
    "told_wide AS (SELECT seed, bool_or(over) AS wide FROM w GROUP BY seed)",
)


@query("""SELECT seed, nodes IS NOT NULL AS authorized, coalesce(nodes, '') AS nodes, coalesce(edges, '') AS edges, concat_ws(' ', CASE WHEN deep THEN 'bound_max_depth' END, CASE WHEN more_edges THEN 'bound_max_edges' END,
  CASE WHEN wide THEN 'bound_max_fan_out' END, CASE WHEN more_nodes THEN 'bound_max_nodes' END) AS codes FROM v_asked LEFT JOIN told_nodes USING (seed) LEFT JOIN told_lines USING (seed) LEFT JOIN told_wide USING (seed)""", *WALK)
def subgraph_bounds(spark, sf):
    """The bounded neighbourhood of every supplier; nodes whose name ends in 7 are hidden."""
    edges = written(_unnamed(spark, sf), "edges")
    seeds = V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    out = G.subgraph(edges, seeds, lambda node: ~node.endswith("7"))
    named = F.transform("nodes", lambda n: F.concat(n["node"], F.lit(":"), n["depth"].cast("string")))
    return out.select("seed", "authorized", F.array_join(named, " ").alias("nodes"), F.array_join("edges.edge_id", " ").alias("edges"), F.array_join("bound_codes", " ").alias("codes"))


# ---------------------------------------------------------------------- sources

_q = lambda c: f"""coalesce('"' || {c} || '"', 'null')"""
SOURCES = f"""v_sources AS (
  SELECT *, 'sv_' || left(sha256('zm8.content|v1|{{"content_hash":"' || content_hash || '","normalization_version":"m10.3","scope":[' || {_q("profile_id")} || ',' || {_q("project_id")} || ',null],"source_id":"' || source_id || '"}}'), 32) AS version_id
  FROM (SELECT *, sha256('zm8.content|v1|{{"bytes_sha256":"' || sha256(coalesce(text, '')) || '","domain":"zm10.corpus_source_content"}}') AS content_hash,
      sha256('zm8.content|v1|{{"descriptor":{{"external_ref":"' || external_ref || '","kind":"txt","knowledge_space_id":null,"profile_id":' || {_q("profile_id")} || ',"project_id":' || {_q("project_id")} || '}},"domain":"zm10.corpus_logical_source"}}') AS source_id
    FROM (SELECT doc_id, 'doc' || (doc_id // 4) AS external_ref, source AS profile_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS project_id, text FROM documents)))"""


def _sources(spark, sf):
    d = F.col("doc_id")
    return V.table(spark, sf, "documents").select(
        d.cast("long").alias("position"), F.concat(F.lit("doc"), F.floor(d / 4).cast("string")).alias("external_ref"), F.lit("txt").alias("kind"), F.col("source").alias("profile_id"),
        F.when(d % 3 == 0, F.col("lang")).alias("project_id"), F.lit(None).cast("string").alias("knowledge_space_id"), F.col("text").alias("content"),
    )


@query("""SELECT pos AS position, source_id, version_id, CASE WHEN before = version_id THEN 'existing' ELSE 'registered' END AS outcome, CASE WHEN before <> version_id THEN before END AS supersedes, CASE WHEN hash <> content_hash THEN hash END AS predecessor_content_hash
  FROM (SELECT *, lag(version_id) OVER (PARTITION BY source_id ORDER BY pos) AS before, lag(content_hash) OVER (PARTITION BY source_id ORDER BY pos) AS hash FROM (SELECT *, doc_id AS pos FROM v_sources UNION ALL SELECT *, doc_id + 1000000000 FROM v_sources)) WHERE pos >= 1000000000""", SOURCES)
def source_registered(spark, sf):
    """Every document registered again behind a registry of all of them; four numbers share a place."""
    registry = _sources(spark, sf)
    batch = registry.withColumn("position", F.col("position") + 1_000_000_000)
    return C.register_sources(registry, batch).select("position", "source_id", "version_id", "outcome", "supersedes", "predecessor_content_hash")


@query("SELECT doc_id AS position, 'old' || doc_id AS legacy_source_id, sha256(external_ref) AS legacy_content_hash, source_id, version_id, lag(version_id) OVER w AS supersedes, lag(content_hash) OVER w AS predecessor_content_hash FROM v_sources WINDOW w AS (PARTITION BY source_id ORDER BY doc_id)", SOURCES)
def legacy_rekeyed(spark, sf):
    old = _sources(spark, sf).withColumns({"source_id": F.concat(F.lit("old"), F.col("position").cast("string")), "content_hash": F.sha2("external_ref", 256)})
    return C.rekey_legacy(old).select("position", "legacy_source_id", "legacy_content_hash", "source_id", "version_id", "supersedes", "predecessor_content_hash")


ACCEPTED = "v_accepted AS (SELECT *, " + RULE.replace("body", "text") + " AS rule FROM v_units)"


@query("""SELECT 'sources' AS what, (SELECT count(DISTINCT doc_id) FROM documents) AS n UNION ALL SELECT 'empty_sources', (SELECT count(DISTINCT doc_id) FROM documents WHERE 'd' || doc_id NOT IN (SELECT source_ref FROM v_units))
  UNION ALL SELECT 'units', (SELECT count(*) FROM u_dedup) UNION ALL SELECT 'rejected', (SELECT count(*) FROM v_accepted WHERE rule IS NOT NULL) UNION ALL SELECT 'repeats', (SELECT count(duplicate_of) FROM u_dedup)
  UNION ALL SELECT 'edges', (SELECT count(*) + count(duplicate_of) FROM u_dedup)""", V.UNITS, ACCEPTED, DEDUP.replace("FROM v_units", "FROM v_accepted WHERE rule IS NULL"))
def corpus_projected(spark, sf):
    """The report of the whole corpus projection."""
    docs = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_ref"), "text")
    return C.project_corpus(docs)[2]


@query("""SELECT 'new' AS what, count(*) AS n FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'changed', count(*) FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0 UNION ALL SELECT 'removed', count(*) FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT 'unchanged', count(*) FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT 'units', (SELECT count(*) FROM u_dedup) UNION ALL SELECT 'edges', (SELECT count(*) + count(duplicate_of) FROM u_dedup)""", V.UNITS, ACCEPTED, DEDUP.replace("FROM v_units", "FROM v_accepted WHERE rule IS NULL"))
def corpus_synced(spark, sf):
    """A corpus of earlier documents brought to those of now: only what changed is extracted again."""
    from cairn.operators import sync

    held, i = sync.store(spark, folder(spark, "corpus"), buckets=16), F.col("doc_id")
    name = lambda prefix: F.concat(F.lit(prefix), i.cast("string")).alias("source_ref")
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    before = docs.where(i % 10 != 0).select(name("d"), F.when(i % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")).alias("text"))
    sync.sync(held, before.unionByName(docs.where(i % 13 == 0).select(name("gone"), "text")), 0)
    counts = sync.sync(held, docs.select(name("d"), "text"), 1)
    told = spark.createDataFrame(list(counts.items()), "what string, n long")
    size = lambda what, rows: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return told.unionByName(size("units", sync.units(held))).unionByName(size("edges", sync.edges(held)))


# ------------------------------------------------------------------ projections


@query("""SELECT sequence, eid AS event_id, profile_id, array_to_string(list_distinct(spaces), ',') = '' AS unscoped, 'sha256:' || sha256('"' || replace(replace(content, '\\', '\\\\'), '"', '\\"') || '"') AS sanitized_content_hash FROM v_events""", V.EVENTS)
def normalized_events(spark, sf):
    payloads = V.events(spark, sf).select(F.col("eid").alias("event_id"), "trace_id", "sequence", "profile_id", F.col("spaces").alias("knowledge_space_ids"), F.col("content").alias("sanitized_content"))
    out = jsonl.normalized_events(payloads, F.lit("system_event"), "tables")
    return out.select("sequence", "event_id", "profile_id", (F.size("knowledge_space_ids") == 0).alias("unscoped"), "sanitized_content_hash")


@query("""SELECT eid, CASE WHEN s IS NULL OR e IS NULL OR e >= s THEN 'men_' || left(sha256('zm8.entity_mention|v1|{"entity_id":"' || trace_id || '","source_event_id":"' || eid || '","span_end":' || coalesce(CAST(e AS VARCHAR), 'null') || ',"span_start":' || coalesce(CAST(s AS VARCHAR), 'null') || '}'), 32) END AS mention_id
  FROM (SELECT *, CASE WHEN sequence % 5 <> 0 THEN sequence % 7 END AS s, CASE WHEN sequence % 3 <> 0 THEN sequence % 11 END AS e FROM v_events)""", V.EVENTS)
def mention_ids(spark, sf):
    s = F.col("sequence")
    return V.events(spark, sf).select("eid", I.mention_id(F.col("trace_id"), F.col("eid"), F.when(s % 5 != 0, s % 7), F.when(s % 3 != 0, s % 11)).alias("mention_id"))


@query("""SELECT trace_id, eid, CASE WHEN before.gone IS NULL OR before.gone > sequence THEN before.eid END AS supersedes, CASE WHEN gone IS NULL OR gone > behind.sequence THEN behind.eid END AS superseded_by,
  CASE WHEN gone IS NOT NULL THEN 'deleted' WHEN behind IS NOT NULL THEN 'superseded' ELSE 'active' END AS current_state
  FROM (SELECT *, lag({'eid': eid, 'gone': gone, 'sequence': sequence}) OVER w AS before, lead({'eid': eid, 'gone': gone, 'sequence': sequence}) OVER w AS behind FROM (
    SELECT e.*, CASE WHEN asked IS NOT NULL THEN greatest(asked, e.sequence) END AS gone FROM v_events e LEFT JOIN (SELECT target_id, min(sequence) AS asked FROM v_tombs GROUP BY 1) ON target_id = eid WHERE lifecycle = 'active') WINDOW w AS (PARTITION BY trace_id ORDER BY sequence))""", V.EVENTS, TOMBS)
def supersession_and_deletions(spark, sf):
    return N.supersessions(V.events(spark, sf), _tombs(spark, sf).select("target_id", "sequence"))


PROJECTED = "artifacts deletion_audit lifecycle meta postings provenance relations tombstones".split()


@query("SELECT unnest([" + ", ".join(f"'{p}'" for p in PROJECTED) + "]) AS projection, 0 AS only_left, 0 AS only_right, true AS equal UNION ALL SELECT 'scopes', (SELECT count(DISTINCT project_id) FROM v_events) + (SELECT count(DISTINCT s) FROM (SELECT unnest(spaces) AS s FROM v_events)), 0, false", V.EVENTS)
def rebuild_parity(spark, sf):
    """All nine projections against a rebuild from the log in another order, which lost scopes but those of profiles."""
    log = _log(spark, sf)
    kept, again = N.projections(written(log, "log")), N.projections(written(log.repartition(7, "content"), "log"))
    again["scopes"] = again["scopes"].where("scope_type = 'profile'")
    return Y.parity(kept, again)


def _log(spark, sf):
    """The events with relations, artifacts and deletions."""
    s = F.col("sequence")
    name = lambda n: F.concat(F.lit("e"), F.lpad(n.cast("string"), 9, "0"))
    target = F.when(s % 3 == 0, F.floor(s / 2)).when(s % 3 == 1, s + 7).otherwise(s + 100_000_000)
    return _children(spark, sf).withColumns({
        "relation_ids": F.array(name(F.floor(s / 3)), F.concat(F.lit("t"), (s % 90).cast("string"))),
        "artifact_refs": F.array(F.struct(F.concat(F.lit("a"), (s % 50).cast("string")).alias("artifact_id"))),
        "tombstone_target": F.when(F.col("lifecycle") == "deleted", name(target)),
    })


@query("""SELECT unnest(['artifacts', 'deletion_audit', 'lifecycle', 'meta', 'postings', 'provenance', 'relations', 'scopes', 'tombstones']) AS projection, 0 AS only_left, 0 AS only_right, true AS equal
  UNION ALL SELECT outcome, count(*), 0, false FROM (SELECT 'new_event' AS outcome FROM v_events UNION ALL SELECT CASE sequence % 3 WHEN 0 THEN 'duplicate_event_id' WHEN 1 THEN 'event_id_content_conflict' ELSE 'duplicate_content_hash' END FROM v_events WHERE sequence % 4 = 0) GROUP BY 1""", V.EVENTS)
def stream_parity(spark, sf):
    """The log and repeats of its ids and contents, taken in by batches: all nine projections against those of the
    accepted lines at once, and what became of the lines."""
    from cairn.streaming import maintained as M

    s = F.col("sequence")
    log = written(_log(spark, sf).withColumn("content_hash", F.sha2(F.concat_ws("-", "content", "eid"), 256)).select(*M.LINE), "log")
    n = log.agg(F.max("sequence")).scalar()
    again = log.where(s % 4 == 0).withColumns({"eid": F.when(s % 3 == 2, F.concat(F.lit("x"), "eid")).otherwise(F.col("eid")), "content_hash": F.when(s % 3 == 1, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))})
    lines = log.unionByName(again.withColumn("sequence", s + n + 1))
    store, now = M.Store(spark, folder(spark, "maintained"), buckets=16), F.col("sequence")
    for number, part in enumerate((now <= n / 2, (now > n / 2) & (now <= n * 9 / 8), now > n * 9 / 8)):
        M.commit(store, lines.where(part), number)
    parity = Y.parity(N.projections(log), M.projections(store))
    told = store.appended("outcomes").groupBy(F.col("outcome").alias("projection")).agg(F.count(F.lit(1)).alias("only_left"))
    return parity.unionByName(told.select("projection", "only_left", F.lit(0).cast("long").alias("only_right"), F.lit(False).alias("equal")))


# ------------------------------------------------------------------------ notes


def _inline(x: str) -> str:
    data = f"replace(replace(replace(replace({x}, '\\', '\\\\'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"coalesce(regexp_replace({data}, '([\\[\\]|#`*_!$~^{{}}])', '\\\\\\1', 'g'), '(none)')"


def _yaml(x: str) -> str:
    return f"""coalesce('"' || {x} || '"', 'null')"""


def _note_sql(kind: str, table: str, have: dict[str, str], title: str) -> str:
    """The oracle of ``record_notes`` for records whose texts hold no control characters."""
    get = lambda c: have.get(c, "CAST(NULL AS VARCHAR)")
    ident, project, life = get(O.FIELDS[kind][0]), get("project_id"), get("lifecycle_status")
    digest = f"""sha256('{{"kind":"{kind}","profile_id":null,"project_id":' || {_yaml(project)} || ',"resource_id":"' || {ident} || '"}}')"""
    bullet = lambda c, value: f"'- **{c.replace('_', ' ').capitalize()}:** ' || {_inline(value)}"
    note_id = f"'note-{kind}-' || left({digest}, 16)"
    head = f"""'---' || chr(10) || 'managed: true' || chr(10) || 'note_id: "' || {note_id} || '"' || chr(10) || 'kind: "{kind}"' || chr(10) || 'resource_id: ' || {_yaml(ident)} || chr(10) || 'project_id: ' || {_yaml(project)} || chr(10) || 'profile_id: null' || chr(10) || 'lifecycle_status: ' || {_yaml(life)} || chr(10) || '---'"""
    banner = "CASE " + life + " " + " ".join(f"WHEN '{k}' THEN '> {t}'" for k, t in O.BANNERS.items()) + " END"
    record = " || chr(10) || ".join(["'## Record' || chr(10)", *[bullet(c, get(c)) for c in O.FIELDS[kind]]])
    source = " || chr(10) || ".join(["'## Provenance' || chr(10)", *[bullet(c, ident if c == "resource_id" else get(c)) for c in O.PROVENANCE]])
    slug = lambda c, other: f"coalesce(nullif(left(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), 60), ''), '{other}')"
    path = f"'{O.DIRECTORIES[kind]}/' || {slug(project, 'unscoped')} || '/' || {slug(title, 'note')} || '-' || left({digest}, 16) || '.md'"
    body = f"concat_ws(chr(10) || chr(10), {head}, '# ' || {_inline(title)}, {banner}, {record}, {source}) || chr(10)"
    return f"SELECT {note_id} AS note_id, '{kind}' AS note_kind, {ident} AS resource_id, {project} AS project_id, {path} AS note_path, 'sha256:' || sha256({body}) AS fp FROM {table}"


CHECKS = {"verification_id": "verification_id", "project_id": "'s' || supplier_key", "subject_type": "'part'", "subject_id": "CAST(subject_id AS VARCHAR)", "verification_status": "verification_status", "timestamp": "timestamp"}
NOTES = "v_notes AS (" + _note_sql("verification", "v_verifications", CHECKS, "verification_id") + ")"


def _checks(spark, sf):
    rows = V.verifications(spark, sf)
    return O.record_notes(rows.select("verification_id", F.concat(F.lit("s"), F.col("supplier_key").cast("string")).alias("project_id"), F.lit("part").alias("subject_type"), F.col("subject_id").cast("string").alias("subject_id"), "verification_status", "timestamp"), "verification")


@query("SELECT * FROM v_notes", V.VERIFICATIONS, NOTES)
def verification_notes(spark, sf):
    return _checks(spark, sf).drop("body")


ASKS = {"requirement_id": "'r' || p_partkey", "statement": "p_name", "project_id": "p_brand", "lifecycle_status": "CASE p_partkey % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'conflicted' WHEN 2 THEN 'archived' ELSE 'active' END", "state": "p_type"}


@query(_note_sql("requirement", "part", ASKS, "p_name"))
def requirement_notes(spark, sf):
    p = F.col("p_partkey")
    life = F.when(p % 4 == 0, "superseded").when(p % 4 == 1, "conflicted").when(p % 4 == 2, "archived").otherwise("active")
    rows = V.table(spark, sf, "part").select(F.concat(F.lit("r"), p.cast("string")).alias("requirement_id"), F.col("p_name").alias("statement"), F.col("p_brand").alias("project_id"), life.alias("lifecycle_status"), F.col("p_type").alias("state"))
    return O.record_notes(rows, "requirement").drop("body")


@query()
def state_notes(spark, sf):
    """Notes of the active decisions of each project, in pages."""
    d = V.decisions(spark, sf)
    return O.state_notes(d.select("project_id", F.col("decision_id").alias("state_key"), F.col("statement").alias("state_value"), F.col("status").alias("lifecycle_status"), "effective_at")).drop("body")


@query()
def conflict_pages(spark, sf):
    """Conflicts of events by trace, and the index of them."""
    events = V.events(spark, sf).select("eid", "project_id", "trace_id", F.col("lifecycle").alias("lifecycle_status"), F.col("content").alias("statement"))
    return O.conflict_note_pages(events, "eid", F.col("trace_id")).unionByName(O.conflict_index(events, "eid", F.col("trace_id"))).drop("body")


@query("""SELECT note_id, sha256('{"fp":"' || fp || '","note_id":"' || note_id || '","note_kind":"verification","note_path":"' || note_path || '","project_id":' || coalesce('"' || project_id || '"', 'null') || ',"resource_id":"' || resource_id || '","status":"current"}') AS line FROM v_notes""", V.VERIFICATIONS, NOTES)
def manifest_lines(spark, sf):
    return O.manifest_lines(_checks(spark, sf).withColumn("status", F.lit("current"))).select("note_id", F.sha2("line", 256).alias("line"))


BREAKS = "'[\\n\\r\\t]', ' ', 'g'"


@query(f"""SELECT doc_id, sha256({_inline("left(flat, 2000)")} || CASE WHEN length(flat) > 2000 THEN '…[truncated]' ELSE '' END) AS inline, CASE WHEN regexp_full_match(source, '[A-Za-z0-9._:/ -]+') AND source = trim(source) AND length(source) <= 120 AND NOT contains(source, '..') THEN source ELSE 'doc' || doc_id END AS label
  FROM (SELECT doc_id, source, nullif(trim(regexp_replace(regexp_replace(regexp_replace(text, {BREAKS}), '[\\x00-\\x1f\\x7f]', '', 'g'), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g')), '') AS flat FROM documents)""")
def escaped_inline(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(X.escape_inline(F.col("text")), 256).alias("inline"), X.safe_link_display(F.col("source"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("label"))


# ---------------------------------------------------------------- lists, audits


@query("SELECT verification_id, timestamp, verification_status FROM v_verifications WHERE supplier_key = 3 AND verification_status = 'user_confirmation' ORDER BY verification_id, timestamp LIMIT 50", V.VERIFICATIONS)
def verifications_listed(spark, sf):
    rows = V.verifications(spark, sf).withColumn("project_id", F.concat(F.lit("s"), F.col("supplier_key").cast("string")))
    return R.listed(rows, "verification", "s3", verification_status="user_confirmation").select("verification_id", "timestamp", "verification_status")


@query(f"SELECT request_id, reason FROM ({POLICY}) WHERE reason NOT LIKE 'ALLOW%'", V.REQUESTS)
def policy_audited(spark, sf):
    return A.policy_audit(A.decide(V.requests(spark, sf))).select("request_id", "reason")


@query("""SELECT outcome, count(*) AS n, count(DISTINCT to_id) AS subjects FROM (SELECT CAST(subject_id AS VARCHAR) AS to_id, CASE WHEN subject_id % 9 = 0 THEN 'missing_endpoint' WHEN quantity % 4 = 0 THEN 'unmapped_subject_type' ELSE 'kept' END AS outcome FROM v_verifications) GROUP BY outcome""", V.VERIFICATIONS)
def verification_edges(spark, sf):
    s, q = F.col("subject_id"), F.col("quantity")
    kind = F.when(q % 4 == 0, "mood").when(q % 4 == 1, "decision").otherwise("requirement")
    rows = V.verifications(spark, sf).select("verification_id", kind.alias("subject_type"), s.cast("string").alias("whole"), F.when(s % 9 != 0, s.cast("string")).alias("subject_id"), "verification_status")
    told = G.verification_edges(rows, {"decision": "decision", "requirement": "requirement"}).join(rows.select(F.col("verification_id").alias("from_id"), "whole"), "from_id")
    return told.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("whole").alias("subjects"))


@query("""SELECT session_id, eid, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY CASE WHEN event_type = 'system_event' AND lifecycle = 'active' THEN 0 ELSE 1 END, CASE WHEN verification <> 'none' THEN 0 ELSE 1 END,
    CASE WHEN lifecycle = 'active' THEN 0 ELSE 1 END, created_at, eid) AS rank FROM v_items WHERE role IS NOT NULL) WHERE rank <= CASE role WHEN 'primary' THEN 5 ELSE 3 END""", V.EVENTS, ELIGIBLE)
def evidence_project_order(spark, sf):
    """Evidence of each session in the order of the project route; system events stand for states."""
    items = _items(spark, sf).withColumn("resource_type", F.when(F.col("event_type") == "system_event", "state").otherwise("event"))
    return D.select_evidence(items, ["session_id"], D.evidence_order("project_memory"), F.lit(1).cast("long")).select("session_id", "eid", "role", "rank")


@query("""SELECT source_ref, CASE doc_id % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'failed' ELSE CASE WHEN n = 0 THEN 'empty' ELSE 'complete' END END AS status, CASE WHEN doc_id % 5 < 2 THEN 0 ELSE n END AS n_units,
    CASE doc_id % 5 WHEN 0 THEN 'extraction_parser_unavailable' WHEN 1 THEN 'extraction_corrupt_source' END AS error_reason
  FROM (SELECT DISTINCT 'd' || doc_id AS source_ref, doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) <> '' THEN 1 ELSE 0 END AS n FROM documents)""")
def extraction_status(spark, sf):
    d = F.col("doc_id")
    status = F.when(d % 5 == 0, "parser_unavailable").when(d % 5 == 1, "corrupt_source").otherwise("complete")
    rows = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), d.cast("string")).alias("source_ref"), status.alias("status"), "text")
    return normalized_extraction(rows)[1]
