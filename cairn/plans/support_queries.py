"""Catalogue: hooks, field rules, text folding, context budgets, corpus neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import corpus as C
from cairn.operators import evidence as D
from cairn.operators import graph as G
from cairn.plans import views as V
from cairn.plans.evidence_queries import DIGEST_PARTS
from cairn.plans.corpus_queries import DEDUP
from cairn.plans.evidence_queries import ELIGIBLE, _items
from cairn.plans.registry import Area
from cairn.scratch import written
from cairn.sources import hooks

area = Area()
query = area.query


@query("""SELECT conv_id, turn, hook, CASE WHEN hook = 'unknown' THEN 'deferred' WHEN hook = 'pre_api_request' THEN 'conditional_fixture_required' ELSE 'mapped' END AS status,
    CASE hook WHEN 'pre_llm_call' THEN 'user_statement' WHEN 'post_llm_call' THEN 'assistant_claim' WHEN 'on_session_start' THEN 'system_event' END AS event_type,
    CASE WHEN hook IN ('pre_llm_call', 'post_llm_call') THEN 'llm_api_lifecycle' WHEN hook = 'on_session_start' THEN 'session_lifecycle' END AS event_class, 'host.' || hook AS event_source,
    CASE WHEN hook IN ('pre_llm_call', 'post_llm_call') THEN 'observed:' || hook || ':' || left(sha256(hook || chr(0) || '{"session_id":"' || conv_id || '","turn_id":"' || turn || '"}'), 32)
      WHEN hook = 'on_session_start' THEN 'observed:' || hook || ':' || left(sha256(hook || chr(0) || '{"session_id":"' || conv_id || '"}'), 32) END AS mapped_event_id
  FROM (SELECT conv_id, turn, CASE WHEN turn % 8 = 7 THEN 'pre_api_request' WHEN turn % 8 = 6 THEN 'unknown' WHEN role = 'user' THEN 'pre_llm_call' WHEN role = 'assistant' THEN 'post_llm_call' ELSE 'on_session_start' END AS hook FROM conversations)""")
def hook_mapping(spark, sf):
    turn = F.col("turn") % 8
    hook = F.when(turn == 7, "pre_api_request").when(turn == 6, "unknown").when(F.col("role") == "user", "pre_llm_call").when(F.col("role") == "assistant", "post_llm_call").otherwise("on_session_start")
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", hook.alias("hook"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("turn_id"))
    return hooks.map_hooks(rows).drop("session_id", "turn_id")


KEYS = ("password", "Api-Key", "my_oauth_token", "refresh_token", "Authorization", "ssh_private_key", "note", "client_secret")


@query("SELECT doc_id, key, CASE WHEN key = 'password' THEN 'password_assignment' WHEN key = 'Api-Key' THEN 'api_key_assignment' WHEN key IN ('my_oauth_token', 'refresh_token', 'client_secret') THEN 'oauth_secret' WHEN key = 'Authorization' THEN 'authorization_header' WHEN key = 'ssh_private_key' THEN 'private_key_block' END AS rule FROM (SELECT doc_id, ["
  + ", ".join(f"'{k}'" for k in KEYS) + "][doc_id % 8 + 1] AS key FROM documents)")
def field_rules(spark, sf):
    key = F.get(F.array(*map(F.lit, KEYS)), (F.col("doc_id") % 8).cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", key.alias("key"), X.field_rule(key).alias("rule"))


def _marks_broken(x: str) -> str:
    for mark in X.ROLE_MARKS:
        x = f"replace({x}, '{mark}', '{mark[:4]}' || chr(8203) || '{mark[4]}' || chr(8203) || '{mark[5:]} (data)')"
    return x


ONE_LINE = r"regexp_replace(regexp_replace(coalesce(text, ''), '[\x00\r]', '', 'g'), '[\n\t]', ' ', 'g')"


@query(f"SELECT doc_id, sha256(line) AS line, sha256(left(line, 280)) AS summary FROM (SELECT doc_id, left(replace(replace({_marks_broken(ONE_LINE)}, '---', '—'), '...', '…'), 2000) AS line FROM documents)")
def escaped_fields(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(X.escape_field(F.col("text")), 256).alias("line"), F.sha2(X.escape_summary(F.col("text")), 256).alias("summary"))



@query("SELECT doc_id, sha256(strip_accents(lower(text))) AS folded FROM documents WHERE text IS NOT NULL")
def accents_folded(spark, sf):
    return V.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(X.strip_accents(F.lower("text")), 256).alias("folded"))


@query("SELECT trace_id, array_to_string(list(space ORDER BY first, place), ',') AS spaces FROM (SELECT trace_id, space, min(sequence) AS first, arg_min(place, sequence) AS place FROM (SELECT trace_id, sequence, unnest(spaces) AS space, unnest(range(1, len(spaces) + 1)) AS place FROM v_events) GROUP BY ALL) GROUP BY trace_id", V.EVENTS)
def ordered_spaces(spark, sf):
    """Spaces of each trace in order of first mention, from one small row for each space."""
    each = V.events(spark, sf).select("trace_id", "sequence", F.posexplode("spaces").alias("at", "space"))
    first = each.groupBy("trace_id", "space").agg(F.min(F.struct("sequence", "at")).alias("first"))
    listed = first.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("first", "space"))).alias("s"))
    return listed.select("trace_id", F.array_join("s.space", ",").alias("spaces"))


@query("""SELECT session_id, eid, role, rank, used FROM (
    SELECT *, sum(length(content)) OVER (PARTITION BY session_id ORDER BY CASE role WHEN 'primary' THEN 0 ELSE 1 END, rank) AS used, row_number() OVER (PARTITION BY session_id ORDER BY CASE role WHEN 'primary' THEN 0 ELSE 1 END, rank) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY created_at, eid) AS rank FROM v_items WHERE role IS NOT NULL) WHERE rank <= CASE role WHEN 'primary' THEN 5 ELSE 3 END)
  WHERE (n = 1 AND role = 'primary') OR used <= 90""", V.EVENTS, ELIGIBLE)
def context_budget(spark, sf):
    chosen = D.select_evidence(_items(spark, sf), ["session_id"], ["created_at", "eid"], F.lit(1).cast("long"))
    return D.fit_context(chosen, ["session_id"], F.length("content").cast("long"), 90).select("session_id", "eid", "role", "rank", "used")


CORPUS_EDGES = "c_edges AS (SELECT source_ref AS a, location_id AS b, 'source_of' AS relation FROM u_dedup WHERE project_id = 'en' UNION ALL SELECT location_id, duplicate_of, 'derived_from' FROM u_dedup WHERE duplicate_of IS NOT NULL AND project_id = 'en')"


@query("""SELECT node, min(depth) AS relation_distance FROM (
  SELECT 'd7' AS node, 0 AS depth WHERE EXISTS (SELECT 1 FROM c_edges WHERE a = 'd7') UNION ALL SELECT b, 1 FROM h1 WHERE rn <= 20
  UNION ALL SELECT b, 2 FROM (SELECT e.b, row_number() OVER (PARTITION BY e.a ORDER BY relation, e.a || '>' || e.b) AS rn FROM c_edges e WHERE e.a IN (SELECT b FROM h1 WHERE rn <= 20)) WHERE rn <= 20
  UNION ALL SELECT a, 2 FROM (SELECT e.a, row_number() OVER (PARTITION BY e.b ORDER BY relation, e.a || '>' || e.b) AS rn FROM c_edges e WHERE e.b IN (SELECT b FROM h1 WHERE rn <= 20)) WHERE rn <= 20) GROUP BY node""",
  V.UNITS, DEDUP, CORPUS_EDGES, "h1 AS (SELECT b, row_number() OVER (PARTITION BY a ORDER BY relation, a || '>' || b) AS rn FROM c_edges WHERE a = 'd7')")
def corpus_neighbourhood(spark, sf):
    """Two hops from one source; only English units are in scope."""
    units = C.dedup_units(V.units(spark, sf).where("project_id = 'en'"), content="text")
    edges = C.corpus_edges(units)
    edges = written(edges.withColumn("edge_id", F.concat("from_id", F.lit(">"), "to_id")), "corpus_edges")
    allowed = edges.select(F.col("from_id").alias("node")).unionByName(edges.select(F.col("to_id").alias("node"))).distinct()
    return G.distances(G.neighbourhood(edges, spark.createDataFrame([("d7",)], "node string"), allowed))


@query(f"SELECT 'events' AS index_name, count(*) AS n_rows, sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {DIGEST_PARTS})) AS digest, 'published' AS status FROM (SELECT sha256(concat_ws(chr(31), '=' || eid, '=' || trace_id, '=' || lifecycle)) AS d FROM v_events)", V.EVENTS)
def index_registry(spark, sf):
    return G.registry_row(V.events(spark, sf), "events", ["eid", "trace_id", "lifecycle"])
