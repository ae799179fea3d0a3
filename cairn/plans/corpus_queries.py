"""Catalogue: full-text search and the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import corpus as C
from cairn.operators import events as E
from cairn.operators import search as S
from cairn.plans import views as V
from cairn.plans.registry import Area

area = Area()
query = area.query

TERMS = "v_terms AS (SELECT eid AS id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM v_events)"
DOC_TERMS = "d_terms AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM documents WHERE text IS NOT NULL)"


def _in_events(spark, sf, condition):
    return S.find(V.events(spark, sf), "eid", ["content"], condition, fold=False)


def _in_docs(spark, sf, condition):
    return S.find(V.table(spark, sf, "documents"), "doc_id", ["text"], condition, fold=False)


@query("SELECT id FROM v_terms WHERE list_contains(terms, 'view') AND list_contains(terms, '69')", V.EVENTS, TERMS)
def fts_and(spark, sf):
    return _in_events(spark, sf, S.all_of(S.term("view"), S.term("69")))


@query("""SELECT id, match_mode FROM (
  SELECT id, 'strict' AS match_mode FROM v_terms WHERE list_contains(terms, 'signup') AND list_contains(terms, 'zebra')
  UNION ALL SELECT id, 'any_term' FROM v_terms WHERE (list_contains(terms, 'signup') OR list_contains(terms, 'zebra'))
    AND NOT EXISTS (SELECT 1 FROM v_terms WHERE list_contains(terms, 'signup') AND list_contains(terms, 'zebra')))""", V.EVENTS, TERMS)
def fts_or_fallback(spark, sf):
    return S.with_fallback(V.events(spark, sf), "eid", ["content"], "signup zebra", fold=False)


@query("SELECT id FROM v_terms WHERE (list_contains(terms, 'click') OR list_contains(terms, 'error')) AND NOT list_contains(terms, '89')", V.EVENTS, TERMS)
def fts_not(spark, sf):
    return _in_events(spark, sf, S.but_not(S.any_of(S.term("click"), S.term("error")), S.term("89")))


@query("SELECT DISTINCT id FROM (SELECT id, terms, unnest(range(1, len(terms))) AS i FROM d_terms) WHERE terms[i] = 'of' AND terms[i + 1] = 'the'", DOC_TERMS)
def fts_phrase(spark, sf):
    return _in_docs(spark, sf, S.phrase("of the"))


@query("SELECT id FROM d_terms WHERE len(list_filter(terms, lambda t: starts_with(t, 'schach'))) > 0", DOC_TERMS)
def fts_prefix(spark, sf):
    return _in_docs(spark, sf, S.prefix("schach"))


@query("""SELECT DISTINCT a.id FROM (SELECT id, unnest(range(1, len(terms) + 1)) AS i, terms FROM d_terms) a
  JOIN (SELECT id, unnest(range(1, len(terms) + 1)) AS i, terms FROM d_terms) b ON a.id = b.id
  WHERE a.terms[a.i] = 'with' AND b.terms[b.i] = 'that' AND abs(a.i - b.i) <= 4""", DOC_TERMS)
def fts_near(spark, sf):
    return _in_docs(spark, sf, S.near(["with", "that"], 3))


@query("SELECT e.eid, e.created_at, e.verification FROM v_events e JOIN v_terms t ON e.eid = t.id WHERE list_contains(terms, 'purchase') AND e.verification = 'user_confirmation' AND e.project_id = 'j1' AND e.lifecycle <> 'deleted'", V.EVENTS, TERMS)
def fts_filtered(spark, sf):
    ev = V.events(spark, sf)
    found = S.matches(S.term("purchase"), ["content"], fold=False)
    rows = E.visible(ev.where(E.condition(verification="user_confirmation", project_id="j1") & found), E.deleted_ids(ev))
    return rows.select("eid", "created_at", "verification")


@query("SELECT doc_id AS id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM documents) WHERE list_contains(terms, 'ete') OR len(list_filter(terms, lambda t: starts_with(t, 'uber'))) > 0")
def fts_accents(spark, sf):
    """Words are found whatever accents they carry."""
    return S.find(V.table(spark, sf, "documents"), "doc_id", ["text"], S.any_of(S.term("ete"), S.prefix("uber")))


@query("SELECT id FROM (SELECT conv_id || '-' || turn AS id, list_filter(regexp_split_to_array(lower(strip_accents(role)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS roles, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM conversations) WHERE list_contains(roles, 'user') AND (terms[1] = 'the' OR list_contains(terms, 'of'))")
def fts_column(spark, sf):
    """A word in one column, and another at the start of a second or anywhere in it."""
    turns = V.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text")
    wanted = S.all_of(S.term("user", "role"), S.any_of(S.term("the", "text", first=True), S.term("of", "text")))
    return S.find(turns, "id", ["role", "text"], wanted)


def _index(spark, sf, docs, ident, columns, fold, cut):
    """An index over a table, written in two batches."""
    from cairn.operators.inverted import Index
    from cairn.scratch import folder

    out = Index(spark, folder(spark, "index"), columns, fold, buckets=8)
    for number, part in enumerate((cut, ~cut)):
        out.add(docs.where(part), ident, number)
    return out


@query("""SELECT 'and' AS search, id FROM v_terms WHERE list_contains(terms, 'view') AND list_contains(terms, '69')
  UNION ALL SELECT 'not', id FROM v_terms WHERE (list_contains(terms, 'click') OR list_contains(terms, 'error')) AND NOT list_contains(terms, '89')
  UNION ALL SELECT 'any_term', id FROM v_terms WHERE list_contains(terms, 'signup') OR list_contains(terms, 'zebra')
  UNION ALL SELECT DISTINCT 'phrase', CAST(id AS VARCHAR) FROM (SELECT id, terms, unnest(range(1, len(terms))) AS i FROM d_terms) WHERE terms[i] = 'of' AND terms[i + 1] = 'the'
  UNION ALL SELECT 'prefix', CAST(id AS VARCHAR) FROM d_terms WHERE len(list_filter(terms, lambda t: starts_with(t, 'schach'))) > 0
  UNION ALL SELECT DISTINCT 'near', CAST(a.id AS VARCHAR) FROM (SELECT id, unnest(range(1, len(terms) + 1)) AS i, terms FROM d_terms) a
    JOIN (SELECT id, unnest(range(1, len(terms) + 1)) AS i, terms FROM d_terms) b ON a.id = b.id WHERE a.terms[a.i] = 'with' AND b.terms[b.i] = 'that' AND abs(a.i - b.i) <= 4""", V.EVENTS, TERMS, DOC_TERMS)
def index_search(spark, sf):
    """The searches of this catalogue on written indexes: each reads the buckets of its terms only."""
    events = V.events(spark, sf).where("content IS NOT NULL")
    docs = V.table(spark, sf, "documents").where("text IS NOT NULL")
    own = _index(spark, sf, events, "eid", ["content"], False, F.col("sequence") % 2 == 0)
    other = _index(spark, sf, docs, "doc_id", ["text"], False, F.col("doc_id") % 2 == 0)
    found = [
        ("and", own.find(S.all_of(S.term("view"), S.term("69")))), ("not", own.find(S.but_not(S.any_of(S.term("click"), S.term("error")), S.term("89")))), ("any_term", own.find_or(["signup", "zebra"]).select("id")),
        ("phrase", other.find(S.phrase("of the"))), ("prefix", other.find(S.prefix("schach"))), ("near", other.find(S.near(["with", "that"], 3))),
    ]
    out = None
    for name, hits in found:
        one = hits.select(F.lit(name).alias("search"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT q.item_id AS query_id, d.id, count(*) AS matched FROM (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark) q
  JOIN (SELECT DISTINCT id, unnest(terms) AS term FROM d_terms) d ON q.term = d.term
  GROUP BY q.item_id, d.id HAVING count(*) = (SELECT count(DISTINCT t) FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM benchmark) z WHERE z.item_id = q.item_id)""", DOC_TERMS)
def search_batch_all_terms(spark, sf):
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return S.search_batch(V.table(spark, sf, "documents"), "doc_id", "text", queries)


@query("SELECT doc_id, len(terms) AS n_tokens, len(list_distinct(terms)) AS n_terms FROM d_terms JOIN documents ON id = doc_id", DOC_TERMS)
def token_statistics(spark, sf):
    t = X.tokens(F.col("text"))
    return V.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query("""SELECT source_ref, location_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, profile_id, project_id, source_ref, location_id, line_no) AS rn FROM (
  SELECT *, round(CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w = 'with')) + len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w = 'from')) AS DOUBLE), 6) AS score
  FROM v_units WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'with'))) > 0
    AND len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'from'))) > 0)) WHERE rn <= 10""", V.UNITS)
def corpus_ranked_topk(spark, sf):
    return S.rank_corpus(V.units(spark, sf), "With from", 10).select("source_ref", "location_id", "score")


@query("SELECT source_ref, count(*) AS n FROM v_units WHERE project_id = 'de' AND profile_id = 'src3' GROUP BY source_ref", V.UNITS)
def corpus_metadata_only(spark, sf):
    return V.units(spark, sf).where("project_id = 'de' AND profile_id = 'src3'").groupBy("source_ref").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_ref, line_no, location_id, text FROM v_units", V.UNITS)
def units_from_lines(spark, sf):
    return V.units(spark, sf).select("source_ref", "line_no", "location_id", "text")


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g'))) AS text_sha256 FROM documents WHERE text IS NOT NULL")
def unit_normalize(spark, sf):
    return V.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("text_sha256"))


# JSON in ASCII: quotes and backslashes escaped, all else outside printable ASCII as UTF-16 units.
_UNIT16 = "'\\u' || lpad(lower(to_hex({})), 4, '0')"
_CHAR = ("CASE WHEN c = chr(34) THEN '\\' || chr(34) WHEN c = chr(92) THEN '\\\\' WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) = 8 THEN '\\b' WHEN unicode(c) < 65536 THEN "
         + _UNIT16.format("unicode(c)") + " ELSE " + _UNIT16.format("55296 + (unicode(c) - 65536) // 1024") + " || " + _UNIT16.format("56320 + (unicode(c) - 65536) % 1024") + " END")
ESCAPED = "j_units AS (SELECT location_id, source_ref, CASE WHEN regexp_matches(text, '[^ -~]') OR contains(text, chr(34)) OR contains(text, chr(92)) THEN (SELECT chr(34) || string_agg(" + _CHAR + ", '' ORDER BY i) || chr(34) FROM (SELECT i, substring(v_units.text, i, 1) AS c FROM range(1, length(v_units.text) + 1) r(i))) ELSE chr(34) || text || chr(34) END AS j FROM v_units)"


@query("SELECT location_id, 'u_' || left(sha256('{\"location_id\":\"' || location_id || '\",\"source_ref\":\"' || source_ref || '\"}'), 32) AS unit_id, 'c_' || left(sha256('{\"kind\":\"text\",\"text\":' || j || '}'), 32) AS content_hash FROM j_units", V.UNITS, ESCAPED)
def unit_content_hash(spark, sf):
    """Ids of all units, whatever characters they hold."""
    return C.identify_units(V.units(spark, sf)).select("location_id", "unit_id", "content_hash")


area.also("unit_content_hash_all", "unit_content_hash")


def _hashed_units(spark, sf):
    return V.units(spark, sf).select("source_ref", "location_id", "line_no", F.sha2("text", 256).alias("content_hash"))


DEDUP = "u_dedup AS (SELECT *, CASE WHEN first_value(location_id) OVER w <> location_id THEN first_value(location_id) OVER w END AS duplicate_of FROM v_units WINDOW w AS (PARTITION BY text, source_ref ORDER BY line_no))"


@query("SELECT location_id, duplicate_of FROM u_dedup", V.UNITS, DEDUP)
def unit_dedup(spark, sf):
    return C.dedup_units(_hashed_units(spark, sf)).select("location_id", "duplicate_of")


@query("SELECT sha256(text) AS content, count(DISTINCT source_ref) AS sources FROM v_units GROUP BY text HAVING count(DISTINCT source_ref) > 1", V.UNITS)
def cross_source_shared(spark, sf):
    units = V.units(spark, sf).withColumn("content", F.sha2("text", 256))
    return C.shared_content(units, "content")


@query("SELECT relation, count(*) AS n FROM (SELECT 'source_of' AS relation FROM u_dedup UNION ALL SELECT 'derived_from' FROM u_dedup WHERE duplicate_of IS NOT NULL) GROUP BY relation", V.UNITS, DEDUP)
def corpus_edge_counts(spark, sf):
    return C.corpus_edges(C.dedup_units(_hashed_units(spark, sf))).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT version_id, source_id, lag(version_id) OVER w AS supersedes, CASE WHEN lag(h) OVER w <> h THEN lag(h) OVER w END AS predecessor_content_hash
  FROM (SELECT source || '/' || lang AS source_id, sha256(source || '/' || lang || ':' || sha256(coalesce(text, ''))) AS version_id, sha256(coalesce(text, '')) AS h, min(doc_id) AS position FROM documents GROUP BY ALL)
  WINDOW w AS (PARTITION BY source_id ORDER BY position)""")
def source_versions_lag(spark, sf):
    body = F.sha2(F.coalesce("text", F.lit("")), 256)
    source = F.concat_ws("/", "source", "lang")
    records = V.table(spark, sf, "documents").select(source.alias("source_id"), F.sha2(F.concat(source, F.lit(":"), body), 256).alias("version_id"), body.alias("content_hash"), F.col("doc_id").alias("position"))
    return C.version_chain(records).select("version_id", "source_id", "supersedes", "predecessor_content_hash")


@query("SELECT source, max(doc_id) AS last_doc, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def latest_source_record(spark, sf):
    records = V.table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("position"), "lang")
    return C.latest_sources(records).select(F.col("source_id").alias("source"), F.col("position").alias("last_doc"), "lang")


STOP = "('" + "','".join(__import__("cairn.vocabulary", fromlist=["STOPWORDS"]).STOPWORDS) + "')"


@query(f"""SELECT doc_id, term, n, rank, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id), 9) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM (
    SELECT doc_id, term, count(*) AS n FROM (
      SELECT doc_id, kept[i] AS term FROM pos UNION ALL SELECT doc_id, kept[i] || ' ' || kept[i + 1] FROM pos WHERE i < len(kept)) GROUP BY doc_id, term)) WHERE rank <= 8""",
  f"kept AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_-]+'), lambda t: length(t) >= 3 AND t NOT IN {STOP}) AS kept FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)(api[_-]?key|api[_-]?secret|password|passwd|passphrase|client[_-]?secret|access[_-]?token|refresh[_-]?token)\\s*[:=]\\s*\\S+') AND NOT regexp_matches(text, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----') AND NOT regexp_matches(text, '(?i)^[a-z][a-z0-9+.-]*://[^/@:]+:[^/@]+@'))",
  "pos AS (SELECT doc_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM kept)")
def keyword_enrichment_top8(spark, sf):
    rows = C.keyword_enrichment(V.table(spark, sf, "documents"), "doc_id", "text")
    return rows.select(F.col("unit").alias("doc_id"), "term", "n", F.col("rank").cast("long").alias("rank"), F.round("weight", 9).alias("weight"))


RULE = "CASE WHEN regexp_matches(body, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----') THEN 'private_key_block' WHEN regexp_matches(body, '(?i)^\\s*Bearer\\s+\\S+\\s*$') THEN 'bearer_token' WHEN regexp_matches(body, '(?i)^[a-z][a-z0-9+.-]*://[^/@:]+:[^/@]+@') THEN 'credential_url_userinfo' WHEN regexp_matches(body, '(?i)(api[_-]?key|api[_-]?secret|password|passwd|passphrase|client[_-]?secret|access[_-]?token|refresh[_-]?token)\\s*[:=]\\s*\\S+') THEN 'api_key_assignment' END"


BODIES = "v_bodies AS (SELECT 'd' || doc_id AS item_id, text AS body FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"


@query(f"SELECT item_id, {RULE} AS rule, {RULE} IS NULL AS accepted FROM v_bodies", BODIES)
def secret_gate(spark, sf):
    """The whole text of every document and conversation turn."""
    return C.secret_gate(V.bodies(spark, sf), "body").select("item_id", "rule", "accepted")


@query(f"SELECT item_id, CASE WHEN {RULE} IS NOT NULL THEN '[REDACTED:' || {RULE} || ']' ELSE body END AS body FROM v_bodies", BODIES)
def redact_flat(spark, sf):
    return V.bodies(spark, sf).select("item_id", X.redact(F.col("body")).alias("body"))


for _name in ("secret_gate", "redact_flat"):
    area.also(f"{_name}_all", _name)


@query("SELECT doc_id, CASE WHEN length(text) < 500 THEN 'too_short' END AS reason FROM documents WHERE text IS NOT NULL")
def extraction_quality(spark, sf):
    return C.quality_gate(V.table(spark, sf, "documents").where("text IS NOT NULL")).select("doc_id", "reason")


@query("""SELECT vec_id, score FROM (SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS score
  FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)) ORDER BY score DESC, vec_id LIMIT 10""")
def semantic_fusion(spark, sf):
    vectors = V.table(spark, sf, "embeddings")
    asked = vectors.where("vec_id = 7").first()
    return C.semantic_rank(vectors, list(asked["embedding"]) if asked else [1.0])
