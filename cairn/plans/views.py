"""Canonical shapes over the driver tables, in Spark and in DuckDB SQL.

Every column comes from integer arithmetic or plain text, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.timestamps import stamp
from cairn.sources.tables import read


table = read


def _kinds(c):
    return F.when(c == "click", "tool_observation").when(c == "view", "external_source").when(c == "purchase", "decision").when(c == "signup", "user_statement").otherwise("system_event")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(e.cast("string"), 9, "0")).alias("eid"),
        text("t", u).alias("trace_id"),
        stamp(F.col("ts")).alias("created_at"),
        e.alias("sequence"),
        _kinds(F.col("event_type")).alias("event_type"),
        F.when(u % 10 != 0, text("p", u % 8)).alias("profile_id"),
        text("j", u % 5).alias("project_id"),
        text("s", F.floor(e / 50)).alias("session_id"),
        F.when(e % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(text("k", e % 6), text("k", (e + 2) % 6))).alias("spaces"),
        F.when(e % 13 == 0, "deleted").when(e % 7 == 0, "superseded").when(e % 5 == 0, "conflicted").when(e % 3 == 0, "active").otherwise("observed").alias("lifecycle"),
        F.when(e % 4 == 0, "none").when(e % 4 == 1, "direct_tool_output").when(e % 4 == 2, "user_confirmation").otherwise("deterministic_verification").alias("verification"),
        F.when(e % 9 == 0, "private").when(e % 9 == 1, "secret").when(e % 2 == 0, "internal").otherwise("public").alias("sensitivity"),
        F.concat_ws(" ", "event_type", "props", F.col("value").cast("decimal(18,2)").cast("string")).alias("content"),
    )


EVENTS = """
v_events AS (
  SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS eid, 't' || user_id AS trace_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, event_id AS sequence,
    CASE event_type WHEN 'click' THEN 'tool_observation' WHEN 'view' THEN 'external_source' WHEN 'purchase' THEN 'decision'
      WHEN 'signup' THEN 'user_statement' ELSE 'system_event' END AS event_type,
    CASE WHEN user_id % 10 <> 0 THEN 'p' || (user_id % 8) END AS profile_id, 'j' || (user_id % 5) AS project_id,
    's' || CAST(floor(event_id / 50) AS BIGINT) AS session_id,
    CASE WHEN event_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['k' || (event_id % 6), 'k' || ((event_id + 2) % 6)] END AS spaces,
    CASE WHEN event_id % 13 = 0 THEN 'deleted' WHEN event_id % 7 = 0 THEN 'superseded' WHEN event_id % 5 = 0 THEN 'conflicted'
      WHEN event_id % 3 = 0 THEN 'active' ELSE 'observed' END AS lifecycle,
    CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'direct_tool_output' WHEN 2 THEN 'user_confirmation' ELSE 'deterministic_verification' END AS verification,
    CASE WHEN event_id % 9 = 0 THEN 'private' WHEN event_id % 9 = 1 THEN 'secret' WHEN event_id % 2 = 0 THEN 'internal' ELSE 'public' END AS sensitivity,
    event_type || ' ' || props || ' ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS content
  FROM events)
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as corpus units, blank lines left out but counted."""
    from cairn.sources.text_units import units_of_text

    docs = table(spark, sf_dir, "documents")
    return units_of_text(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_ref"), F.col("source").alias("profile_id"), F.col("lang").alias("project_id"), "text"))


UNITS = """
v_units AS (
  SELECT source_ref, profile_id, project_id, CAST(i AS INTEGER) AS line_no, source_ref || '#L' || i AS location_id, parts[i] AS raw_text,
    trim(regexp_replace(parts[i], '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) AS text
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT 'd' || doc_id AS source_ref, source AS profile_id, lang AS project_id,
                regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]') AS parts FROM documents WHERE text IS NOT NULL))
  WHERE trim(regexp_replace(parts[i], '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) <> '')
"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document and conversation turn, with the number of either."""
    text = lambda prefix, *c: F.concat(F.lit(prefix), *c).alias("item_id")
    docs = table(spark, sf_dir, "documents").select(text("d", F.col("doc_id").cast("string")), F.col("doc_id").cast("long").alias("number"), F.col("text").alias("body"))
    turns = table(spark, sf_dir, "conversations").select(text("c", F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")), F.col("conv_id").cast("long").alias("number"), F.col("text").alias("body"))
    return docs.unionByName(turns)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision operations: a customer's first order creates, later ones supersede."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.concat(F.lit("d"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("decision_id"),
        F.col("o_custkey").alias("decision_key"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project_id"),
        stamp(F.col("o_orderdate")).alias("effective_at"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "candidate").otherwise("conflicted").alias("status"),
        F.col("o_orderpriority").alias("statement"),
    )


DECISIONS = """
v_decisions AS (
  SELECT 'd' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS decision_id, o_custkey AS decision_key, 'n' || c_nationkey AS project_id,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS effective_at,
    CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'candidate' ELSE 'conflicted' END AS status, o_orderpriority AS statement
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verification for each order line, the smallest of repeated lines."""
    from cairn.operators.relational import first_by

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag", stamp(F.col("l_shipdate")).alias("shipped"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    one = first_by(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "shipped", "price", "l_quantity", "l_linestatus", "l_returnflag"])
    status = F.when(F.col("l_linestatus") == "F", "deterministic_verification").when(F.col("l_returnflag") == "R", "user_confirmation").otherwise("none")
    return one.select(
        F.concat(F.lit("v"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("verification_id"),
        F.col("l_partkey").alias("subject_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_suppkey").alias("supplier_key"),
        F.col("shipped").alias("timestamp"),
        F.col("l_quantity").cast("long").alias("quantity"),
        status.alias("verification_status"),
    )


VERIFICATIONS = """
v_verifications AS (
  SELECT 'v' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber AS verification_id, l_partkey AS subject_id, l_orderkey AS order_key,
    l_suppkey AS supplier_key, shipped AS timestamp, CAST(l_quantity AS BIGINT) AS quantity,
    CASE WHEN l_linestatus = 'F' THEN 'deterministic_verification' WHEN l_returnflag = 'R' THEN 'user_confirmation' ELSE 'none' END AS verification_status
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, shipped, price, l_quantity, l_linestatus, l_returnflag) AS rn
        FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS shipped, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem))
  WHERE rn = 1)
"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grant events: created, some revoked, some superseded by their successor."""
    s = F.col("s_suppkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("g"), F.lpad(s.cast("string"), 6, "0")).alias("grant_id"),
        text("p", s % 8).alias("subject_profile"),
        F.when(s % 3 == 0, "WRITE").otherwise("READ").alias("operation"),
        F.when(s % 4 == 0, "profile").when(s % 4 == 1, "project").when(s % 4 == 2, "knowledge_space").otherwise("global").alias("target_type"),
        F.when(s % 4 == 0, text("p", (s + 3) % 8)).when(s % 4 == 1, text("j", s % 5)).when(s % 4 == 2, text("k", s % 6)).otherwise(F.lit("*")).alias("target_id"),
        F.when(s % 5 == 0, '["event","decision"]').when(s % 5 == 1, '["decision"]').alias("resource_types"),
        F.when(s % 9 == 0, "revoked").when(s % 2 == 0, "enabled").alias("state"),
        F.when(s % 7 == 0, "superseded").otherwise("active").alias("lifecycle_status"),
        F.when((s % 7 == 1) & (s > 0), F.concat(F.lit("g"), F.lpad((s - 1).cast("string"), 6, "0"))).alias("supersedes"),
        F.when(s % 6 == 0, F.lit(None)).otherwise(text("r", s % 10)).alias("verification_ref"),
    )


GRANTS = """
v_grants AS (
  SELECT 'g' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS grant_id, 'p' || (s_suppkey % 8) AS subject_profile,
    CASE WHEN s_suppkey % 3 = 0 THEN 'WRITE' ELSE 'READ' END AS operation,
    CASE s_suppkey % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'project' WHEN 2 THEN 'knowledge_space' ELSE 'global' END AS target_type,
    CASE s_suppkey % 4 WHEN 0 THEN 'p' || ((s_suppkey + 3) % 8) WHEN 1 THEN 'j' || (s_suppkey % 5) WHEN 2 THEN 'k' || (s_suppkey % 6) ELSE '*' END AS target_id,
    CASE s_suppkey % 5 WHEN 0 THEN '["event","decision"]' WHEN 1 THEN '["decision"]' END AS resource_types,
    CASE WHEN s_suppkey % 9 = 0 THEN 'revoked' WHEN s_suppkey % 2 = 0 THEN 'enabled' END AS state,
    CASE WHEN s_suppkey % 7 = 0 THEN 'superseded' ELSE 'active' END AS lifecycle_status,
    CASE WHEN s_suppkey % 7 = 1 AND s_suppkey > 0 THEN 'g' || lpad(CAST(s_suppkey - 1 AS VARCHAR), 6, '0') END AS supersedes,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'r' || (s_suppkey % 10) END AS verification_ref
  FROM supplier)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access requests of every shape that the policy tells apart."""
    c = F.col("c_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    none = F.array().cast("array<string>")
    own = text("p", c % 8)
    return table(spark, sf_dir, "customer").select(
        c.alias("request_id"),
        F.when(c % 3 == 1, "WRITE").otherwise("READ").alias("operation"),
        F.when(c % 7 != 0, own).alias("requester"),
        F.when(c % 4 == 0, none).when(c % 4 == 3, F.array(text("p", (c + 1) % 8))).otherwise(F.array(own)).alias("profiles"),
        F.when(c % 5 < 2, F.array(text("j", c % 5))).otherwise(none).alias("projects"),
        F.when(c % 6 == 0, F.array(text("k", c % 6))).otherwise(none).alias("spaces"),
        (c % 2 == 0).alias("include_global"),
        (c % 11 < 3).alias("isolated"),
    )


REQUESTS = """
v_requests AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 1 THEN 'WRITE' ELSE 'READ' END AS operation,
    CASE WHEN c_custkey % 7 <> 0 THEN 'p' || (c_custkey % 8) END AS requester,
    CASE c_custkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 3 THEN ['p' || ((c_custkey + 1) % 8)] ELSE ['p' || (c_custkey % 8)] END AS profiles,
    CASE WHEN c_custkey % 5 < 2 THEN ['j' || (c_custkey % 5)] ELSE CAST([] AS VARCHAR[]) END AS projects,
    CASE WHEN c_custkey % 6 = 0 THEN ['k' || (c_custkey % 6)] ELSE CAST([] AS VARCHAR[]) END AS spaces,
    c_custkey % 2 = 0 AS include_global, c_custkey % 11 < 3 AS isolated
  FROM customer)
"""


def sql(body: str, *ctes: str) -> str:
    """An oracle statement over the named views."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip() if ctes else body.strip()
