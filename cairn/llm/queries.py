"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm._common import read_table


def op3_token_counts(spark, sf_dir):
    from cairn.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark, sf_dir):
    from cairn.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op9_simhash_neardup(spark, sf_dir):
    from cairn.llm.simhash_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_line_dedup(spark, sf_dir):
    from cairn.llm.line_dedup import drop_repeated_lines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_decontamination(spark, sf_dir):
    from cairn.llm.decontam import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_language_id(spark, sf_dir):
    from cairn.llm.langid import identify, train

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op7_chat_format(spark, sf_dir):
    from cairn.llm.chat import digest, format_conversations

    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(control).alias("text")) for t, role in enumerate(("user", "assistant"))]
    planted = spark.range(1).select(F.inline(F.array(*own)))
    return digest(format_conversations(rows.unionByName(planted)))


def op8_html_extract(spark, sf_dir):
    from cairn.llm.html_extract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op5_ann(spark, sf_dir):
    from cairn.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_quality(spark, sf_dir):
    from cairn.llm.quality import score, train

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op11_edit_embedding(spark, sf_dir):
    from cairn.llm.edit_embedding import against_next

    return against_next(read_table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark, sf_dir):
    from cairn.llm.alignment import align

    return align(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    from cairn.llm.prefix_trie import ordered, prefix_trie, shared_heads

    return prefix_trie(*shared_heads(ordered(read_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op13_prefix_trie": op13_prefix_trie,
    "op11_edit_embedding": op11_edit_embedding,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op4_quality": op4_quality,
    "op5_ann": op5_ann,
    "op7_chat_format": op7_chat_format,
    "op8_html_extract": op8_html_extract,
    "op2_language_id": op2_language_id,
    "op10_decontamination": op10_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op3_token_counts": op3_token_counts,
}

OP6_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts[i] AS line, i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents))
), heavy AS (
  SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, h.key IS NOT NULL AND l.doc_id < h.largest AS gone FROM lines l LEFT JOIN heavy h ON l.key = h.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_matches(role || chr(10) || text, '\[/?INST\]|</?s>|<</?SYS>>') AS escaped FROM turns
), sized AS (
  SELECT *, length('[INST]=[/INST]</s>') + length(role) + length(text)
    + CASE WHEN escaped THEN length(role || text) - length(replace(role || text, chr(92), '')) + len(regexp_extract_all(role || chr(10) || text, '\[/?INST\]|</?s>|<</?SYS>>')) ELSE 0 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT s.conv_id, t.place, t.role, t.text FROM sums s JOIN turns t ON t.conv_id = s.base AND t.place <= s.h
  UNION ALL SELECT s.conv_id, t.place, t.role, t.text FROM sums s JOIN turns t ON t.conv_id = s.conv_id AND t.place > s.h
), paths AS (
  SELECT s.conv_id, list({'role': r.role, 'text': r.text} ORDER BY r.place) FILTER (WHERE r.place IS NOT NULL) AS path
  FROM sums s LEFT JOIN rebuilt r ON r.conv_id = s.conv_id GROUP BY s.conv_id
), members AS (
  SELECT conv_id, d AS depth, coalesce(len(path), 0) AS size, CASE WHEN d = 0 THEN '' ELSE sha256(CAST(path[1:d] AS JSON)) END AS node,
    CASE WHEN d = 1 THEN '' WHEN d > 1 THEN sha256(CAST(path[1:d-1] AS JSON)) END AS up,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT *, unnest(range(0, coalesce(len(path), 0) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, max(size) = depth AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), under AS (
  SELECT m.node AS top, m.depth AS top_depth, sum(n.saved) AS saved, count(*) FILTER (WHERE n.leaf) AS leaves
  FROM nodes n JOIN members o ON o.node = n.node AND o.depth = n.depth AND o.conv_id = n.conv_id JOIN members m ON m.conv_id = o.conv_id AND m.depth <= o.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM nodes c WHERE c.up = n.node AND c.depth = n.depth + 1) AS n_children,
  u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON u.top = n.node AND u.top_depth = n.depth LEFT JOIN nodes p ON p.node = n.up AND p.depth = n.depth - 1
"""

ORACLES: dict[str, str] = {
    "op13_prefix_trie": OP13_SQL,
    "op7_chat_format": OP7_SQL,
    "op6_line_dedup": OP6_SQL,
}
