"""Boundary cases, sequential models and metamorphic checks of the operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn import cursor as K
from cairn.engine import Denied, Engine
from cairn.functions import identity, timestamps
from cairn.functions import text as X
from cairn.operators import access as A
from cairn.operators import corpus as C
from cairn.operators import events as E
from cairn.operators import evidence as D
from cairn.operators import graph as G
from cairn.operators import ingest as N
from cairn.operators import records as R
from cairn.operators import search as S
from cairn.operators import temporal as T
from cairn.operators.relational import table_digest
from cairn.plans import views as V
from cairn.sources import files, hooks, jsonl
from cairn.sources.text_units import units_of_text
from cairn.streaming import projection as P


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


# ----------------------------------------------------------------------- ingest


def _sequential(lines):
    by_id, by_hash, out = {}, {}, {}
    for p, i, h in sorted(lines):
        if i in by_id:
            out[p] = "duplicate_event_id" if by_id[i] == h else "event_id_content_conflict"
        elif h in by_hash:
            out[p] = "duplicate_content_hash"
        else:
            by_id[i], by_hash[h], out[p] = h, i, "new_event"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_match_a_sequential_log(spark, seed):
    rng = random.Random(seed)
    lines = [(p, f"i{rng.randint(0, 25)}", f"h{rng.randint(0, 25)}") for p in range(80)]
    df = spark.createDataFrame(lines, "position long, event_id string, content_hash string").repartition(5)
    assert {r["position"]: r["outcome"] for r in N.outcomes(df).collect()} == _sequential(lines)


def test_child_of_takes_the_first_known_parent(spark):
    ev = spark.createDataFrame([("a", "t1", 1, None), ("b", "t2", 2, "t1"), ("c", "t1", 3, "t2"), ("d", "t3", 0, "t1"), ("e", "t1", 5, "t1")], "eid string, trace_id string, sequence long, parent_trace_id string")
    assert rows(N.child_of(ev), "from_id", "to_id") == [("b", "a"), ("c", "b"), ("e", "a")]


def test_replay_grammar(spark):
    ops = [
        ("k", 1, "create", "a", "active", "s1", None),
        ("k", 2, "create", "a", "active", "s1", None),
        ("k", 3, "create", "b", "active", "s2", None),
        ("k", 4, "supersede", "c", "active", "s3", "a"),
        ("k", 5, "transition", "c", "conflicted", None, None),
        ("k", 6, "delete", "c", None, None, None),
        ("k", 7, "transition", "c", "active", None, None),
        ("k", 8, "supersede", "x", "active", "s", "nowhere"),
    ]
    got = {r["position"]: r for r in R.replay_decisions(spark.createDataFrame(ops, "key string, position long, op string, decision_id string, lifecycle_status string, statement string, supersedes_id string")).collect()}
    assert [got[i]["outcome"] for i in range(1, 9)] == ["created", "noop", "conflict", "superseded", "transitioned", "deleted", "rejected", "rejected"]
    assert (got[1]["lifecycle_status"], got[1]["replaced_by"]) == ("superseded", "c") and (got[6]["lifecycle_status"], got[6]["statement"]) == ("deleted", "s3")


def test_log_lines_keep_their_faults(spark, tmp_path):
    good = {"event_id": "e1", "trace_id": "t", "source": "hook", "event_type": "decision", "schema_version": 1, "created_at": "2024-01-01T00:00:00Z", "observed_at": "2024-01-01T00:00:00Z", "sequence": 0, "lifecycle_status": "active", "verification_status": "none", "confidence": "low", "sensitivity": "public", "retention": "session", "sanitized_content_hash": "h", "knowledge_space_id": "k1"}
    bad = [{**good, "event_type": "assistant_claim"}, {**good, "created_at": "2024-01-01"}, {k: v for k, v in good.items() if k != "source"}, {**good, "knowledge_space_ids": ["a", "a"]}]
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", *map(json.dumps, bad)]) + "\n")
    log = jsonl.read_log(spark, str(tmp_path))
    assert sorted(map(str, (r["fault"] for r in log.collect()))) == sorted(["None", "malformed_json", "claim_active", "time:created_at", "missing_field:source", "knowledge_spaces"])
    assert [r["spaces"] for r in jsonl.as_events(log).collect()] == [["k1"]]
    with pytest.raises(ValueError, match="malformed_json in .* line 3"):
        jsonl.strict(log)


def test_log_faults_of_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\n{"event_id": "\xff"}\n[1]\n{"event_id": "x"}\r\n{"event_id": ')
    (tmp_path / "b.jsonl").write_bytes(b'{"event_id": "x"}\n{"event_id": ')
    (tmp_path / "c.jsonl").write_bytes(b'{"event_id": \n{"event_id": "x"}')
    got = {(r["file"][-7:], r["line_no"]): r["fault"] for r in jsonl.read_log(spark, str(tmp_path)).collect()}
    missing = "missing_field:trace_id"
    assert got == {("a.jsonl", 2): "invalid_utf8", ("a.jsonl", 3): "invalid_top_level", ("a.jsonl", 4): missing, ("a.jsonl", 5): "truncated_line", ("b.jsonl", 1): missing, ("b.jsonl", 2): "truncated_line", ("c.jsonl", 1): "malformed_json", ("c.jsonl", 2): missing}
    (tmp_path / "d.jsonl").write_text("\n".join(f'{{"event_id": "{i}"}}' for i in range(3_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4_096)
    try:
        rows_ = jsonl.numbered_lines(spark, str(tmp_path / "d.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line_no"], json.loads(r["line"])["event_id"]) for r in rows_) == [(i + 1, str(i)) for i in range(3_000)]


@pytest.mark.parametrize("seed", range(3))
def test_append_receipts_match_a_sequential_log(spark, seed):
    import random

    rng = random.Random(seed)
    log = [(f"e{i}", f"h{i}", i) for i in range(5)]
    batch = [(f"e{rng.randrange(12)}", f"h{rng.randrange(12)}", p, rng.choice(["public", "public", "public", "secret"]), "session", rng.choice(["{}", "{}", None])) for p in range(40)]
    by_id, by_hash, following, want = {i: s for i, _, s in log}, {h: s for _, h, s in log}, 5, []
    for i, h, p, sensitivity, _, audit in batch:
        if sensitivity == "secret" or audit is None:
            want.append((p, "rejected", "never_store_policy" if sensitivity == "secret" else "missing_redaction_audit", None))
        elif i in by_id or h in by_hash:
            want.append((p, "duplicate", "event_id" if i in by_id else "content_hash", by_id.get(i, by_hash.get(h))))
        else:
            by_id[i] = by_hash[h] = following
            want.append((p, "appended", None, following))
            following += 1
    got = N.append_receipts(spark.createDataFrame(log, "eid string, content_hash string, sequence long"), spark.createDataFrame(batch, "eid string, content_hash string, position long, sensitivity string, retention string, redaction_audit string"))
    assert sorted((r["position"], r["outcome"], r["basis"], r["sequence"]) for r in got.collect()) == want


def test_structured_redaction(spark):
    from cairn.functions.redaction import redact_json

    payloads = [
        ('{"a": "x", "Authorization": "Basic abc", "n": {"password": "p", "list": ["Bearer t", 3, null, "api_key = z"]}}', ["api_key_assignment", "authorization_header", "bearer_token", "password_assignment"], ["payload.Authorization", "payload.n.list[0]", "payload.n.list[3]", "payload.n.password"], None),
        ('{"authorization": "Bearer t"}', ["bearer_authorization"], ["payload.authorization"], None),
        ('"-----BEGIN RSA PRIVATE KEY----- x -----END RSA PRIVATE KEY-----"', ["private_key_block"], ["payload"], None),
        ('{"k": "-----BEGIN RSA PRIVATE KEY----- x"}', [], [], "malformed_private_key"), ("{oops", [], [], "unsafe_input"), ("[1, true]", [], [], None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(payloads)], "i long, p string").select("i", redact_json(F.col("p")).alias("r")).orderBy("i")
    got = [r["r"] for r in df.collect()]
    assert [(g["rules"], g["paths"], g["rejected"]) for g in got] == [p[1:] for p in payloads]
    assert json.loads(got[0]["content"])["n"]["list"] == ["[REDACTED:bearer_token]", 3, None, "[REDACTED:api_key_assignment]"] and got[5]["content"] == "[1,true]"


def test_strict_operations(spark):
    from cairn.operators import records as R

    block = [("e1", '{"domain":"charter","identity":"c","project_id":"j","op":"create"}'), ("e2", None), ("e3", '{"domain":"other"}'), ("e4", '{"domain":"state","state_key":"k","project_id":"j","op":"create"}')]
    extra = ("t", "s", "p", "2024", 1, "decision")
    kind = "eid string, record string, trace_id string, session_id string, profile_id string, created_at string, sequence long, event_type string"
    ops = R.operations(spark.createDataFrame([(*b, *extra) for b in block], kind))
    assert [(r["kind"], r["identity"]) for r in R.strict_operations(ops).orderBy("source_event_id").collect()] == [("charter", "c"), ("state", "k")]
    with pytest.raises(ValueError, match="invalid_record in e5"):
        R.strict_operations(R.operations(spark.createDataFrame([("e5", '{"domain":"charter","op":"create"}', *extra)], kind)))


def test_secured_reads_of_the_engine(spark, sf):
    ev = V.events(spark, sf)
    e = Engine(ev)
    ask = A.Request("READ", "p3", ("p3",))
    owners = ev.select(F.lit("event").alias("resource_type"), F.col("eid").alias("resource_id"), "profile_id", "project_id", "spaces")
    facts = ev.select(F.lit("event").alias("resource_type"), F.col("eid").alias("resource_id"), "created_at", *[F.lit(None).cast("string").alias(c) for c in ("effective_at", "valid_from", "valid_until")])
    mine = {r["eid"] for r in ev.where("profile_id = 'p3'").collect()}
    assert {r["resource_id"] for r in e.facts(ask, facts, owners, "transaction", "2100").collect()} == mine
    page = e.records(ask, ev, "event", ["eid"], 10, project_id="j3").collect()
    assert page and all(r["eid"] in mine and r["project_id"] == "j3" for r in page)
    relations = N.derived_from(ev.withColumn("relation_ids", F.array(F.concat(F.lit("e"), F.lpad((F.col("sequence") + 1).cast("string"), 9, "0")))))
    some = next(iter(sorted(mine)))
    assert all(r["from_id"] in mine and r["to_id"] in mine for r in e.related(ask, relations, some).collect())
    units = spark.createDataFrame([("p3", None, "s", "s#L1", 1, "word one"), ("p4", None, "s", "s#L2", 2, "word two"), (None, None, "s", "s#L3", 3, "word three")], "profile_id string, project_id string, source_ref string, location_id string, line_no int, text string")
    assert [r["location_id"] for r in e.corpus(ask, units, "word").collect()] == ["s#L1"] and e.corpus(ask, units, limit=-1).count() == 1
    with pytest.raises(S.QueryError):
        e.corpus(ask, units, "word", {"colour": "red"})
    with pytest.raises(Exception, match="outside its scope"):
        A.validated(ev, e.scopes(ask, "event")).collect()


# ----------------------------------------------------------------------- access


def test_policy_column_agrees_with_the_function(spark, sf):
    df = A.decide(V.requests(spark, sf)).collect()
    for r in df:
        q = A.Request(r["operation"], r["requester"], tuple(r["profiles"]), tuple(r["projects"]), tuple(r["spaces"]), r["include_global"], r["isolated"])
        assert A.evaluate(q)[0] == r["allow"], r


def test_hidden_rows_change_nothing(spark, sf):
    ev = V.events(spark, sf)
    scopes = [A.Scope(profiles=("p3",)), A.Scope(spaces=("k2",), is_grant=True)]
    hidden = ev.where(F.col("profile_id") == "p1").withColumns({"spaces": F.array(F.lit("k9")), "eid": F.concat(F.lit("a"), "eid"), "profile_id": F.lit("p99"), "created_at": F.lit("2000-01-01")})
    before = E.query(ev, 20, secured=A.any_of(scopes)).collect()
    assert E.query(ev.unionByName(hidden), 20, secured=A.any_of(scopes)).collect() == before
    edges = spark.createDataFrame([("e1", "a", "r", "b"), ("e2", "b", "r", "c"), ("e0", "a", "q", "hidden")], "edge_id string, from_id string, relation string, to_id string")
    allowed = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(G.neighbourhood(edges, seed, allowed, fan_out=1)) == [("a", 0), ("b", 1), ("c", 2)]


def test_grants_compose(spark):
    ask = A.Request("READ", "p1", ("p2",))
    grant = {"grant_id": "g", "subject_profile": "p1", "operation": "READ", "target_type": "profile", "target_id": "p2"}
    assert A.compose(ask, [])[0] is False and A.compose(ask, [grant])[0] is True
    assert A.compose(A.Request("READ", "p1", ("p2", "p3")), [grant])[0] is False
    assert A.compose(A.Request("READ", "p1", (), (), ("k1",)), [{**grant, "target_type": "knowledge_space", "target_id": "k2"}])[0] is True


def test_engine_pages_and_denies(spark, sf):
    e, ask = Engine(V.events(spark, sf)), A.Request("READ", "p3", ("p3",))
    first = e.query_events(ask, 10).collect()
    token = e.next_cursor(ask, first, 10)
    second = e.query_events(ask, 10, token).collect()
    both = [r["eid"] for r in [*first, *second]]
    assert both == [r["eid"] for r in e.query_events(ask, 20).collect()] and len(set(both)) == 20
    with pytest.raises(K.CursorError):
        e.query_events(ask, 11, token)
    with pytest.raises(Denied):
        e.query_events(A.Request("READ", "p3", ("p4",)))
    assert {r["profile_id"] for r in e.search(ask, "click OR view").collect()} == {"p3"}


@pytest.mark.parametrize("limit", [0, 501, True, "5"])
def test_limits_are_not_clamped(limit):
    with pytest.raises(ValueError):
        K.check_limit(limit)


# ------------------------------------------------------------- search and corpus


@pytest.mark.parametrize("text", ["", " - ", '"*()'])
def test_conditions_need_a_word(text):
    for make in (S.term, S.prefix, S.phrase, lambda t: S.near([t])):
        with pytest.raises(S.QueryError):
            make(text)


def test_search_forms(spark):
    docs = spark.createDataFrame([(1, "The quick-brown fox", "x"), (2, "brown quick dogs", "fox"), (3, "foxes run", None), (4, None, None), (5, "", ""), (6, "Café ÉTÉ", "")], "id long, t string, u string")
    hit = lambda c, *columns: [r["id"] for r in S.find(docs, "id", list(columns or ("t",)), c).orderBy("id").collect()]
    t = S.term
    assert hit(S.all_of(t("quick"), t("brown"))) == [1, 2] and hit(S.phrase("quick brown")) == hit(t("quick-brown")) == [1] and hit(S.prefix("fox")) == [1, 3]
    assert hit(S.any_of(t("fox"), t("dogs"))) == [1, 2] and hit(S.but_not(t("brown"), t("fox"))) == [2] and hit(S.all_of(S.any_of(t("fox"), t("run")), t("the"))) == [1]
    assert hit(S.near(["the", "fox"], 2)) == [1] and hit(S.near(["the", "fox"], 1)) == [] and hit(S.near(["fox", "the quick"], 1)) == [1]
    assert hit(t("fox"), "t", "u") == [1, 2] and hit(t("fox", "u"), "t", "u") == [2] and hit(t("brown", first=True)) == [2] and hit(S.prefix("qui bro")) == []
    assert hit(S.all_of(t("cafe"), t("ete"))) == [6]
    with pytest.raises(S.QueryError):
        hit(t("fox", "nowhere"))
    fallback = lambda text: rows(S.with_fallback(docs, "id", ["t"], text), "id", "match_mode")
    assert fallback("fox cat") == [(1, "any_term")] and fallback("quick-brown") == [(1, "strict"), (2, "strict")] and fallback("run") == [(3, "strict")]


def test_searches_are_one_scan(spark, sf, capsys):
    from cairn.plans import corpus_queries as Q

    Q.fts_and(spark, sf).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Generate" not in plan


def test_batches_of_queries(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a a d"), (4, None)], "id long, t string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c a"), (3, "zz a"), (4, ""), (5, "a")], "query_id long, text string")
    assert rows(S.search_batch(docs, "id", "t", asked), "query_id", "id", "matched") == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (5, 1, 1), (5, 2, 1), (5, 3, 1)]
    assert (3, 3, 1) in rows(S.search_batch(docs, "id", "t", asked, "any"), "query_id", "id", "matched")


def test_corpus_query_words():
    assert S.corpus_words('Walk-forward "test" (x) -') == ["walkforward", "test", "x"]


def test_text_rules(spark):
    df = spark.createDataFrame([(" a \tb\x1c c ", "Café", "a\r\nb\x85c\n", '["x"," y","x"]', " p , q,,p")], "s string, n string, l string, j string, c string")
    r = df.select(X.collapse(F.col("s")).alias("s"), X.normalize_text(F.col("n")).alias("n"), X.lines(F.col("l")).alias("l"), X.link_list(F.col("j")).alias("j"), X.link_list(F.col("c")).alias("c"), X.estimate_tokens(F.lit("abc")).alias("t"), X.strip_accents(F.col("n")).alias("a")).first()
    assert (r["s"], r["n"], r["l"], r["j"], r["c"], r["t"], r["a"]) == ("a b c", "Café", ["a", "b", "c"], ["x", "y"], ["p", "q"], 1, "Cafe")


def test_units_dedup_and_order_independence(spark):
    src = spark.createDataFrame([("s1", "one\n\n one \ntwo"), ("s2", "two\n"), ("s3", None)], "source_ref string, text string")
    got = rows(C.dedup_units(units_of_text(src), content="text"), "location_id", "duplicate_of")
    assert got == [("s1#L1", None), ("s1#L3", "s1#L1"), ("s1#L4", None), ("s2#L1", None)]
    assert rows(C.dedup_units(units_of_text(src.orderBy(F.desc("source_ref")).repartition(3)), content="text"), "location_id", "duplicate_of") == got
    assert rows(C.shared_content(units_of_text(src), "text")) == [("two", 2)]


def test_identities_are_canonical(spark):
    import hashlib

    df = spark.createDataFrame([('say "hi" \\ é', "text")], "t string, k string")
    want = json.dumps({"text": 'say "hi" \\ é', "kind": "text"}, sort_keys=True, separators=(",", ":"))
    r = df.select(identity.canonical_object({"text": F.col("t"), "kind": F.col("k")}).alias("j"), identity.content_id(F.col("t"), F.col("k")).alias("i")).first()
    assert r["j"] == want and r["i"] == "c_" + hashlib.sha256(want.encode()).hexdigest()[:32]


def test_secret_rules(spark):
    texts = ["Bearer abc", "say Bearer abc now", "password: x", "https://a:b@h", "-----BEGIN EC PRIVATE KEY-----", "clean", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.secret_rule(F.col("t"))).collect()]
    assert got == ["bearer_token", None, "api_key_assignment", "credential_url_userinfo", "private_key_block", None, None]


# --------------------------------------------------------------- time and scores


def test_time_boundaries(spark):
    facts = [("p", None, "2024-01-02", None, None), ("lo", None, None, None, "2024-01-02"), ("in", None, None, "2024-01-01", "2024-01-03"), ("end", None, None, "2024-01-01", "2024-01-02"), ("none", "2024-01-01", None, None, None)]
    df = spark.createDataFrame(facts, "id string, created_at string, effective_at string, valid_from string, valid_until string")
    assert rows(df.where(T.as_of("valid", "2024-01-02")), "id") == [("in",), ("p",)]
    assert rows(df.where(T.as_of("transaction", "2024-01-01")), "id") == [("none",)]
    assert rows(df.where(T.within("valid", "2024-01-01", "2024-01-02")), "id") == [("end",), ("in",)]


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00.5+02:00",), ("2024-01-01T00:00:00",), ("junk",)], "t string")
    got = [r[0] for r in df.select(timestamps.iso_text(timestamps.instant(F.col("t")))).collect()]
    assert got == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.500000+00:00", None, None]


def test_budget_keeps_the_first_item_and_a_prefix(spark):
    items = [("g", f"i{n}", "primary", n, c) for n, c in enumerate([50, 10, 10])] + [("g", f"s{n}", "supporting", n, 5) for n in range(3)]
    df = spark.createDataFrame(items, "g string, eid string, role string, n long, c long")
    assert rows(D.select_evidence(df, ["g"], ["n"], F.col("c"), budget=40), "eid") == [("i0",), ("s0",)]
    assert rows(D.select_evidence(df, ["g"], ["n"], F.col("c"), budget=65), "eid") == [("i0",), ("i1",), ("s0",)]  # 5 are left


def test_scores_multiply_in_order(spark):
    base = ("decision", "none", "exact", "complete", "valid", "active", False, None, None)
    cases = [base, (*base[:5], "conflicted", False, 1, 0.5), ("unknown", "approval", *base[2:]), (*base[:2], "unauthorized", *base[3:]), (*base[:7], 3, None)]
    df = spark.createDataFrame(cases, "memory_type string, verification string, scope_match string, provenance_class string, temporal_validity string, lifecycle string, has_conflict boolean, relation_distance int, retrieval_relevance double")
    got = [(r["excluded"], r["score"] and round(r["score"], 6)) for r in D.calibrate(df).collect()]
    assert got == [(None, 0.9), (None, 0.2025), (None, 1.0), ("excluded_unauthorized_scope", None), ("excluded_relation_beyond_bounds", None)]


# ------------------------------------------------------------ sources and stream


def test_files_and_hooks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café\n".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9\n")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    assert rows(files.inventory(spark, str(tmp_path)), "name", "kind") == [("a.txt", "txt"), ("b.txt", "txt"), ("c.pdf", "pdf")]
    assert [r["text"] for r in files.text_sources(spark, str(tmp_path)).collect()] == ["café\n"] * 2
    assert {r["status"] for r in files.pdf_units(spark, str(tmp_path)).collect()} <= {"parser_unavailable", "corrupt_source"}
    calls = [("post_tool_call", "c1", None), ("gossip", "2", None), ("kanban_task_claimed", None, None), ("pre_llm_call", None, "own")]
    mapped = hooks.map_hooks(spark.createDataFrame(calls, "hook string, tool_call_id string, event_id string")).collect()
    assert mapped[0]["event_type"] == "tool_observation" and mapped[0]["mapped_event_id"].startswith("observed:post_tool_call:")
    assert mapped[1]["status"] == "deferred" and mapped[1]["mapped_event_id"] is None
    assert mapped[2]["mapped_event_id"].startswith("generated:kanban_task_claimed:") and mapped[3]["mapped_event_id"] == "own"


def test_stream_equals_batch(spark, sf, tmp_path):
    ev = V.events(spark, sf)
    for k in range(3):
        ev.where(F.col("sequence") % 3 == k).unionByName(ev.where((F.col("sequence") % 3 == 0) & (F.col("sequence") % 7 == 0))).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    P.start(spark, source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    columns = ["eid", "content_hash", "lifecycle"]
    assert table_digest(out, columns).collect() == table_digest(P.project(ev), columns).collect()
    assert P.freshness(ev, out).first()["state"] == "CURRENT" and P.admit("PENDING", "allow_stale") and not P.admit("PENDING", "require_current")


def test_scope_and_filters_reach_the_scan(spark, sf, tmp_path, capsys):
    V.events(spark, sf).write.parquet(str(tmp_path / "events"))
    ev = spark.read.parquet(str(tmp_path / "events"))
    E.query(ev, 20, secured=A.Scope(profiles=("p3",)).predicate(), event_type="decision", created_from="2024-01-02").select("eid").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(event_type,decision)" in plan and "GreaterThanOrEqual(created_at,2024-01-02)" in plan and "profile_id" in plan
    assert "content" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_charters_read_every_decision(spark, sf):
    from cairn import catalogue

    every = V.decisions(spark, sf)
    got = catalogue.QUERIES["charter_versions_all"](spark, sf)
    assert got.count() == every.count() and got.where("lifecycle_status = 'active'").count() == every.select("project_id").distinct().count()
    assert catalogue.QUERIES["charters_replayed"](spark, sf).count() == every.count()


def test_charter_grammar(spark):
    ops = [
        ("create", "a", None, "active", "x", "created"), ("create", "a", None, "active", "x", "noop"), ("create", "a", None, "active", "y", "rejected"), ("create", "b", None, "active", "x", "conflict"),
        ("update", "a", None, "active", "y", "versioned"), ("update", "c", None, "active", "y", "rejected"), ("supersede", "b", "z", "active", "x", "rejected"), ("supersede", "b", "a", "active", "x", "versioned"),
        ("supersede", "b", "a", "active", "x", "noop"), ("transition", "a", None, "active", None, "conflict"), ("delete", "b", None, "deleted", None, "deleted"), ("transition", "b", None, "active", None, "rejected"),
        ("transition", "a", None, "active", None, "transitioned"), ("merge", "a", None, "active", None, "rejected"),
    ]
    log = [(p, i, op, c, old, None, status, None, content) for p in ("p", "q", None) for i, (op, c, old, status, content, _) in enumerate(ops)]
    df = spark.createDataFrame(log, "project_id string, position long, op string, charter_id string, supersedes string, version long, lifecycle_status string, state string, content string")
    for p in ("p", "q", None):
        got = R.replay_charters(df).where(F.col("project_id").eqNullSafe(p)).orderBy("position").collect()
        assert [r["outcome"] for r in got] == [o[-1] for o in ops]
        assert (got[-1]["version"], got[-1]["lifecycle_status"], got[-1]["content"]) == (2, "active", "y")


def test_unit_ids_of_all_units(spark, tmp_path):
    import hashlib

    from cairn import catalogue

    lines = ["plain words", 'quote " and \\ slash', "Éß 中文 🙂", "soft\u00adhyphen \u0007 bell", "last"]
    spark.createDataFrame([(1, "\n".join(lines), "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["location_id"]: (r["unit_id"], r["content_hash"]) for r in catalogue.QUERIES["unit_content_hash_all"](spark, str(tmp_path)).collect()}
    short = lambda prefix, fields: prefix + hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
    at = [f"d1#L{i}" for i in range(1, len(lines) + 1)]
    assert got == {a: (short("u_", {"source_ref": "d1", "location_id": a}), short("c_", {"text": t, "kind": "text"})) for a, t in zip(at, lines, strict=True)}


def test_secrets_and_routes_of_whole_texts(spark, tmp_path):
    from cairn import catalogue

    far = "many words stand before it " * 20
    spark.createDataFrame([(0, far + "api_key = abc"), (1, far), (2, far + "combine across projects"), (3, "Bearer tok"), (4, "https://u:p@host/x"), (5, far + "-----BEGIN RSA PRIVATE KEY----- x"), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, far + "password: x"), (1, 1, far + "in my usual format")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    rules = {"d0": "api_key_assignment", "d1": None, "d2": None, "d3": "bearer_token", "d4": "credential_url_userinfo", "d5": "private_key_block", "d6": None, "c1-0": "api_key_assignment", "c1-1": None}
    assert {r["item_id"]: r["rule"] for r in run("secret_gate_all")} == rules
    assert {r["item_id"]: r["body"] for r in run("redact_flat_all") if rules[r["item_id"]]} == {k: f"[REDACTED:{v}]" for k, v in rules.items() if v}
    assert {r["item_id"]: r["route"] for r in run("route_text_all")} == dict.fromkeys(rules, "no_memory") | {"d2": "global_memory", "c1-1": "user_memory"}
    assert {r["item_id"]: r["hints"] for r in run("scope_hints_all") if r["hints"]} == {"d2": "multi_scope,project", "c1-1": "user_profile"}


def test_batches_never_carry_a_whole_document_with_each_word(spark):
    """Words of long texts are paired with ids alone, and only words that are asked for."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 400)) + (" end" if i % 2 else "")) for i in range(40)] + [(3, "other")], "id long, t string")
    asked = spark.createDataFrame([(1, "w39 w400 end"), (2, "other w3"), (3, "w0 w1 w0")], "query_id long, text string")
    out = S.search_batch(docs, "id", "t", asked)
    assert set(rows(out, "query_id", "id", "matched")) == {*((1, i, 3) for i in range(1, 40, 2)), (2, 3, 2), (3, 0, 2)} and out.count() == 22
    assert "array_except" not in out._jdf.queryExecution().optimizedPlan().toString() and (1, 1, 3) in rows(S.search_batch(docs, "id", "t", asked, "any"), "query_id", "id", "matched")
