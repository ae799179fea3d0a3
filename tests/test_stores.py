"""Bounded walks, source registration, streamed deletions, builds, notes and manifests against plain models."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from cairn import cursor as K
from cairn.functions import identity
from cairn.functions import text as X
from cairn.operators import builds as B
from cairn.operators import corpus as C
from cairn.operators import graph as G
from cairn.operators import ingest as N
from cairn.engine import Engine
from cairn.operators import access as A
from cairn.operators import notes as O
from cairn.operators import records as R
from cairn.operators import temporal as T
from cairn.operators import vault as U
from cairn.plans import views as V
from cairn.sources import files, jsonl
from cairn.sources.text_units import normalized_extraction
from cairn.streaming import projection as P


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


# ------------------------------------------------------------------------ walks


def _walk(edges, seed, hidden, depth, fan_out, max_nodes, max_edges):
    """A plain breadth-first walk with the same bounds."""
    if seed in hidden:
        return False, [], [], []
    nodes, lines, codes, queue = {seed: 0}, {}, set(), deque([(seed, 0)])
    order = sorted(edges, key=lambda e: (e[2], e[0]))
    while queue:
        at, d = queue.popleft()
        if d >= depth:
            codes.add("bound_max_depth")
            continue
        for here, there in ((1, 3), (3, 1)):
            near = [e for e in order if e[here] == at and e[there] not in hidden]
            if len(near) > fan_out:
                codes.add("bound_max_fan_out")
            for e in near[:fan_out]:
                if e[there] not in nodes:
                    nodes[e[there]] = d + 1
                    queue.append((e[there], d + 1))
                lines.setdefault(e[0], e)
    if len(nodes) > max_nodes:
        codes.add("bound_max_nodes")
    if len(lines) > max_edges:
        codes.add("bound_max_edges")
    return True, sorted(list(nodes.items())[:max_nodes]), sorted((e[2], e[0]) for e in list(lines.values())[:max_edges]), sorted(codes)


@pytest.mark.parametrize("bounds", [(2, 20, 40, 80), (2, 2, 5, 6), (1, 3, 40, 4), (0, 20, 40, 80)])
def test_walks_match_a_queue(spark, bounds):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(14)]
    edges = [(f"e{i:03}", rng.choice(names), rng.choice("ab"), rng.choice(names)) for i in range(60)]
    hidden = {"n3", "n4"}
    df = spark.createDataFrame(edges, "edge_id string, from_id string, relation string, to_id string")
    allowed = spark.createDataFrame([(n,) for n in names if n not in hidden], "node string")
    seeds = spark.createDataFrame([("n0",), ("n1",), ("n0",), ("n3",), ("unknown",)], "node string")
    depth, fan_out, max_nodes, max_edges = bounds
    got = {r["seed"]: r for r in G.subgraph(df, seeds, allowed, depth, fan_out, max_nodes, max_edges).collect()}
    assert set(got) == {"n0", "n1", "n3", "unknown"}
    for seed, r in got.items():
        want = _walk(edges, seed, hidden | {"unknown"}, *bounds)
        assert (r["authorized"], [tuple(n) for n in r["nodes"]], [(e["relation"], e["edge_id"]) for e in r["edges"]], sorted(r["bound_codes"])) == want


@pytest.mark.parametrize("bound", [{"depth": 3}, {"fan_out": 0}, {"max_nodes": 41}, {"max_edges": True}])
def test_bounds_are_not_clamped(spark, bound):
    none = spark.createDataFrame([], "node string")
    with pytest.raises(ValueError):
        G.subgraph(spark.createDataFrame([], "edge_id string, from_id string, relation string, to_id string"), none, none, **bound)


# ---------------------------------------------------------------------- sources

SOURCE = "position long, external_ref string, kind string, profile_id string, project_id string, knowledge_space_id string, content string"


def test_registration_follows_the_latest_version(spark):
    row = lambda p, content, ref="a", profile="x": (p, ref, "txt", profile, None, None, content)
    registry = spark.createDataFrame([row(1, "one"), row(2, "two")], SOURCE)
    batch = spark.createDataFrame([row(3, "two"), row(4, "one"), row(5, "one"), row(6, "é\"\\"), row(7, "one", "b"), row(8, "one", profile=None), row(9, None), row(10, "")], SOURCE)
    got = {r["position"]: r for r in C.register_sources(registry, batch).collect()}
    assert [got[p]["outcome"] for p in range(3, 11)] == ["existing", "registered", "existing", "registered", "registered", "registered", "registered", "existing"]
    assert got[4]["version_id"] == got[5]["version_id"] == got[6]["supersedes"] and got[7]["supersedes"] is None
    assert got[8]["source_id"] != got[4]["source_id"]
    assert C.register_sources(registry.limit(0), batch.limit(0)).count() == 0


def test_source_ids_are_canonical(spark):
    import hashlib

    place = {"external_ref": "é/1", "kind": "txt", "profile_id": "p", "project_id": None, "knowledge_space_id": None}
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    digest = lambda x: hashlib.sha256(f"{identity.CONTENT_DOMAIN}|v1|{canonical(x)}".encode()).hexdigest()
    source = digest({"domain": identity.LOGICAL_SOURCE, "descriptor": place})
    content = digest({"domain": identity.SOURCE_CONTENT, "bytes_sha256": hashlib.sha256("añ".encode()).hexdigest()})
    version = digest({"source_id": source, "content_hash": content, "scope": ["p", None, None], "normalization_version": identity.NORMALIZATION})
    df = spark.createDataFrame([(1, "é/1", "txt", "p", None, None, "añ")], SOURCE)
    r = C.register_sources(df.limit(0), df).first()
    assert (r["source_id"], r["content_hash"], r["version_id"]) == (source, content, "sv_" + version[:32])


def test_versions_are_rebound_once(spark):
    registry = spark.createDataFrame([("s", "v1", "a"), ("s", "v2", "b"), ("t", "v1", "c")], "source_id string, version_id string, sensitivity string")
    change = spark.createDataFrame([("s", "v2", "z"), ("u", "v9", "y")], registry.schema)
    assert rows(C.rebind_version(registry, change)) == [("s", "v1", "a"), ("s", "v2", "z"), ("t", "v1", "c"), ("u", "v9", "y")]


# -------------------------------------------------------- deletions and streams


def _events(seed, n=60):
    rng = random.Random(seed)
    out = []
    for s in range(n):
        kind = rng.choice(["active", "active", "observed", "deleted"])
        target = f"e{rng.randrange(n + 10)}" if kind == "deleted" else None
        out.append((f"e{s}", f"t{rng.randrange(4)}", s, kind, f"h{s}", target))
    return out


LOG = "eid string, trace_id string, sequence long, lifecycle string, content_hash string, tombstone_target string"


def _sequential(events):
    """State, successor and audit as a log read line by line leaves them."""
    state, trace, after, waiting, audit = {}, {}, {}, {}, []
    for eid, t, _, kind, _, target in events:
        state[eid], trace[eid] = kind, t
        if kind == "active":
            for other in [o for o in state if o != eid and trace[o] == t and state[o] == "active"]:
                state[other], after[other] = "superseded", eid
        for d in waiting.pop(eid, []):
            state[eid] = "deleted"
            audit.append((d, eid, ""))
        if target:
            if target in state:
                state[target] = "deleted"
                audit.append((eid, target, ""))
            else:
                waiting.setdefault(target, []).append(eid)
                audit.append((eid, target, "target_not_yet_present"))
    return state, after, sorted(audit), {d for ds in waiting.values() for d in ds}


@pytest.mark.parametrize("seed", range(3))
def test_streamed_deletions_match_the_log(spark, tmp_path, seed):
    events = [e for e in _events(seed) if e[5] != e[0]]
    root = str(tmp_path / "log")
    cuts = [0, 17, 18, 40, len(events)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(events[a:b] + events[max(0, a - 3) : a], LOG)
        P.commit_log(part, n, root)
        if n == 2:  # the batch runs again after a failure
            P.commit_log(part, n, root)
    state, after, audit, pending = _sequential(events)
    now = P.lifecycle_now(spark, root)
    assert {r["eid"]: r["current_state"] for r in now.collect()} == state
    assert {r["eid"]: r["superseded_by"] for r in now.where("superseded_by IS NOT NULL").collect()} == after
    assert rows(P.committed(spark, root, "audit"), "deletion_id", "target_id", "detail") == sorted(audit, key=str)
    whole = spark.createDataFrame(events, LOG)
    deletions = whole.where("tombstone_target IS NOT NULL").select(F.col("eid").alias("deletion_id"), F.col("tombstone_target").alias("target_id"), "sequence")
    columns = ("deletion_id", "target_id", "status", "target_trace_id")
    assert rows(P.deletions_now(spark, root), *columns) == rows(N.tombstones(deletions, whole), *columns)
    assert {r["deletion_id"] for r in P.deletions_now(spark, root).where("status = 'pending'").collect()} == pending


def test_a_stream_fills_the_tables(spark, tmp_path):
    events = [("e0", "t", 0, "active", "h", None), ("e1", "t", 1, "deleted", "i", "e9"), ("e9", "t", 2, "active", "j", None)]
    spark.createDataFrame(events, LOG).repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    P.start_log(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["status"] for r in P.deletions_now(spark, str(tmp_path / "out")).collect()] in (["applied_on_arrival"], ["applied"])
    assert {r["current_state"] for r in P.lifecycle_now(spark, str(tmp_path / "out")).where("eid = 'e9'").collect()} == {"deleted"}


# ----------------------------------------------------------------------- builds


def _line(n, **more):
    base = {"event_id": f"e{n}", "trace_id": "t", "source": "s", "event_type": "user_statement", "schema_version": 1, "created_at": "2024-01-01T00:00:00Z", "observed_at": "2024-01-01T00:00:00Z", "sequence": n, "lifecycle_status": "observed", "verification_status": "none"}
    from cairn import vocabulary as V

    base |= {"confidence": sorted(V.CONFIDENCES)[0], "sensitivity": "public", "retention": sorted(V.RETENTIONS)[0], "sanitized_content_hash": f"h{n}", "redaction_audit": "{}"}
    return json.dumps(base | more)


def test_builds_and_states(spark, tmp_path):
    log, root = tmp_path / "log.jsonl", str(tmp_path / "root")
    state = lambda table: B.store_state(spark, str(log), str(tmp_path / table))
    assert state("none") == "CANONICAL_MISSING"
    log.write_text("no json\n")
    assert state("none") == "CANONICAL_MALFORMED"
    log.write_text("".join(_line(n) + "\n" for n in range(3)) + _line(7, sanitized_content_hash="h1") + "\n")
    assert jsonl.read_log(spark, str(log)).where("fault IS NOT NULL").count() == 0
    assert state("none") == "DERIVED_MISSING"
    put = lambda name, data, schema="eid string, sequence long": spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    sound = [("e0", 0), ("e1", 1), ("e2", 2)]
    put("good", sound)
    put("old", sound[:2])
    put("wrong", sound[:2] + [("e2", 5)])
    put("other", [(1,)], "x int")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"none of it")
    assert [state(t) for t in ("good", "old", "wrong", "other", "broken")] == ["READY", "DERIVED_STALE", "DERIVED_CORRUPT", "SCHEMA_INCOMPATIBLE", "DERIVED_CORRUPT"]
    assert B.current(spark, "events", root) is None
    assert B.recover(spark, str(log), root, 1) == "DERIVED_MISSING"
    assert rows(B.current(spark, "events", root), "eid", "sequence") == sound
    assert B.recover(spark, str(log), root, 2) == "READY"
    with pytest.raises(Exception):
        B.publish(spark.range(3).select(F.raise_error(F.lit("no")).alias("eid")), "events", root, 3, ["eid"])
    assert rows(B.versions(spark, root), "version", "status", "cutoff", "n_rows") == [(1, "published", 2, 3), (3, "failed", None, None)]
    assert B.current(spark, "events", root).count() == 3


def test_event_rows_have_their_columns(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text(_line(0) + "\n" + _line(1, redaction_audit='{"a":1}', knowledge_space_ids=["k1", "k2"]) + "\n")
    out = N.project_rows(jsonl.read_log(spark, str(log)), "log-1")
    assert len(out.columns) == 24
    assert rows(out, "event_id", "redaction_applied", "origin_jsonl", "knowledge_space_id", "profile_id") == [("e0", 0, "log-1", None, None), ("e1", 1, "log-1", "k1", None)]


def test_blobs_are_stored_once(spark, tmp_path):
    import hashlib

    root = str(tmp_path / "blobs")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    first = spark.createDataFrame([(b"a",), (b"a",), (b"",), (None,)], "content binary")
    assert rows(files.put_blobs(first, root, "1"), "new") == [(True,), (True,)]
    assert rows(files.put_blobs(first, root, "1"), "new") == [(True,), (True,)]
    assert {r["digest"]: r["new"] for r in files.put_blobs(spark.createDataFrame([(b"a",), (b"b",)], "content binary"), root, "2").collect()} == {digest(b"a"): False, digest(b"b"): True}
    spark.createDataFrame([(digest(b"c"), bytearray(b"other"))], "digest string, content binary").write.parquet(f"{root}/batch=3/shard={digest(b'c')[:2]}")
    asked = spark.createDataFrame([(digest(x),) for x in (b"a", b"b", b"c", b"d")], "digest string")
    got = {r["digest"]: (r["content"], r["state"]) for r in files.get_blobs(spark, root, asked).collect()}
    assert got == {digest(b"a"): (b"a", "ok"), digest(b"b"): (b"b", "ok"), digest(b"c"): (None, "corrupt"), digest(b"d"): (None, "missing")}


def test_streamed_lines_keep_their_faults(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(_line(0).encode() + b"\n\n[1]\n{cut\n\xff\n" + _line(1, schema_version=2).encode() + b"\n")
    stream = jsonl.stream_log(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.select("line", "fault", "event_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(str(r["fault"]) for r in spark.read.parquet(out).collect()) == ["None", "invalid_top_level", "invalid_utf8", "malformed_json", "schema_version"]


def test_payloads_become_envelopes(spark):
    import hashlib

    texts = ["plain", 'q"\\', "é\n\t\r\b\f", "\x00\x1f", None]
    df = spark.createDataFrame([(i, t, None, ["k", "k", "l"]) for i, t in enumerate(texts)], "sequence long, sanitized_content string, event_id string, knowledge_space_ids array<string>")
    got = jsonl.normalized_events(df, F.lit("system_event"), "s").orderBy("sequence").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["sanitized_content_hash"] == "sha256:" + hashlib.sha256(json.dumps(t, ensure_ascii=False).encode()).hexdigest()
        assert len(r["event_id"]) == 36 and r["knowledge_space_ids"] == ["k", "l"] and r["created_at"].endswith("Z") and r["session_id"] is None


def test_corpus_projection_reports(spark):
    sources = spark.createDataFrame([("a", "x\nx\npassword: hunter2hunter2\ny"), ("b", None), ("c", " \n"), ("d", "x")], "source_ref string, text string")
    units, edges, report = C.project_corpus(sources)
    assert dict(rows(report)) == {"sources": 4, "empty_sources": 2, "units": 4, "rejected": 1, "repeats": 1, "edges": 5}
    assert edges.count() == 5 and units.where("text LIKE 'password%'").isEmpty()


def test_denied_items_are_only_counted(spark):
    items = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", "1")], "resource_type string, resource_id string")
    facts = spark.createDataFrame([("d", "1", None, None, "2020", None), ("d", "2", None, None, "2020", None)], "resource_type string, resource_id string, created_at string, effective_at string, valid_from string, valid_until string")
    shown, denied = T.annotate_allowed(items, facts, items.where("resource_id = '1'"), "2021")
    assert rows(shown, "resource_type", "resource_id", "holds") == [("d", "1", True), ("e", "1", None)] and denied.first()[0] == 1


def test_pages_know_their_end(spark, sf):
    e, ask = Engine(V.events(spark, sf)), A.Request("READ", "p3", ("p3",))
    total = e.query_events(ask, 500).count()
    assert 10 < total < 500
    assert e.page_of_events(ask, total)[1] is None
    page, token = e.page_of_events(ask, total - 1)
    rest, end = e.page_of_events(ask, total - 1, token)
    assert (len(page), len(rest), end) == (total - 1, 1, None)


def test_bounded_waits_end():
    states = iter(["PENDING", "PENDING", "CURRENT"])
    assert P.await_current(lambda: next(states), 5, 0.01)
    assert not P.await_current(lambda: "PENDING", 0.05, 0.02)


# ------------------------------------------------------------------------ notes


def test_edit_conflicts_get_a_sibling(spark):
    desired = spark.createDataFrame([("n1", "A/x.md", "new", "f2"), ("n2", "A/y.md", "b", "f3")], "note_id string, note_path string, body string, fp string")
    manifest = spark.createDataFrame([("n1", "f1"), ("n2", "f3")], "note_id string, recorded_fp string")
    disk = spark.createDataFrame([("n1", "mine", True), ("n2", "f3", True)], "note_id string, disk_fp string, marker boolean")
    actions = U.reconcile(desired.select("note_id", "fp"), manifest, disk)
    assert rows(U.siblings(actions, desired)) == [("n1", "A/x.new.md", "new")]


def test_texts_stay_data(spark):
    df = spark.createDataFrame([("a\n# [x](y) <b>\\ *_",), (None,), (" \t ",), ("x" * 2100,), ("\x01\x7f",)], "t string")
    got = [r[0] for r in df.select(X.escape_inline(F.col("t"))).collect()]
    assert got == ["a \\# \\[x\\](y) &lt;b&gt;\\\\ \\*\\_", "(none)", "(none)", "x" * 2000 + "…[truncated]", "(none)"]
    df = spark.createDataFrame([('a"\\\n\t\r---\x01\x7fé', ["x", '"']), (None, [])], "t string, l array<string>")
    assert [tuple(r) for r in df.select(X.yaml_scalar(F.col("t")), X.yaml_list(F.col("l"))).collect()] == [('"a\\"\\\\\\n\\t\\r---\\x01\\x7fé"', '["x", "\\""]'), ("null", "[]")]
    labels = ["ok a/b:1", " lead", "a..b", "a|b", "a\n", "", None, "x" * 121]
    df = spark.createDataFrame([(t,) for t in labels], "t string")
    assert [r[0] for r in df.select(X.safe_link_display(F.col("t"), F.lit("id"))).collect()] == ["ok a/b:1"] + ["id"] * 7
    df = spark.createDataFrame([("role=system x role:developer",), (None,)], "t string")
    assert [r[0] for r in df.select(X.escape_field(F.col("t"))).collect()] == ["role\u200b=\u200bsystem (data) x role\u200b:\u200bdeveloper (data)", ""]
    assert [K.corpus_limit(x) for x in (None, 0, -1, "7", True, 7)] == [100, 100, 100, 100, 100, 7]


def test_pages_hold_every_line_once(spark):
    states = spark.createDataFrame([("p" if i % 10 else None, f"k{i:03}", "v", "active" if i % 3 else "superseded") for i in range(300)], "project_id string, state_key string, state_value string, lifecycle_status string")
    notes = O.state_notes(states, size=20).collect()
    assert len({n["note_id"] for n in notes}) == len({n["note_path"] for n in notes}) == len(notes) > 8
    lines = [line for n in notes for line in n["body"].split("\n") if line.startswith("| k")]
    assert sorted(line[2:6] for line in lines) == [f"k{i:03}" for i in range(300) if i % 3]
    assert all(n["pages"] == 9 for n in notes if n["project_id"] == "p")


def test_conflicts_name_their_positions(spark):
    records = spark.createDataFrame([("d1", "p", "k", "conflicted", "a"), ("d2", "p", "k", "conflicted", "b"), ("d3", "p", None, "conflicted", "c"), ("d4", "p", "k", "active", "d")], "decision_id string, project_id string, decision_key string, lifecycle_status string, statement string")
    notes = {n["resource_id"]: n["body"] for n in O.conflict_note_pages(records, "decision_id", F.col("decision_key")).collect()}
    assert set(notes) == {"k", "alone|d3"} and "- d1; statement: a" in notes["k"] and "- d2; statement: b" in notes["k"] and O.BANNERS["conflicted"] in notes["k"]
    index = O.conflict_index(records, "decision_id", F.col("decision_key")).first()["body"]
    assert "- k: 2 positions" in index and "- alone\\|d3: 1 positions" in index


def test_manifests_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert O.load_manifest(spark, path).count() == 0
    records = spark.createDataFrame([(f"d{i}", "É \"x\"", "p", "active") for i in range(5)], "decision_id string, statement string, project_id string, lifecycle_status string")
    notes = O.record_notes(records, "decision").withColumn("status", F.lit("current"))
    assert O.store_manifest(notes, path) is True
    assert O.store_manifest(notes.repartition(3), path) is False
    assert rows(O.load_manifest(spark, path)) == rows(notes, *O.ENTRY)
    changed = O.record_notes(records.where("decision_id <> 'd0'").withColumn("statement", F.when(F.col("decision_id") == "d1", "new").otherwise(F.col("statement"))), "decision")
    told = O.write_changes(changed, O.load_manifest(spark, path), str(tmp_path / "notes"), 1)
    assert sorted(r["change"] for r in told.collect()) == ["retire", "unchanged", "unchanged", "unchanged", "update"]
    assert spark.read.parquet(str(tmp_path / "notes")).count() == 2
    for bad in ({"note_path": "../x.md"}, {"fp": "sha256:1"}, {"note_id": "x"}, {"status": "gone"}, {"more": "x"}):
        entry = notes.first().asDict()
        line = json.dumps({k: entry[k] for k in O.ENTRY} | bad)
        spark.createDataFrame([(line,)], "value string").write.mode("overwrite").text(str(tmp_path / "bad"))
        with pytest.raises(ValueError):
            O.load_manifest(spark, str(tmp_path / "bad"))


def test_lists_of_records(spark):
    df = spark.createDataFrame([("d1", "1", "p", None, "active"), ("d2", "2", "p", "s", "active"), ("d3", "3", "p", None, "deleted"), ("d4", "4", "q", None, "active")], "decision_id string, effective_at string, project_id string, scope string, lifecycle_status string")
    ids = lambda **f: [r["decision_id"] for r in R.listed(df, "decision", "p", **f).collect()]
    assert ids() == ["d1", "d2"] and ids(scope=None) == ["d1"] and ids(scope="s") == ["d2"] and ids(lifecycle_status="deleted") == ["d3"]
    assert ids(limit=1, cursor={"decision_id": "d1", "effective_at": "1"}) == ["d2"]
    with pytest.raises(ValueError):
        R.listed(df, "decision", " ")
    with pytest.raises(ValueError):
        R.listed(df, "decision", "p", mood="x")
    known = spark.createDataFrame([("a1", "pdf")], "artifact_id string, kind string")
    assert rows(R.with_artifacts(spark.createDataFrame([("a1",), ("a2",)], "artifact_id string"), known)) == [("a1", "pdf"), ("a2", None)]


def test_extraction_statuses(spark):
    df = spark.createDataFrame([("a", "partial", " x  y "), ("a", "partial", " "), ("b", "complete", None), ("c", "odd", "x"), ("d", None, None), ("e", "empty_source", None)], "source_ref string, status string, text string")
    units, status = normalized_extraction(df)
    assert rows(units) == [("a", "x y")]
    assert {r["source_ref"]: (r["status"], r["error_reason"]) for r in status.collect()} == {"a": ("complete", None), "b": ("empty", None), "c": ("failed", "extraction_odd"), "d": ("failed", "extraction_unknown"), "e": ("empty", "extraction_empty_source")}
