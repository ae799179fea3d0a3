"""Steps that must not cost a call, a shuffle or a copy for each key, row or side."""

from cairn.operators import records as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decisions_replayed_in_batches(spark):
    """Many keys are many rows of few batches; a key's log may cross their borders."""
    rows = [(f"k{k}" if k % 5 else None, n, "create" if n == 0 else "supersede", f"d{k}-{n}", "active", f"s{n}", f"d{k}-{n - 1}" if n else None) for k in range(60) for n in range(4)]
    ops = spark.createDataFrame(rows, "key string, position long, op string, decision_id string, lifecycle_status string, statement string, supersedes_id string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        replayed = R.replay_decisions(ops)
        got = {r["decision_id"]: (r["key"], r["outcome"], r["lifecycle_status"], r["supersedes_id"], r["replaced_by"]) for r in replayed.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {d: (key, "superseded" if n else "created", "active" if n == 3 else "superseded", before, f"{d.split('-')[0]}-{n + 1}" if n < 3 else None) for key, n, _, d, _, _, before in rows}
    assert got == want
    assert "FlatMapGroups" not in plan(replayed)


def test_texts_that_need_no_work_stay_in_the_jvm(spark):
    """Composed and even texts go through no Python and no replacement, with the results of the plain way."""
    import json
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from cairn.functions import identity as I
    from cairn.functions import text as X

    safe = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", X.COMPOSABLE))
    second = {int(p[1], 16) for c in range(0x110000) if "<" not in (d := unicodedata.decomposition(chr(c))) and len(p := d.split()) == 2}
    for c in range(0x110000):
        if not safe.match(chr(c)):
            assert not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFC", chr(c)) and c not in second, hex(c)
    assert not safe.search("Größe à la française") and safe.search("u\u0308")
    texts = ["Größe \"à\" \\ x", "e\u0301\u0323 u\u0308", "a\tb\nc\rd\be\x0cf\x01\x7f", "\U0001f600 ж中", " a  b\u00a0c ", "a\u2028", " ", "", "\u2000x\u2000\u2000y", "가\u11a8", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.nfc(F.col("t")).alias("n"), X.collapse(F.col("t")).alias("c"), I.json_text(F.col("t")).alias("j")).collect()
    blank = re.compile(r"[\s\u2028\u2029\u00a0\u2000-\u200a\u3000\x1c-\x1f\x85]+")
    for r in got:
        t = r["t"]
        assert r["n"] == (t if t is None else unicodedata.normalize("NFC", t))
        assert r["c"] == (t if t is None else re.sub("^ | $", "", blank.sub(" ", t)))
        assert r["j"] == json.dumps(t)


def test_units_are_made_once(spark):
    from cairn.operators import corpus as C

    rows = [("a", n, f"a#L{n}", "x" if n % 2 else f"y{n}") for n in range(1, 9)] + [("b", 1, "b#L1", "x"), (None, 1, "n1", "x"), (None, 2, "n2", "x"), ("c", 1, "c1", None), ("c", 2, "c2", None)]
    out = C.dedup_units(spark.createDataFrame(rows, "source_ref string, line_no int, location_id string, content_hash string"))
    assert {r["location_id"]: r["duplicate_of"] for r in out.collect() if r["duplicate_of"]} == {"a#L3": "a#L1", "a#L5": "a#L1", "a#L7": "a#L1"}
    assert out.count() == 13 and "Join" not in plan(out)


def test_edges_are_told_apart_by_bare_keys(spark):
    from cairn.operators import graph as G

    a = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (2, None), (3, 4)], "a long, b long")
    named = spark.createDataFrame([("o1", "c2"), ("o9", "c9"), ("o9", "c9")], "a string, b string")
    edges = G.typed_edges((a, "decision", "decision_for", "customer", "o", "c"), (named, "decision", "decision_for", "customer"), (a, "part", "artifact_of", "decision", "p", "o"))
    got = sorted(tuple(r) for r in edges.collect())
    decision = [("decision", f, "decision_for", "customer", t) for f, t in (("o1", "c2"), ("o3", "c4"), ("o9", "c9"))]
    assert edges.columns == ["from_type", "from_id", "relation", "to_type", "to_id"] and got == decision + [("part", "p1", "artifact_of", "decision", "o2"), ("part", "p3", "artifact_of", "decision", "o4")]
    assert "hashpartitioning(from_type" not in plan(edges) and "hashpartitioning(decision" not in plan(edges)


def test_lines_are_cut_once(spark):
    from cairn.sources.text_units import units_of_text

    units = units_of_text(spark.createDataFrame([("a", "x\r\n\n  \n y z \n"), ("b", ""), ("c", None), ("d", "\n")], "source_ref string, text string"))
    assert [(r["location_id"], r["text"]) for r in units.collect()] == [("a#L1", "x"), ("a#L4", "y z")]
    assert "slice(" not in plan(units)


def test_parity_groups_both_sides_once(spark):
    from cairn.operators import integrity as Y

    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), (None, None)], "k string, n long")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, None), ("y", 3), ("y", 3)], "k string, n long")
    got = Y.parity({"t": a, "u": a, "none": a.where("false")}, {"t": b, "u": a, "none": a.where("false")})
    assert {tuple(r) for r in got.collect()} == {("t", 1, 2, False), ("u", 0, 0, True), ("none", 0, 0, True)}
    assert "replicaterows" not in plan(Y.parity({"t": a}, {"t": b}))


def test_a_log_without_repeats_is_not_joined(spark):
    from cairn.operators import ingest as N

    rows = spark.createDataFrame([(f"i{p}", f"h{p}", p) for p in range(50)], "i string, h string, p long")
    assert "Join" not in plan(N.accepted_lines(rows))
    again = rows.unionByName(spark.createDataFrame([("i3", "new", 60), ("y", "h4", 61), ("y", "z", 62), (None, "h9", 63), (None, "w", 64), (None, "w2", 65)], "i string, h string, p long"))
    assert {r["p"] for r in N.accepted_lines(again).collect()} == {*range(50), 62, 64}


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    from cairn.scratch import children
    from cairn.streaming import maintained as M

    store, versions = M.Store(spark, str(tmp_path / "s"), buckets=2), {}
    rows = spark.range(4000).selectExpr("'hot' AS ref", "concat('e', id) AS from_id", "CAST(NULL AS string) AS by_id", "CAST(NULL AS string) AS by_trace")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.write("refs", rows, 0, versions)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    (bucket,) = versions["refs"]
    assert sum(n.endswith(".parquet") for n in children(spark, f"{store.root}/refs/version=0/bucket={bucket}")) > 1
    assert store.read("refs", versions).count() == 4000


def test_edges_of_units_are_not_written_again(spark):
    from cairn.operators import corpus as C

    units, edges, _ = C.project_corpus(spark.createDataFrame([("a", "x\nx\ny"), ("b", "x")], "source_ref string, text string"))
    assert {tuple(r) for r in edges.collect()} == {("a", "source_of", "a#L1"), ("a", "source_of", "a#L2"), ("a", "source_of", "a#L3"), ("b", "source_of", "b#L1"), ("a#L2", "derived_from", "a#L1")}
    assert set(edges.inputFiles()) == set(units.inputFiles())
