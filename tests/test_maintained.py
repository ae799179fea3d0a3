"""First write wins at any shape and cut of a log, and projections kept up to date."""

import random

import pytest

from cairn.operators import ingest as N
from cairn.operators import integrity as Y
from cairn.operators.components import components
from cairn.scratch import written
from cairn.streaming import maintained as M

LOG = (
    "eid string, content_hash string, sequence long, trace_id string, lifecycle string, verification string, content string, profile_id string, project_id string,"
    " spaces array<string>, parent_trace_id string, relation_ids array<string>, artifact_refs array<struct<artifact_id string>>, tombstone_target string"
)


def sequential(lines):
    ids, contents, out = {}, {}, {}
    for p, i, h in lines:
        if i in ids:
            out[p] = "duplicate_event_id" if ids[i] == h else "event_id_content_conflict"
        elif h in contents:
            out[p] = "duplicate_content_hash"
        else:
            ids[i], contents[h], out[p] = h, i, "new_event"
    return out


def told(df):
    return {r["p"]: r["outcome"] for r in df.collect()}


@pytest.mark.parametrize("task_lines", [100_000, 40])
def test_alternating_and_hot_lines(spark, task_lines):
    rng = random.Random(task_lines)
    lines = [(p, f"i{p // 2}", f"h{(p + 1) // 2}") for p in range(3_000 if task_lines > 100 else 60)]
    at = len(lines)
    lines += [(at + p, f"x{p}", "hot") for p in range(500)] + [(at + 500 + p, "hot", f"y{p}") for p in range(500)]
    at = len(lines)
    lines += [(at + p, f"r{rng.randrange(60)}", f"s{rng.randrange(60)}") for p in range(400)]
    df = spark.createDataFrame(lines, "p long, i string, h string").repartition(5)
    assert told(N.outcomes(df, "i", "h", "p", task_lines)) == sequential(lines)


def test_components(spark):
    rng, n = random.Random(1), 400
    edges = [(i, i + 1) for i in range(150)] + [(rng.randrange(200, n), rng.randrange(200, n)) for _ in range(120)] + [(5, 5), (1, 0)]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    groups = lambda f: {frozenset(x for x in got if f(x) == v) for v in {f(x) for x in got}}
    assert groups(got.get) == groups(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def log_lines(rng, n):
    out = []
    for s in range(n):
        i = s if rng.random() < 0.8 else rng.randrange(s + 1)
        refs = [rng.choice([f"e{rng.randrange(2 * n)}", f"t{rng.randrange(12)}", f"t{rng.randrange(30)}"]) for _ in range(rng.randrange(3))]
        gone = rng.choice([f"e{rng.randrange(n + 20)}", None]) if rng.random() < 0.2 else None
        out.append((
            f"e{i}", f"h{rng.randrange(n)}" if rng.random() < 0.3 else f"h{s}", s, f"t{rng.randrange(min(12, s // 4 + 1))}", rng.choice(["active", "observed", "active"]), "none", f"text {s}",
            rng.choice(["p1", "p2", None]), rng.choice(["j1", None]), rng.sample(["k1", "k2", "k3"], rng.randrange(3)), rng.choice([None, f"t{rng.randrange(12)}"]), refs,
            [(f"a{rng.randrange(9)}",)] * rng.randrange(2), gone,
        ))
    return out


def test_projections_kept_up_to_date(spark, tmp_path):
    lines, cuts = log_lines(random.Random(4), 90), [0, 1, 30, 55, 90]
    store, read = M.Store(spark, str(tmp_path / "state"), buckets=8), []
    for n, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = spark.createDataFrame(lines[a:z], LOG)
        M.commit(store, batch, n)
        if n == 2:  # a batch that runs again writes the same
            M.commit(store, batch, n)
        read.append(sum(map(len, store.touched.values())))
        want = sequential([(x[2], x[0], x[1]) for x in lines[:z]])
        assert {r["sequence"]: r["outcome"] for r in store.appended("outcomes").collect()} == want
        if n > 1:
            kept = written(spark.createDataFrame([x for x in lines[:z] if want[x[2]] == "new_event"], LOG), "log")
            parity = Y.parity(N.projections(kept), M.projections(store)).collect()
            assert len(parity) == 9 and all(r["equal"] for r in parity), (n, parity)
    assert read[0] < read[2]


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    store = M.Store(spark, str(tmp_path / "state"), buckets=64)
    row = lambda s: (f"e{s}", f"h{s}", s, f"t{s}", "active", "none", "x", "p1", "j1", ["k1"], None, [], [], None)
    M.commit(store, spark.createDataFrame([row(s) for s in range(300)], LOG), 0)
    M.commit(store, spark.createDataFrame([row(300)], LOG), 1)
    assert max(map(len, store.touched.values())) <= 3
    assert sum(v == 1 for v in store.manifest()["names"].values()) <= 2
