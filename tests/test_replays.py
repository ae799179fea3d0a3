"""Grammars of requirements, states and decisions against plain sequential versions; null keys never meet."""

import random

from cairn.operators import records as R

OPS = ["create", "supersede", "transition", "delete", "update", "odd"]


def test_requirements(spark):
    rng, fields = random.Random(2), R.REQUIREMENT_FIELDS
    ops = []
    for p in range(400):
        i = rng.randrange(30)
        value = lambda: rng.choice([None, "a", "b"])
        ops.append((p, rng.choice(OPS), f"r{i}", f"r{rng.randrange(max(0, i - 2), i + 2)}" if rng.random() < 0.5 else None, None, value(), rng.choice(["active", "candidate", "deleted"]), *[value() for _ in fields[2:]]))
    names = ["position", "op", "requirement_id", "supersedes", "replaced_by", *fields]
    now, want = {}, {}
    for row in ops:
        r = dict(zip(names, row, strict=True))
        have, prior, outcome = now.get(r["requirement_id"]), now.get(r["supersedes"]), "rejected"
        if r["op"] == "create" and not have:
            now[r["requirement_id"]], outcome = {k: r[k] for k in (*fields, "supersedes", "replaced_by")}, "created"
        elif r["op"] == "create":
            outcome = "noop" if all(have[f] == r[f] for f in fields[:4]) else "rejected"
        elif r["op"] == "supersede" and prior:
            outcome = "noop" if have else "superseded"
            if not have:
                now[r["requirement_id"]] = {k: r[k] for k in (*fields, "supersedes", "replaced_by")}
                prior["lifecycle_status"], prior["replaced_by"] = "superseded", r["requirement_id"]
        elif r["op"] == "transition" and have and (have["lifecycle_status"] != "deleted" or r["lifecycle_status"] == "deleted"):
            outcome = "transitioned"
            for f in fields[1:4]:
                have[f] = r[f]
            for f in ("statement", "supersedes", "replaced_by", *fields[4:]):
                have[f] = r[f] if r[f] is not None else have[f]
        elif r["op"] == "delete" and have:
            have["lifecycle_status"], outcome = "deleted", "deleted"
        want[r["position"]] = (outcome, dict(now.get(r["requirement_id"]) or {}))
    kind = "position long, op string, requirement_id string, supersedes string, replaced_by string, " + ", ".join(f"{f} string" for f in fields)
    got = R.replay_requirements(spark.createDataFrame(ops, kind).repartition(6)).collect()
    assert len(got) == len(ops)
    for r in got:
        outcome, row = want[r["position"]]
        assert r["outcome"] == outcome and all(r[k] == row.get(k) for k in (*fields, "supersedes", "replaced_by")), r


def test_states(spark):
    rng, ops = random.Random(4), []
    for p in range(400):
        ops.append((p, rng.choice(OPS), "j", None, rng.choice(["k1", "k2", "k3", None]), rng.choice(["a", "b", None]), None, rng.choice(["active", "active", "conflicted"]), None, None))
    active, want = {}, {}
    for p, op, _, _, key, value, _, status, _, _ in ops:
        have = active.get(key) if key else None
        outcome = "rejected"
        if op in ("create", "update") or (op == "supersede" and have):
            if have and have == (value, status):
                outcome = "noop"
            elif op == "create" and have and status == "active":
                outcome = "conflict"
            else:
                outcome = "superseded" if op == "supersede" else "created"
                if op != "create":
                    active.pop(key, None)
                if status == "active":
                    active[key] = (value, status)
        elif op == "transition" and have:
            outcome, have = "transitioned", (value if value is not None else have[0], status)
            active[key] = have
            if status != "active":
                active.pop(key)
        elif op == "delete" and have:
            outcome = "deleted"
            active.pop(key)
        want[p] = (outcome, (active.get(key) or (None,))[0] if key else (value if outcome == "created" and status == "active" else None))
    kind = "position long, op string, project_id string, scope string, state_key string, state_value string, state_ref string, lifecycle_status string, verification_status string, effective_at string"
    got = {r["position"]: (r["outcome"], r["state_value"]) for r in R.replay_states(spark.createDataFrame(ops, kind).repartition(5)).collect()}
    assert got == want


def test_null_keys_never_meet(spark):
    log = [(None, 1, "create", "a", "active", "x", None), (None, 2, "create", "b", "active", "y", None), (None, 3, "supersede", "c", "active", "z", "a"), ("k", 4, "create", "d", "active", "x", None), ("k", 5, "create", "e", "active", "y", None)]
    got = R.replay_decisions(spark.createDataFrame(log, "key string, position long, op string, decision_id string, lifecycle_status string, statement string, supersedes_id string"))
    assert {r["decision_id"]: (r["outcome"], r["lifecycle_status"]) for r in got.collect()} == {"a": ("created", "superseded"), "b": ("created", "active"), "c": ("superseded", "active"), "d": ("created", "active"), "e": ("conflict", None)}
    rows = spark.createDataFrame([(None, 1, "a", "x"), (None, 2, "b", "x"), ("k", 3, "c", "x"), ("k", 4, "d", "x")], "key string, at long, id string, status string")
    chain = {r["id"]: (r["supersedes_id"], r["lifecycle_status"]) for r in R.supersede_chain(rows, ["key"], ["at"], "id", "status").collect()}
    assert chain == {"a": (None, "x"), "b": (None, "x"), "c": (None, "superseded"), "d": ("c", "x")}
    history = {r["id"]: r["lifecycle_status"] for r in R.state_history(rows, ["key"], ["at"], "status").collect()}
    assert history == {"a": "active", "b": "active", "c": "active"}
