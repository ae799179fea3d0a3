"""Resource types of grants, whole relations, and reads for a table of requests."""

import pytest
from pyspark.sql import functions as F

from cairn.engine import Denied, Engine
from cairn.operators import access as A
from cairn.operators import requests as Q
from cairn.plans import views as V

GRANT = "grant_id string, subject_profile string, operation string, target_type string, target_id string, resource_types string, state string, lifecycle_status string, supersedes string, verification_ref string"


def granted(spark, *rows):
    return spark.createDataFrame([(f"g{i}", "p1", "READ", *r, None, "active", None, None) for i, r in enumerate(rows)], GRANT)


@pytest.mark.parametrize("types, opens", [('["decision"]', False), ('["event"]', True), ('["event","decision"]', True), (None, True)])
def test_a_grant_opens_only_what_it_names(spark, sf, types, opens):
    ev, ask = V.events(spark, sf), A.Request("READ", "p1", ("p1",), ("j2",))
    e = Engine(ev, granted(spark, ("project", "j2", types)))
    others = lambda df: df.where("profile_id IS NULL OR profile_id <> 'p1'").count()
    assert (others(e.query_events(ask, 500)) > 0) is opens
    ask = A.Request("READ", "p1", ("p4",), ())
    e = Engine(ev, granted(spark, ("profile", "p4", types)))
    if opens:
        assert e.query_events(ask, 500).count() > 0
    else:
        with pytest.raises(Denied):
            e.query_events(ask, 500)
    decisions = ev.withColumn("resource_type", F.lit("decision"))
    if types is None or "decision" in types:
        assert e.records(ask, decisions, "decision", ["eid"], 5).count() == 5
    for kind in ("requirement", "verification", "state", "artifact"):
        if types is None:
            assert e.records(ask, decisions, kind, ["eid"], 5).count() == 5
        else:
            with pytest.raises(Denied):
                e.records(ask, decisions, kind, ["eid"], 5)


def test_times_of_other_types_stay_hidden(spark):
    owners = spark.createDataFrame([(k, k[0], "p4", "j2", ["k1"]) for k in ("event", "decision")], "resource_type string, resource_id string, profile_id string, project_id string, spaces array<string>")
    facts = owners.select("resource_type", "resource_id", F.lit("2020").alias("created_at"), *[F.lit(None).cast("string").alias(c) for c in ("effective_at", "valid_from", "valid_until")])
    e = Engine(owners.limit(0), granted(spark, ("profile", "p4", '["decision"]')))
    got = e.facts(A.Request("READ", "p1", ("p4",)), facts, owners, "transaction", "2021")
    assert [r["resource_type"] for r in got.collect()] == ["decision"]


def test_relations_with_a_hidden_end_are_withheld(spark):
    ev = spark.createDataFrame([(f"e{i}", f"t{i}", "2020", i, "p1" if i < 4 else "p2", None, [], "active", "x") for i in range(6)], "eid string, trace_id string, created_at string, sequence long, profile_id string, project_id string, spaces array<string>, lifecycle string, content string")
    rel = spark.createDataFrame([("e1", "child_of", "e0"), ("e2", "child_of", "e1"), ("e3", "derived_from", "e2"), ("e3", "derived_from", "e5")], "from_id string, relation string, to_id string")
    e, ask = Engine(ev), A.Request("READ", "p1", ("p1",))
    assert e.related(ask, rel, "e1").count() == 2 and e.related(ask, rel, "e3").count() == 0
    assert e.related(ask, rel, "e5").count() == 0 and e.related(ask, rel, "e0").count() == 1
    assert [r["to_id"] for r in e.parent(ask, rel, "e1").collect()] == ["e0"] and [r["from_id"] for r in e.children(ask, rel, "e1").collect()] == ["e2"]


def test_a_table_of_requests_reads_what_each_one_reads(spark, sf):
    ev, grants = V.events(spark, sf), V.grants(spark, sf)
    asks = V.requests(spark, sf).where("request_id < 40").collect()
    table = spark.createDataFrame(asks)
    got: dict = {}
    for r in Q.admitted(Q.composed(table, grants, "event"), ev).select("request_id", "eid").collect():
        got.setdefault(r[0], set()).add(r[1])
    e = Engine(ev, grants)
    for r in asks:
        ask = A.Request(r["operation"], r["requester"], tuple(r["profiles"]), tuple(r["projects"]), tuple(r["spaces"]), r["include_global"], r["isolated"])
        try:
            want = {x["eid"] for x in A.secured(ev, e.scopes(ask, "event")).collect()} if r["operation"] == "READ" else set()
        except Denied:
            want = set()
        assert got.get(r["request_id"], set()) == want, r
    plan = Q.admitted(Q.composed(table, grants, "event"), ev)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in plan


def test_kinds_of_requests_meet_cells_of_rows(spark):
    scopes = spark.createDataFrame([(1, ["p1"], [], [], False), (1, [], ["j1"], [], False), (2, ["p1"], [], [], True), (3, [], [], ["k1"], False), (4, [], ["j1"], [], False), (4, ["p1"], [], [], False)], "request_id long, profiles array<string>, projects array<string>, spaces array<string>, ownerless boolean")
    rows = [(f"e{i:03}", f"2020-{i % 7}", f"p{i % 3}" if i % 4 else None, f"j{i % 5}", [f"k{i % 2}"]) for i in range(60)]
    rows += [("e001", "2020-1", "p2", "j1", ["k0"]), ("e002", "2020-2", "p1", "j3", [])]  # ids that stand in two cells
    ev = spark.createDataFrame(rows, "eid string, created_at string, profile_id string, project_id string, spaces array<string>")
    pairs = Q.admitted(scopes, ev)
    wide = {(r[0], r[1]) for r in pairs.groupBy("request_id").count().collect()}
    assert {tuple(r) for r in Q.admitted_counts(scopes, ev).collect()} == wide
    first = {tuple(r) for r in Q.first_rows(pairs, ["created_at", "eid"], 3).select("request_id", "eid", "rank").collect()}
    assert {tuple(r) for r in Q.first_admitted(scopes, ev, ["created_at", "eid"], 3).select("request_id", "eid", "rank").collect()} == first
    kinds = Q._kinds(scopes)[0]
    assert kinds.count() == 4 and kinds.select("kind").distinct().count() == 3
