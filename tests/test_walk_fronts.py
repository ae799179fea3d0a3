"""Walks that expand only the nodes in front, and those behind where they matter."""

import pytest

from cairn.operators import graph as G
from tests.test_stores import _walk


@pytest.mark.parametrize("bounds", [(2, 20, 40, 80), (2, 20, 40, 5), (2, 20, 3, 5), (2, 20, 25, 5)])
def test_nodes_behind_the_front_count(spark, bounds):
    """Most nodes lead to one hub by many edges; only the last ones lead on, behind more steps than any bound of edges."""
    edges = [(f"s{i:02}", "seed", "a", f"m{i:02}") for i in range(20)]
    edges += [(f"h{i:02}-{j:02}", f"m{i:02}", "b", "hub") for i in range(18) for j in range(12)]
    edges += [(f"t{i:02}-{j:02}", f"m{i:02}", "c", f"far{i}-{j}") for i in (18, 19) for j in range(22)]
    edges += [("x0", "lone", "a", "end")]
    df = spark.createDataFrame(edges, "edge_id string, from_id string, relation string, to_id string")
    seeds = spark.createDataFrame([("seed",), ("lone",), ("unknown",), ("hid",)], "node string")
    open_names = lambda node: ~node.startswith("hid")
    names = {n for e in edges for n in (e[1], e[3])}
    table = spark.createDataFrame([(n,) for n in names], "node string")
    for allowed in (open_names, table):
        for r in G.subgraph(df, seeds, allowed, *bounds).collect():
            want = _walk(edges, r["seed"], {"unknown", "hid"}, *bounds)
            assert (r["authorized"], [tuple(n) for n in r["nodes"]], [(e["relation"], e["edge_id"]) for e in r["edges"]], sorted(r["bound_codes"])) == want


def test_edges_without_ids_are_named_behind_the_filters(spark):
    plain = spark.createDataFrame([("t", f"n{i}", "r", "t", f"n{i * 2}") for i in range(1, 9)], "from_type string, from_id string, relation string, to_type string, to_id string")
    seed = spark.createDataFrame([("n2",)], "node string")
    hidden = lambda node: ~node.endswith("8")
    got = {tuple(r) for r in G.neighbourhood(plain, seed, hidden, fan_out=1).collect()}
    assert got == {tuple(r) for r in G.neighbourhood(G.named(plain), seed, hidden, fan_out=1).collect()} == {("n2", 0), ("n4", 1), ("n1", 1)}
