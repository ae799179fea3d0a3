"""Typed edges: reading, mapping, bounded neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.scratch import written

FAN_OUT, MAX_NODES, MAX_EDGES, MAX_DEPTH = 20, 40, 80, 2
#: Relations of events that become typed edges; others are reported, never guessed.
MAPPED = {"derived_from": "derived_from", "supersedes": "supersedes"}


def related(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Depth-one neighbours: ``other_id, relation, direction``."""
    out = edges.where(F.col("from_id") == node).select(F.col("to_id").alias("other_id"), "relation", F.lit("out").alias("direction"))
    into = edges.where(F.col("to_id") == node).select(F.col("from_id").alias("other_id"), "relation", F.lit("in").alias("direction"))
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def classify_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with their mapped type, or the reason why they are left out."""
    known = nodes.select(F.col("eid").alias("from_id"), F.lit(True).alias("known"))
    mapped = F.coalesce(*[F.when(F.col("relation") == a, F.lit(b)) for a, b in MAPPED.items()])
    reason = F.when(mapped.isNull(), "unmapped_relation_type").when(F.col("from_id") == F.col("to_id"), "self_link").when(F.col("known").isNull(), "missing_endpoint")
    return relations.join(known, "from_id", "left").select("from_id", "relation", "to_id", mapped.alias("relation_type"), reason.alias("skip_reason"))


#: A side of up to so many nodes goes to every task.
SMALL = 200_000
#: The nodes that may be seen: a table of them, or a test of a node's name.
Allowed = DataFrame | Callable[[Column], Column]


def _small(nodes: DataFrame) -> DataFrame:
    """Written nodes, broadcast if they are few."""
    return F.broadcast(nodes) if nodes.count() <= SMALL else nodes


def _with_ids(edges: DataFrame) -> DataFrame:
    """Edges with ids; those that come without get them here, behind the filters."""
    return edges if "edge_id" in edges.columns else named(edges)


def _permitted(rows: DataFrame, node: str, allowed: Allowed | None) -> DataFrame:
    """Rows whose ``node`` is allowed; a table of nodes is cut to those of few rows before they meet."""
    if allowed is None:
        return rows
    if callable(allowed):
        return rows.where(allowed(F.col(node)))
    return rows.join(allowed.select(F.col("node").alias(node)), node, "left_semi")


def _capped(edges: DataFrame, frontier: DataFrame, out: bool, fan_out: int, allowed: Allowed | None) -> DataFrame:
    here, there = ("from_id", "to_id") if out else ("to_id", "from_id")
    # Hidden nodes are gone before any cap is counted.
    near = _permitted(edges.join(_small(frontier).select(F.col("node").alias(here)), here, "left_semi"), there, allowed)
    rank = F.row_number().over(Window.partitionBy(here).orderBy("relation", "edge_id"))
    return _with_ids(near).withColumn("rank", rank).where(F.col("rank") <= fan_out).select("edge_id", "from_id", "relation", "to_id", F.col(there).alias("next"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, allowed: Allowed | None = None, fan_out: int = FAN_OUT, depth: int = MAX_DEPTH) -> DataFrame:
    """``node, depth`` within ``depth`` hops of the seeds, with their least depth.

    Each node gives at most ``fan_out`` edges in each direction, in the order of
    relation and edge id; nodes that are not allowed never count.
    """
    seen = _permitted(seeds.select("node", F.lit(0).cast("long").alias("depth")), "node", allowed)
    frontier = written(seen.select("node").distinct(), "frontier")
    for hop in range(1, depth + 1):
        steps = _capped(edges, frontier, True, fan_out, allowed).unionByName(_capped(edges, frontier, False, fan_out, allowed))
        new = written(steps.select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(new.withColumn("depth", F.lit(hop).cast("long")))
        frontier = new
    return seen


def _first_steps(edges: DataFrame, nodes: DataFrame, allowed: Allowed, fan_out: int) -> DataFrame:
    """Each node's first edges in either direction: ``node, way, edge_id, from_id, relation, to_id, next, over``.

    ``over`` marks the one edge behind the cap, which only tells that there are more.
    """
    parts, near_nodes = [], _small(nodes)
    for way, (here, there) in enumerate((("from_id", "to_id"), ("to_id", "from_id"))):
        near = _permitted(edges, there, allowed) if callable(allowed) else edges
        near = near.join(near_nodes.select(F.col("node").alias(here)), here, "left_semi")
        near = _with_ids(near if callable(allowed) else _permitted(near, there, allowed))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(here).orderBy("relation", "edge_id"))).where(F.col("rank") <= fan_out + 1)
        parts.append(ranked.select(F.col(here).alias("node"), F.lit(way).alias("way"), "edge_id", "from_id", "relation", "to_id", F.col(there).alias("next"), (F.col("rank") > fan_out).alias("over")))
    return parts[0].unionByName(parts[1])


def subgraph(edges: DataFrame, seeds: DataFrame, allowed: Allowed, depth: int = MAX_DEPTH, fan_out: int = FAN_OUT, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> DataFrame:
    """One bounded neighbourhood for each seed: ``seed, authorized, nodes, edges, bound_codes``.

    Breadth first, a node's outgoing edges before its incoming ones, each by relation
    and edge id; the first ``max_nodes`` nodes and ``max_edges`` edges met are kept,
    and codes tell which bounds stopped the walk.  What is not allowed is gone before
    anything is counted; a hidden or unknown seed gives an empty result.  Bounds above
    the fixed ceilings are refused.  A seed's walk is at most ``fan_out`` squared times
    a few edges, so the windows over a seed are small whatever the degrees.

    An edge has two ends, so twice as many steps as edges that a bound needs hold enough
    different ones: only the nodes in front that have so many steps are expanded.  The
    nodes behind them are expanded for those seeds alone that have not met all nodes yet.
    """
    for name, value, top, least in (("depth", depth, MAX_DEPTH, 0), ("fan_out", fan_out, FAN_OUT, 1), ("max_nodes", max_nodes, MAX_NODES, 1), ("max_edges", max_edges, MAX_EDGES, 0)):
        if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= top:
            raise ValueError(f"{name} must be a whole number from {least} to {top}")
    asked = seeds.select(F.col("node").alias("seed")).distinct()
    if callable(allowed):
        known = edges.select("from_id", "to_id").where(allowed(F.col("from_id")) | allowed(F.col("to_id")))
        known = known.select(F.explode(F.array("from_id", "to_id")).alias("seed")).join(_small(written(asked, "asked")), "seed", "left_semi").distinct()
        start = written(asked.where(allowed(F.col("seed"))).join(known, "seed", "left_semi"), "start")
    else:
        start = written(asked.join(allowed.select(F.col("node").alias("seed")), "seed", "left_semi"), "start")
    met = F.struct(F.lit(0).alias("hop"), F.lit(0).alias("above"), F.lit(0).alias("way"), F.lit("").alias("relation"), F.lit("").alias("edge_id"))
    found = start.select("seed", F.col("seed").alias("node"), met.alias("met"))
    frontier = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("above"))
    steps = wides = None
    for hop in range(1, depth + 1):
        capped = written(_first_steps(edges, written(frontier.select("node").distinct(), "frontier"), allowed, fan_out), "capped")
        sizes = capped.groupBy("node").agg(F.count_distinct(F.when(~F.col("over"), F.col("edge_id"))).alias("size"), F.max("over").alias("wide"))
        before = F.sum("size").over(Window.partitionBy("seed").orderBy("above").rowsBetween(Window.unboundedPreceding, -1))
        sized = written(frontier.join(sizes, "node").withColumn("front", F.coalesce(before, F.lit(0)) < 2 * (max_edges + 1)), "sized")
        wide = sized.groupBy("seed").agg(F.max("wide").alias("wide"))
        wides = wide if wides is None else wides.unionByName(wide)
        order = F.struct(F.lit(hop).alias("hop"), "above", "way", "relation", "edge_id")
        inside = capped.where("NOT over")
        walked = written(sized.where("front").select("seed", "node", "above").join(inside, "node").select("seed", order.alias("met"), "edge_id", "from_id", "relation", "to_id", F.col("next").alias("node")), "steps")
        steps = walked if steps is None else steps.unionByName(walked)
        reached = lambda rows: rows.groupBy("seed", "node").agg(F.min("met").alias("met")).join(found.select("seed", "node"), ["seed", "node"], "left_anti")  # noqa: E731, B023
        new = written(reached(walked), "new")
        # Nodes behind count only where the ones in front leave open how many there are or how deep they lie.
        told = found.unionByName(new).groupBy("seed").agg(((F.count(F.lit(1)) > max_nodes) & (F.max("met.hop") >= hop)).alias("enough"))
        rest = sized.where("NOT front").join(told.where("NOT enough" if hop == depth else "true"), "seed", "left_semi").select("seed", "node", "above")
        more = rest.join(inside, "node").select("seed", F.col("next").alias("node"), order.alias("met"))
        new = written(new.unionByName(reached(more)).groupBy("seed", "node").agg(F.min("met").alias("met")), "new")
        found = found.unionByName(new)
        frontier = new.select("seed", "node", F.row_number().over(Window.partitionBy("seed").orderBy("met")).alias("above"))
    by_seed = Window.partitionBy("seed").orderBy("met")
    numbered = found.withColumn("n", F.row_number().over(by_seed))
    kept = F.when(F.col("n") <= max_nodes, F.struct("node", F.col("met.hop").cast("long").alias("depth")))
    out = numbered.groupBy("seed").agg(F.array_sort(F.collect_list(kept)).alias("nodes"), (F.max("n") > max_nodes).alias("more_nodes"), (F.max("met.hop") >= depth).alias("deep"))
    if steps is None:
        lines = start.select("seed", F.array().cast("array<struct<relation:string,edge_id:string,from_id:string,to_id:string>>").alias("edges"), F.lit(False).alias("more_edges"), F.lit(False).alias("wide"))
    else:
        each = steps.groupBy("seed", "edge_id", "from_id", "relation", "to_id").agg(F.min("met").alias("met")).withColumn("n", F.row_number().over(by_seed))
        line = F.when(F.col("n") <= max_edges, F.struct("relation", "edge_id", "from_id", "to_id"))
        lines = each.groupBy("seed").agg(F.array_sort(F.collect_list(line)).alias("edges"), (F.max("n") > max_edges).alias("more_edges"))
        lines = lines.join(wides.groupBy("seed").agg(F.max("wide").alias("wide")), "seed", "full_outer")
    told = asked.join(out, "seed", "left").join(lines, "seed", "left")
    code = lambda flag, name: F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(name))
    codes = F.array_compact(F.array(code("deep", "bound_max_depth"), code("more_edges", "bound_max_edges"), code("wide", "bound_max_fan_out"), code("more_nodes", "bound_max_nodes")))
    whole = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return told.select(
        "seed", F.col("nodes").isNotNull().alias("authorized"), whole("nodes", "array<struct<node:string,depth:bigint>>"),
        whole("edges", "array<struct<relation:string,edge_id:string,from_id:string,to_id:string>>"), codes.alias("bound_codes"),
    )


def verification_edges(checks: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``verifies`` edges of checks to what they name, or the reason why one is left out."""
    mapped = F.coalesce(*[F.when(F.col("subject_type") == a, F.lit(b)) for a, b in kinds.items()])
    reason = F.when(F.coalesce(F.col("subject_id"), F.lit("")) == "", "missing_endpoint").when(mapped.isNull(), "unmapped_subject_type")
    return checks.select(F.col("verification_id").alias("from_id"), F.lit("verifies").alias("relation"), mapped.alias("to_type"), F.col("subject_id").alias("to_id"), "verification_status", reason.alias("skip_reason"))


def typed_edges(*sources: tuple) -> DataFrame:
    """Edges of several tables: (rows with ``a`` and ``b``, from kind, relation, to kind, and what their names begin with if not with themselves).

    Repeats go while rows are pairs of bare keys; kinds and names are added behind that.
    """
    kinds: dict[tuple, list[DataFrame]] = {}
    for df, kind, relation, to, *begin in sources:
        pairs = df.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
        name = lambda c, n: F.concat(F.lit(begin[n]), F.col(c).cast("string")) if begin else F.col(c)  # noqa: E731, B023
        kinds.setdefault((kind, relation, to), []).append(pairs.select(name("a", 0).alias("from_id"), name("b", 1).alias("to_id")))
    out = None
    for (kind, relation, to), parts in kinds.items():
        pairs = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()
        part = pairs.select(F.lit(kind).alias("from_type"), "from_id", F.lit(relation).alias("relation"), F.lit(to).alias("to_type"), "to_id")
        out = part if out is None else out.unionByName(part)
    return out


def named(edges: DataFrame) -> DataFrame:
    """Edges with their deterministic ids."""
    from cairn.functions.identity import edge_id

    parts: dict[str, Column] = {c: F.col(c) for c in ("from_type", "from_id", "relation", "to_type", "to_id")}
    return edges.withColumn("edge_id", edge_id(parts, ascii_only=True))


def distances(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.min("depth").alias("relation_distance"))


def registry_row(df: DataFrame, name: str, columns: list[str], built: str = "published") -> DataFrame:
    """One row that publishes a derived table: its name, size, digest and status."""
    from cairn.operators.relational import table_digest

    return table_digest(df, columns).select(F.lit(name).alias("index_name"), "n_rows", "digest", F.lit(built).alias("status"))
