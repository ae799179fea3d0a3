"""Reads for a whole table of requests: composed scopes, joined with the rows they admit.

A scope is an AND over profiles, projects and spaces, each an OR over its values.  It is joined with the
rows by the values of its narrowest dimension only (profiles before projects before spaces) and the
others are tested on the joined pair, so the plan is equi-joins whose output is close to the result.
A row that several scopes of a request admit is kept once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import access as A
from cairn.scratch import written

SCOPE = ["request_id", "profiles", "projects", "spaces", "ownerless"]


def composed(requests: DataFrame, grants: DataFrame, kind: str) -> DataFrame:
    """``request_id, profiles, projects, spaces, ownerless``: the scopes of every admitted read.

    The base policy, and the grants that cover ``kind``, as ``access.compose`` has it for one request; an
    empty list admits any value, ``ownerless`` also admits rows without a profile.
    """
    c, none = F.col, F.array().cast("array<string>")
    named = lambda t: F.coalesce(F.collect_set(F.when(c("target_type") == t, c("target_id"))), none)
    held = A.read_grants(grants, resource_type=kind).groupBy(c("subject_profile").alias("requester")).agg(*(named(t).alias(f"by_{t}") for t in ("profile", "project", "knowledge_space", "global")))
    asked = A.decide(requests).where(c("operation") == A.READ).join(held, "requester", "left")
    by = {t: F.coalesce(c(f"by_{t}"), none) for t in ("profile", "project", "knowledge_space", "global")}
    something = F.size("profiles") + F.size("projects") + F.size("spaces") > 0
    granted = c("requester").isNotNull() & something & (sum((F.size(x) for x in by.values()), F.lit(0)) > 0)
    wide = F.size(by["global"]) > 0
    # What the base policy itself admits of the requested targets.
    base_projects, base_spaces = F.when(c("allow"), c("projects")).otherwise(none), F.when(c("allow"), c("spaces")).otherwise(none)
    admitted = lambda p: (p == c("requester")) | F.array_contains(by["profile"], p) | ((p == "*") & wide) | F.arrays_overlap("projects", by["project"])
    refused = F.exists("profiles", lambda p: ~F.coalesce(admitted(p), F.lit(False)))
    refused |= F.exists("projects", lambda p: ~(F.array_contains(base_projects, p) | F.array_contains(by["project"], p)))
    refused |= F.exists("spaces", lambda s: ~(F.array_contains(base_spaces, s) | F.array_contains(by["knowledge_space"], s)))
    ownerless = c("allow") & c("include_global") & ~c("isolated")
    scope = lambda profiles, projects, spaces, free: F.struct(profiles.alias("profiles"), projects.alias("projects"), spaces.alias("spaces"), free.alias("ownerless"))
    no = F.lit(False)
    base = scope(F.when(c("requester").isNull(), none).otherwise(F.array("requester")), c("projects"), c("spaces"), ownerless)
    mine = scope(F.array("requester"), c("projects"), c("spaces"), ownerless | wide)
    opened = F.concat(
        F.transform(F.filter(by["profile"], lambda x: x != "*"), lambda x: scope(F.array(x), none, none, no)),
        F.transform(by["project"], lambda x: scope(none, F.array(x), none, no)),
        F.transform(by["knowledge_space"], lambda x: scope(none, none, F.array(x), no)),
    )
    scopes = F.when(granted & ~refused, F.concat(F.array(mine), opened)).when(~granted & c("allow"), F.array(base))
    return asked.where(scopes.isNotNull()).select("request_id", F.inline(scopes))


def admitted(scopes: DataFrame, rows: DataFrame, ident: str = "eid") -> DataFrame:
    """``request_id`` and the columns of ``rows`` for every row that a scope of the request admits, once."""
    c = F.col
    named = F.size("profiles") > 0
    within = lambda value, names: (F.size(names) == 0) | F.coalesce(F.array_contains(names, value), F.lit(False))
    spaces = (F.size("want_spaces") == 0) | F.coalesce(F.arrays_overlap("want_spaces", "spaces"), F.lit(False))
    told = scopes.select("request_id", "profiles", "projects", c("spaces").alias("want_spaces"), "ownerless")
    wanted = rows.select(*rows.columns)
    columns = ["request_id", *rows.columns]

    by_profile = told.where(named).withColumn("key", F.explode(F.array_distinct("profiles")))
    out = by_profile.join(wanted.withColumn("key", c("profile_id")), "key").where(within(c("project_id"), "projects") & spaces).select(*columns)
    # Rows without an owner share one value; those that name a project or space meet by it first.
    free = told.where("ownerless").withColumn("rest", F.when(F.size("projects") > 0, "project").when(F.size("want_spaces") > 0, "space").otherwise("any"))
    open_rows = wanted.where("profile_id IS NULL")
    by_project = told.where(~named & ~c("ownerless") & (F.size("projects") > 0)).select(*told.columns)
    for scope, side in ((by_project, wanted), (free.where("rest = 'project'").select(*told.columns), open_rows)):
        out = out.unionByName(scope.withColumn("key", F.explode(F.array_distinct("projects"))).join(side.withColumn("key", c("project_id")), "key").where(spaces).select(*columns))
    by_space = told.where(~named & ~c("ownerless") & (F.size("projects") == 0) & (F.size("want_spaces") > 0))
    for scope, side in ((by_space, wanted), (free.where("rest = 'space'").select(*told.columns), open_rows)):
        out = out.unionByName(scope.withColumn("key", F.explode(F.array_distinct("want_spaces"))).join(side.withColumn("key", F.explode(F.array_distinct("spaces"))), "key").select(*columns))
    out = out.unionByName(free.where("rest = 'any'").select(*told.columns).withColumn("key", F.lit(True)).join(open_rows.withColumn("key", c("profile_id").isNull()), "key").select(*columns))
    return out.dropDuplicates(["request_id", ident])


CELL = ["profile_id", "project_id", "spaces"]


def _kinds(scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``request_id, kind`` and the scopes of each kind once: requests of equal scopes are of one kind."""
    lists = [F.array_sort(F.array_distinct(x)).alias(x) for x in ("profiles", "projects", "spaces")]
    each = scopes.groupBy("request_id").agg(F.array_sort(F.collect_set(F.struct(*lists, "ownerless"))).alias("scopes"))
    told = written(each.select("request_id", "scopes", F.sha2(F.to_json("scopes"), 256).alias("kind")), "kinds")
    kinds = told.groupBy("kind").agg(F.first("scopes").alias("scopes"))
    return told.select("request_id", "kind"), written(kinds.select(F.col("kind").alias("request_id"), F.inline("scopes")), "scopes")


def _cell() -> Column:
    """The name of a row's owner, project and spaces, which alone decide who reads it."""
    return F.sha2(F.to_json(F.struct("profile_id", "project_id", F.array_sort(F.array_distinct("spaces")).alias("spaces"))), 256)


def admitted_counts(scopes: DataFrame, rows: DataFrame, ident: str = "eid") -> DataFrame:
    """``request_id, n``: how many ids each request is admitted to; requests that meet no row have none.

    Pairs of requests and rows are never made: kinds of requests meet cells of rows.  An id in
    rows of several cells counts once, by the set of its cells.
    """
    asks, kinds = _kinds(scopes)
    told = rows.select(ident, *CELL, _cell().alias("cell"))
    cells = written(told.groupBy("cell").agg(*(F.first(c).alias(c) for c in CELL)), "cells")
    within = told.groupBy(ident).agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    sets = within.groupBy("cells").agg(F.count(ident).alias("n"))
    met = admitted(kinds, cells, "cell").select(F.col("request_id").alias("kind"), "cell")
    seen = met.join(sets.select("cells", "n", F.explode("cells").alias("cell")), "cell").select("kind", "cells", "n").distinct()
    return asks.join(seen.groupBy("kind").agg(F.sum("n").alias("n")), "kind").select("request_id", "n")


def first_admitted(scopes: DataFrame, rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """``request_id``, the columns of ``order`` and ``rank``: the first ``k`` rows of each request.

    Each cell of rows keeps its own first ones, kinds of requests meet cells, and requests
    get what their kind found.  Rows that agree in ``order`` are one.
    """
    asks, kinds = _kinds(scopes)
    told = rows.select(*CELL, *(c for c in order if c not in CELL), _cell().alias("cell"))
    by = lambda key: Window.partitionBy(key).orderBy(*(F.asc_nulls_last(c) for c in order))
    top = lambda df, key: df.withColumn("rank", F.dense_rank().over(by(key))).where(F.col("rank") <= k)
    own = top(told, "cell").select("cell", *order).distinct()
    cells = written(told.groupBy("cell").agg(*(F.first(c).alias(c) for c in CELL)), "cells")
    met = admitted(kinds, cells, "cell").select(F.col("request_id").alias("kind"), "cell")
    found = top(met.join(own, "cell").select("kind", *order).distinct(), "kind")
    return asks.join(found, "kind").select("request_id", *order, "rank")


def first_rows(pairs: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each request; each task keeps its own first ones before the shuffle."""
    by = Window.partitionBy("request_id").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
