"""Row-level access: policy, grants, scope algebra, secured reads.

A scope becomes one ``Column`` that is applied before any ranking or limit, so
rows outside it cannot influence what is returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ, WRITE = "READ", "WRITE"


@dataclass(frozen=True)
class Scope:
    """Profiles, projects and spaces that must all admit a row; empty means any.

    ``kinds`` are the resource types that it opens, for rows that tell their own; None opens all.
    """

    profiles: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    spaces: tuple[str, ...] = ()
    global_read: bool = False
    is_grant: bool = False
    requester: str | None = None
    kinds: tuple[str, ...] | None = None

    def predicate(self) -> Column:
        parts = [self._profile()]
        if self.kinds is not None:
            parts.append(F.col("resource_type").isin(*self.kinds))
        if self.projects:
            parts.append(F.col("project_id").isin(*self.projects))
        if self.spaces:
            parts.append(F.arrays_overlap("spaces", F.array(*map(F.lit, self.spaces))))
        return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts if p is not None], F.lit(True))

    def _profile(self) -> Column | None:
        own = F.col("profile_id")
        if self.global_read:
            names = sorted({*self.profiles, *([self.requester] if self.requester else [])})
            return own.isin(*names) | own.isNull() if names else own.isNull()
        if self.profiles:
            return own.isin(*self.profiles)
        if self.is_grant or self.requester is None:
            return None
        return own == self.requester


def any_of(scopes: list[Scope]) -> Column:
    """Rows that at least one complete scope admits, each row once."""
    return reduce(lambda a, b: a | b, [s.predicate() for s in scopes], F.lit(False))


# ------------------------------------------------------------------ base policy


@dataclass(frozen=True)
class Request:
    operation: str
    requester: str | None = None
    profiles: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    spaces: tuple[str, ...] = ()
    include_global: bool = False
    isolated: bool = False


def decide(requests: DataFrame) -> DataFrame:
    """``reason`` and ``allow`` for a table of requests, by the ordered base policy."""
    c = F.col
    some = lambda name: F.size(name) > 0
    write, bound = c("operation") == WRITE, c("requester").isNotNull()
    nothing = ~some("profiles") & ~some("projects") & ~some("spaces")
    own_only = c("profiles") == F.array(c("requester"))
    foreign = F.exists("profiles", lambda p: ~p.eqNullSafe(c("requester")))
    unbound = (
        F.when(~nothing | write, "DENY_UNBOUND_PROTECTED")
        .when(c("isolated") & c("include_global"), "DENY_ISOLATED_SCOPE_ESCAPE")
        .when(c("include_global") & ~c("isolated"), "ALLOW_GLOBAL_READ")
        .otherwise("DENY_UNBOUND_PROTECTED")
    )
    known = (
        F.when(c("isolated") & nothing, "DENY_ISOLATED_SCOPE_ESCAPE")
        .when(c("isolated") & some("spaces") & ~some("profiles") & ~some("projects"), "DENY_ISOLATED_SCOPE_ESCAPE")
        .when(foreign & write, "DENY_CROSS_PROFILE_WRITE")
        .when(foreign, "DENY_CROSS_PROFILE_READ")
        .when(~own_only & some("projects"), "DENY_CROSS_PROJECT")
        .when(write & own_only, "ALLOW_LOCAL_WRITE")
        .when(write, "DENY_GLOBAL_WRITE")
        .when(own_only, "ALLOW_LOCAL_PROFILE_READ")
        .when(c("include_global") & ~c("isolated"), "ALLOW_GLOBAL_READ")
        .otherwise("ALLOW_LOCAL_PROFILE_READ")
    )
    out = requests.withColumn("reason", F.when(~c("operation").isin(READ, WRITE), "DENY_INVALID_REQUEST").when(bound, known).otherwise(unbound))
    return out.withColumn("allow", c("reason").startswith("ALLOW"))


def policy_audit(decided: DataFrame) -> DataFrame:
    """The decisions that are put on record: every denial, and what only a grant allowed."""
    by_grant = F.col("reason").startswith("ALLOW_EXPLICIT_CROSS_PROFILE_READ") | F.col("reason").startswith("ALLOW_EXPLICIT_CROSS_PROFILE_WRITE")
    return decided.where(~F.col("allow") | by_grant)


def evaluate(r: Request) -> tuple[bool, Scope]:
    """The base policy for one request: whether it is allowed, and its scope."""
    nothing = not (r.profiles or r.projects or r.spaces)
    if r.operation not in (READ, WRITE):
        return False, Scope()
    if r.requester is None:
        ok = nothing and r.operation == READ and r.include_global and not r.isolated
        return ok, Scope(global_read=ok)
    own = tuple(r.profiles) == (r.requester,)
    denied = (r.isolated and (nothing or (r.spaces and not r.profiles and not r.projects))) or any(p != r.requester for p in r.profiles)
    denied = denied or (not own and r.projects) or (r.operation == WRITE and not own)
    if denied:
        return False, Scope()
    return True, Scope((r.requester,) if own else (), tuple(r.projects), tuple(r.spaces), r.include_global and not r.isolated and r.operation == READ, False, r.requester)


# ----------------------------------------------------------------------- grants


def active_grants(grants: DataFrame) -> DataFrame:
    """Grants in force: active, not revoked, and not superseded by another."""
    gone = grants.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("grant_id"))
    live = (F.col("lifecycle_status") == "active") & (F.col("state").isNull() | (F.col("state") != "revoked"))
    return grants.where(live).join(gone, "grant_id", "left_anti")


def covers(resource_type: str) -> Column:
    """Grants without a list of resource types cover all of them."""
    return F.col("resource_types").isNull() | F.coalesce(F.array_contains(F.from_json("resource_types", "array<string>"), resource_type), F.lit(False))


def read_grants(grants: DataFrame, subject: str | None = None, resource_type: str | None = None) -> DataFrame:
    out = active_grants(grants).where(F.col("operation") == READ)
    if subject is not None:
        out = out.where(F.col("subject_profile") == subject)
    return out.where(covers(resource_type)) if resource_type else out


def write_grants(grants: DataFrame, verifications: DataFrame, accepted: tuple[str, ...] = ("verified",)) -> DataFrame:
    """For each subject and target: the one write grant, ``conflict``, or why none."""
    live = active_grants(grants).where(F.col("operation") == WRITE)
    by_target = live.groupBy("subject_profile", "target_type", "target_id").agg(F.count(F.lit(1)).alias("n_grants"), F.min("grant_id").alias("grant_id"), F.min("verification_ref").alias("verification_ref"))
    checked = by_target.join(verifications.select(F.col("verification_id").alias("verification_ref"), "verification_status"), "verification_ref", "left")
    outcome = (
        F.when(F.col("n_grants") > 1, "conflict").when(F.col("verification_ref").isNull(), "unverified").when(F.coalesce(F.col("verification_status").isin(*accepted), F.lit(False)), "granted").otherwise("unverified")
    )
    return checked.select("subject_profile", "target_type", "target_id", "n_grants", F.when(F.col("n_grants") == 1, F.col("grant_id")).alias("grant_id"), outcome.alias("outcome"))


def latest_grants(events: DataFrame) -> DataFrame:
    """Replay of grant operations: a grant's fields from its last operation that set them."""
    from pyspark.sql import Window

    last = Window.partitionBy("grant_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in events.columns if c not in ("grant_id", "position", "op")]
    state = F.last(F.when(F.col("op") == "revoke", "revoked").when(F.col("op") == "create", "enabled"), ignorenulls=True).over(last)
    filled = [F.last(F.col(c), ignorenulls=True).over(last).alias(c) for c in fields]
    rows = events.select("grant_id", "position", *filled, state.alias("state"), F.row_number().over(Window.partitionBy("grant_id").orderBy(F.desc("position"))).alias("rn"))
    gone = events.where((F.col("op") == "supersede") & F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("grant_id")).distinct().withColumn("superseded", F.lit(True))
    out = rows.where("rn = 1").join(gone, "grant_id", "left")
    return out.select("grant_id", *fields, "state", F.when(F.col("superseded"), "superseded").otherwise("active").alias("lifecycle_status"))


def compose(request: Request, grants: list[dict], kind: str | None = None) -> tuple[bool, list[Scope]]:
    """Requested scopes that policy or a grant admits.

    Without grants the base policy stands.  With grants, one requested target that
    neither admits denies the whole request; each grant adds a scope of its own.
    Grants that do not cover ``kind`` count for nothing; without a kind, a grant's scope is kept to the
    resource types that it names, and one that names any opens no rows without an owner.
    """
    allowed, base = evaluate(request)
    types = lambda g: g.get("resource_types")
    mine = [g for g in grants if g["operation"] == READ and g["subject_profile"] == request.requester and (kind is None or types(g) is None or kind in types(g))]
    by = {kind: {g["target_id"] for g in mine if g["target_type"] == kind} for kind in ("profile", "project", "knowledge_space", "global")}
    if request.operation != READ or not any(by.values()):
        return allowed, [base] if allowed else []
    if not (request.profiles or request.projects or request.spaces):
        return allowed, [base] if allowed else []
    wide = bool({g["target_id"] for g in mine if g["target_type"] == "global" and (kind or types(g) is None)})
    admitted = {request.requester, *by["profile"]}
    denied = {p for p in request.profiles if not (p in admitted or (p == "*" and wide) or set(request.projects) & by["project"])}
    denied |= {p for p in request.projects if p not in base.projects and p not in by["project"]}
    denied |= {s for s in request.spaces if s not in base.spaces and s not in by["knowledge_space"]}
    if denied:
        return False, []
    own = Scope(tuple(sorted({request.requester} & set(request.profiles or [request.requester]))), request.projects, request.spaces, base.global_read or wide, False, request.requester)
    scopes = [own]
    for g in mine:
        target_type, target = g["target_type"], g["target_id"]
        kinds = None if kind or types(g) is None else tuple(types(g))
        if target_type == "profile" and target != "*":
            scopes.append(Scope(profiles=(target,), is_grant=True, kinds=kinds))
        elif target_type == "project":
            scopes.append(Scope(projects=(target,), is_grant=True, kinds=kinds))
        elif target_type == "knowledge_space":
            scopes.append(Scope(spaces=(target,), is_grant=True, kinds=kinds))
    return True, scopes


def collect_grants(grants: DataFrame, subject: str, kind: str | None = None, limit: int = 1_000) -> list[dict]:
    """The grants of one requester, of those that cover ``kind`` if one is given, a list that a person can hold; more is an error."""
    types = F.from_json("resource_types", "array<string>").alias("resource_types")
    rows = read_grants(grants, subject, kind).select("grant_id", "subject_profile", "operation", "target_type", "target_id", types).orderBy("grant_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many grants for one requester")
    return [r.asDict() for r in rows]


# ---------------------------------------------------------------- secured reads


def secured(df: DataFrame, scopes: list[Scope]) -> DataFrame:
    return df.where(any_of(scopes))


def whole_or_nothing(df: DataFrame, key: str, scopes: list[Scope]) -> DataFrame:
    """Groups all of whose rows are in scope; one hidden row withholds its group."""
    hidden = df.where(~any_of(scopes)).select(key).distinct()
    return df.join(hidden, key, "left_anti")


def whole_relations(relations: DataFrame, seeds: DataFrame, visible: DataFrame) -> DataFrame:
    """``seed`` and its relations, for seeds none of whose relations has a hidden end.

    One hidden end withholds all of a seed's relations: what is left would tell of it.
    """
    touched = relations.withColumn("seed", F.explode(F.array_distinct(F.array("from_id", "to_id")))).join(seeds.select(F.col("eid").alias("seed")), "seed", "left_semi")
    ends = touched.select("seed", F.explode(F.array("from_id", "to_id")).alias("eid"))
    hidden = ends.join(visible.select("eid"), "eid", "left_anti").select("seed").distinct()
    return touched.join(hidden, "seed", "left_anti")


def corpus_scope(triples: list[tuple]) -> Column:
    """Units that a (profile, project, space) triple admits.

    Three blanks admit rows without any owner; elsewhere a blank admits any value.
    """

    def one(triple):
        names = ("profile_id", "project_id", "space_id")
        if not any(triple):
            return reduce(lambda a, b: a & b, [F.col(n).isNull() for n in names])
        return reduce(lambda a, b: a & b, [F.coalesce(F.col(n) == v, F.lit(False)) for n, v in zip(names, triple, strict=True) if v is not None])

    return reduce(lambda a, b: a | b, map(one, triples), F.lit(False))


def corpus_graph_scope(triples: list[tuple]) -> Column:
    """Like ``corpus_scope``, but a blank admits only rows that have none there."""
    names = ("profile_id", "project_id", "space_id")
    one = lambda t: reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, t, strict=True)])
    return reduce(lambda a, b: a | b, map(one, triples), F.lit(False))


def owners(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (profile, project) owners of two tables."""
    pair = ["profile_id", "project_id"]
    return units.select(*pair).distinct().union(edges.select(*pair).distinct()).distinct()


def authorize_writes(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write requests for one target each: by the base policy, by a grant, or denied.

    ``requests`` has ``request_id, requester, target_type, target_id``; ``outcomes``
    comes from ``write_grants``.
    """
    told = requests.join(outcomes.withColumnRenamed("subject_profile", "requester"), ["requester", "target_type", "target_id"], "left")
    own = (F.col("target_type") == "profile") & (F.col("target_id") == F.col("requester"))
    reason = (
        F.when(F.col("requester").isNull(), "DENY_UNBOUND_PROTECTED")
        .when(own, "ALLOW_LOCAL_WRITE")
        .when(F.col("outcome") == "granted", "ALLOW_EXPLICIT_CROSS_PROFILE_WRITE")
        .when(F.col("outcome") == "conflict", "DENY_POLICY_CONFLICT")
        .otherwise("DENY_CROSS_PROFILE_WRITE")
    )
    return told.select("request_id", reason.alias("reason"), reason.startswith("ALLOW").alias("allow"))


def scope_triples(scopes: list[Scope]) -> list[tuple]:
    """The (profile, project, space) triples that scopes spell out; a blank where a scope names none.

    A scope for global reads adds the triple of rows without any owner.
    """
    out: set[tuple] = set()
    for s in scopes:
        own = s.profiles or ((s.requester,) if s.requester and not s.is_grant else ())
        out |= {(a, b, c) for a in own or (None,) for b in s.projects or (None,) for c in s.spaces or (None,) if a or b or c}
        if s.global_read:
            out.add((None, None, None))
    return sorted(out, key=lambda t: tuple(x or "" for x in t))


def with_owner_columns(df: DataFrame) -> DataFrame:
    """Records that lack an owner's column have none there."""
    kinds = {"profile_id": "string", "project_id": "string", "spaces": "array<string>"}
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in df.columns})


def secured_records(df: DataFrame, scopes: list[Scope]) -> DataFrame:
    """Records of any kind that a scope admits, columns unchanged."""
    return with_owner_columns(df).where(any_of(scopes)).select(*df.columns)


def secured_facts(facts: DataFrame, owners: DataFrame, scopes: list[Scope]) -> DataFrame:
    """Times of the resources that a scope admits; ``owners`` has ``resource_type, resource_id`` and owners' columns."""
    admitted = secured_records(owners, scopes).select("resource_type", "resource_id").distinct()
    return facts.join(admitted, ["resource_type", "resource_id"], "left_semi")


def linked_recheck(rows: DataFrame, link: str, targets: DataFrame, target_id: str, scopes: list[Scope]) -> DataFrame:
    """Links to targets out of scope become null, so that no id of a hidden row leaves."""
    seen = secured_records(targets, scopes).select(F.col(target_id).alias("__target")).distinct()
    out = rows.join(seen, rows[link] == seen["__target"], "left")
    return out.withColumn(link, F.when(F.col("__target").isNotNull(), F.col(link))).drop("__target")


def validated(df: DataFrame, scopes: list[Scope]) -> DataFrame:
    """Rows as they leave; one outside every scope is an error, as a last check behind the filter."""
    checked = with_owner_columns(df)
    ok = F.when(any_of(scopes), True).otherwise(F.raise_error(F.lit("a row outside its scope was about to be returned")).cast("boolean"))
    return checked.where(ok).select(*df.columns)
