"""Notes of every kind of record, and the manifest of what was written.

A note is rendered in its own row by column functions.  Notes about many rows (state
of a project, positions of a conflict, the conflict index) come in pages of about
``PAGE`` rows, dealt by hash, so that no task holds a whole project.  Missing fields
show as ``(none)``; a record without columns of its kind is rendered with nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import text as X
from cairn.operators.vault import DIRECTORIES, fingerprint
from cairn.scratch import exists, written

PAGE = 500
#: The fields that a note of each kind shows, in their order.
FIELDS = {
    "project": ("project_id", "charter_id", "name", "goal", "scope", "non_goals", "constraints", "architecture_principles", "success_criteria", "version", "lifecycle_status", "state"),
    "decision": ("decision_id", "statement", "project_id", "scope", "decision_key", "lifecycle_status", "state", "effective_at", "rationale_ref", "alternatives", "supersedes", "replaced_by"),
    "requirement": ("requirement_id", "statement", "project_id", "lifecycle_status", "state", "verification_status", "created_at", "supersedes", "replaced_by"),
    "verification": ("verification_id", "project_id", "subject_type", "subject_id", "method", "command_ref", "observed_result", "tested_commit", "verification_status", "timestamp", "artifact_references"),
}
#: The field that names a note.
TITLES = {"project": "name", "decision": "statement", "requirement": "statement", "verification": "verification_id"}
PROVENANCE = ("resource_id", "project_id", "profile_id", "session_id", "source_event_id", "trace_id")
BANNERS = {"conflicted": "An open conflict: no position is settled here.", "superseded": "Replaced by a later record.", "archived": "Kept for the record only."}


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _bullets(heading: str, fields: dict[str, Column]) -> Column:
    """A section with a line for each field.

    One expression escapes an array of the values: a copy for each field makes a method that the JVM never compiles.
    """
    labels = F.array(*[F.lit(f"- **{name.replace('_', ' ').capitalize()}:** ") for name in fields])
    values = F.transform(F.array(*fields.values()), lambda x: X.escape_inline(x))
    return F.concat(F.lit(f"## {heading}\n\n"), F.array_join(F.zip_with(labels, values, lambda a, b: F.concat(a, b)), "\n"))


def _note(df: DataFrame, kind: str, ident: Column, title: Column, sections: list[Column], keep: list[str]) -> DataFrame:
    """``note_id, note_kind, resource_id, project_id, note_path, body, fp`` of each row."""
    project, profile, life = _column(df, "project_id"), _column(df, "profile_id"), _column(df, "lifecycle_status")
    # A column of its own: it is used several times, and is computed once.
    df = df.withColumn("__digest", F.sha2(I.canonical_object({"kind": F.lit(kind), "profile_id": profile, "project_id": project, "resource_id": ident}), 256))
    digest = F.col("__digest")
    note_id = F.concat(F.lit(f"note-{kind}-"), F.left(digest, F.lit(16)))
    front = {"note_id": note_id, "kind": F.lit(kind), "resource_id": ident, "project_id": project, "profile_id": profile, "lifecycle_status": life}
    scalars = F.transform(F.array(*front.values()), lambda x: X.yaml_scalar(x))
    rows = F.zip_with(F.array(*[F.lit(f"{k}: ") for k in front]), scalars, lambda a, b: F.concat(a, b))
    head = F.concat(F.lit("---\nmanaged: true\n"), F.array_join(rows, "\n"), F.lit("\n---"))
    banner = F.coalesce(*[F.when(life == state, F.lit(f"> {text}")) for state, text in BANNERS.items()])
    source = _bullets("Provenance", {c: ident if c == "resource_id" else _column(df, c) for c in PROVENANCE})
    body = F.concat(F.concat_ws("\n\n", head, F.concat(F.lit("# "), X.escape_inline(title)), banner, *sections, source), F.lit("\n"))
    folder = lambda c, other: F.coalesce(F.nullif(X.slug(c), F.lit("")), F.lit(other))
    path = F.concat(F.lit(f"{DIRECTORIES[kind]}/"), folder(project, "unscoped"), F.lit("/"), folder(title, "note"), F.lit("-"), F.left(digest, F.lit(16)), F.lit(".md"))
    return df.select(*keep, note_id.alias("note_id"), F.lit(kind).alias("note_kind"), ident.alias("resource_id"), project.alias("project_id"), path.alias("note_path"), body.alias("body")).withColumn("fp", F.concat(F.lit("sha256:"), fingerprint(F.col("body"))))


def record_notes(records: DataFrame, kind: str) -> DataFrame:
    """One note for each decision, requirement, verification or project charter."""
    names = FIELDS[kind]
    ident = _column(records, names[0])
    record = _bullets("Record", {n: _column(records, n) for n in names})
    return _note(records, kind, ident, F.coalesce(_column(records, TITLES[kind]), ident), [record], [])


def paged(rows: DataFrame, keys: list[str], order: list[str], line: Column, size: int = PAGE) -> DataFrame:
    """``keys, page, pages, lines``: the lines of each key in pages of about ``size`` rows."""
    lines = written(rows.select(*keys, *[c for c in order if c not in keys], line.alias("line")), "lines")
    counts = written(lines.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("pages")), "pages")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    dealt = lines.alias("l").join(counts.alias("c"), on).select("l.*", "pages")
    page = F.pmod(F.xxhash64(*order), F.col("pages"))
    grouped = dealt.groupBy(*keys, "pages", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("sorted"))
    return grouped.select(*keys, "page", "pages", F.col("sorted.line").alias("lines"))


def _paged_notes(pages: DataFrame, kind: str, ident: Column, title: Column, heading: str) -> DataFrame:
    part = F.when(F.col("pages") > 1, F.concat(F.lit(" ("), (F.col("page") + 1).cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(")"))).otherwise("")
    body = F.concat(F.lit(f"## {heading}\n\n"), F.array_join("lines", "\n"))
    return _note(pages, kind, F.concat(ident, F.when(F.col("pages") > 1, F.concat(F.lit("#"), F.col("page").cast("string"))).otherwise("")), F.concat(title, part), [body], ["page", "pages"])


def state_notes(states: DataFrame, size: int = PAGE) -> DataFrame:
    """The current state of each project, a line for each active key."""
    cells = ("state_key", "state_value", "lifecycle_status", "verification_status", "effective_at")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[X.escape_inline(_column(states, c)) for c in cells]), F.lit(" |"))
    pages = paged(states.where(F.col("lifecycle_status") == "active"), ["project_id"], ["state_key"], line, size)
    return _paged_notes(pages, "project", F.concat(F.lit("state:"), F.coalesce("project_id", F.lit(""))), F.concat(F.coalesce("project_id", F.lit("unscoped")), F.lit(" state")), "Current state")


def conflict_note_pages(records: DataFrame, ident: str, key: Column, size: int = PAGE) -> DataFrame:
    """One note for each conflict, its positions listed by id; a record without a key stands alone."""
    own = records.where(F.col("lifecycle_status") == "conflicted").withColumn("conflict_key", F.coalesce(key, F.concat(F.lit("alone|"), F.col(ident))))
    fields = [c for c in FIELDS["decision"] if c in own.columns and c not in (ident, "project_id")]
    line = F.concat_ws("; ", F.concat(F.lit("- "), X.escape_inline(F.col(ident))), *[F.concat(F.lit(f"{c}: "), X.escape_inline(_column(own, c))) for c in fields])
    pages = paged(own, ["project_id", "conflict_key"], [ident], line, size).withColumn("lifecycle_status", F.lit("conflicted"))
    return _paged_notes(pages, "conflict", F.col("conflict_key"), F.concat(F.lit("Conflict: "), F.col("conflict_key")), "Positions")


def conflict_index(records: DataFrame, ident: str, key: Column, size: int = PAGE) -> DataFrame:
    """Pages of all open conflicts with the number of their positions."""
    own = records.where(F.col("lifecycle_status") == "conflicted")
    groups = own.groupBy(F.coalesce(key, F.concat(F.lit("alone|"), F.col(ident))).alias("conflict_key")).agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("all"))
    line = F.concat(F.lit("- "), X.escape_inline(F.col("conflict_key")), F.lit(": "), F.col("n").cast("string"), F.lit(" positions"))
    return _paged_notes(paged(groups, ["scope"], ["conflict_key"], line, size), "conflict", F.lit("conflict-index"), F.lit("Open conflicts"), "Open conflicts")


# --------------------------------------------------------------------- manifest

ENTRY = ("fp", "note_id", "note_kind", "note_path", "project_id", "resource_id", "status")
STATUSES = ("current", "human_modified", "edit_conflict", "retired")


def manifest_lines(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``note_id, line``: each entry as one line of canonical JSON, equal bytes for equal entries."""
    return entries.select("note_id", I.canonical_object({c: F.col(c) for c in ENTRY}, ascii_only).alias("line"))


def entry_fault() -> Column:
    """The first rule that an entry read back breaks, or null."""
    path = F.col("note_path")
    c = F.col
    return (
        F.when(~F.coalesce(c("note_id").rlike(r"^note-[a-z_]+-[0-9a-f]{16}\z"), F.lit(False)), "note_id")
        .when(~F.coalesce(c("fp").rlike(r"^sha256:[0-9a-f]{64}\z"), F.lit(False)), "fingerprint")
        .when(~F.coalesce(path.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*\z") & ~path.contains(".."), F.lit(False)), "path")
        .when(~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "status")
    )


def store_manifest(entries: DataFrame, path: str) -> bool:
    """Write the manifest unless the one there says the same; whether it was written."""
    from cairn.operators.relational import table_digest

    spark = entries.sparkSession
    lines = written(manifest_lines(entries), "manifest")
    if exists(spark, path) and table_digest(spark.read.text(path), ["value"]).first() == table_digest(lines.withColumnRenamed("line", "value"), ["value"]).first():
        return False
    lines.select("line").write.mode("overwrite").text(path)
    return True


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a stored manifest; none if there is no manifest, an error if one is unsound."""
    schema = ", ".join(f"{c} string" for c in ENTRY)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path)
    entries = raw.select("value", F.from_json("value", schema).alias("e")).select("value", "e.*").withColumn("fault", entry_fault())
    keys = F.array_sort(F.json_object_keys("value"))
    bad = entries.withColumn("fault", F.when(~F.coalesce(keys == F.array(*map(F.lit, ENTRY)), F.lit(False)), "keys").otherwise(F.col("fault"))).where("fault IS NOT NULL").agg(F.min("fault")).first()[0]
    if bad is not None:
        raise ValueError(f"unsound manifest: {bad}")
    return entries.select(*ENTRY)


def write_changes(desired: DataFrame, stored: DataFrame, path: str, number: int) -> DataFrame:
    """Write what differs from the notes last stored: ``note_id, change``.

    Notes of equal bytes are not written again; ``stored`` has ``note_id, fp`` and what
    it lists beyond ``desired`` is retired.  Bodies go to ``path/run=<number>``; a run
    that is repeated writes the same folder.
    """
    both = desired.select("note_id", "note_path", "body", "fp").join(stored.select("note_id", F.col("fp").alias("old")), "note_id", "full_outer")
    change = F.when(F.col("fp").isNull(), "retire").when(F.col("old").isNull(), "create").when(F.col("fp") != F.col("old"), "update").otherwise("unchanged")
    told = both.withColumn("change", change)
    told.where("change <> 'unchanged'").select("note_id", "note_path", "body", "change").write.mode("overwrite").parquet(f"{path}/run={number}")
    return told.select("note_id", "change")
