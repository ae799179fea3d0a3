"""Note projection: eligibility, links, rendering, reconciliation with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X

RANK = {"public": 0, "internal": 1, "private": 2, "secret": 3}
SHOWN = ("confirmed", "active", "superseded", "conflicted", "archived")
DIRECTORIES = {"project": "Projects", "decision": "Decisions", "requirement": "Requirements", "verification": "Verification", "conflict": "Conflicts", "artifact": "Artifacts", "research_note": "Research", "knowledge_index": "Knowledge"}


def eligible(ceiling: str = "internal") -> Column:
    """Records that may be written out: known class at or below the ceiling, current lifecycle."""
    top = RANK.get(ceiling, 99)
    if top >= RANK["secret"]:
        return F.lit(False)
    rank = F.when(F.col("sensitivity").isNull(), -1)
    for name, value in RANK.items():
        rank = rank.when(F.col("sensitivity") == name, value)
    return (rank.otherwise(99) <= top) & (F.col("lifecycle").isNull() | F.col("lifecycle").isin(*SHOWN))


def resolve_links(records: DataFrame, links: str, registry: DataFrame) -> DataFrame:
    """Every named link with its target note, or a neutral marker."""
    named = records.select("note_id", F.posexplode(X.link_list(F.col(links))).alias("pos", "resource_id"))
    return named.join(registry.select("resource_id", "note_path"), "resource_id", "left").select("note_id", "pos", "resource_id", F.coalesce("note_path", F.lit("(not available)")).alias("target"))


def note_path(kind: Column, title: Column, ident: Column) -> Column:
    folder = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in DIRECTORIES.items()])
    return F.concat(folder, F.lit("/"), X.slug(title), F.lit("-"), F.left(F.sha2(ident, 256), F.lit(8)), F.lit(".md"))


def _inline(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("(none)")), "[\r\n]+", " "), r"([\\\[\]`*_<>|#])", r"\\$1")


def render(kind: str, ident: Column, title: Column, fields: dict[str, Column]) -> Column:
    """A note: front matter, title, one line for each field."""
    head = F.concat(F.lit(f"---\ntype: {kind}\nid: "), ident, F.lit("\nmanaged: true\n---\n\n# "), _inline(title), F.lit("\n"))
    body = [F.concat(F.lit(f"\n- {name}: "), _inline(value)) for name, value in fields.items()]
    return F.concat(head, *body, F.lit("\n"))


def fingerprint(body: Column) -> Column:
    return F.sha2(F.when(body.contains("\r"), F.regexp_replace(body, "\r\n?", "\n")).otherwise(body), 256)


def ownership() -> Column:
    """What a file is, from ``on_disk, marker, listed, disk_fp, recorded_fp, wanted``."""
    c = F.col
    return (
        F.when(~c("on_disk"), "missing_expected_file")
        .when(~c("marker"), "human_owned")
        .when(~c("listed"), "unknown_ownership")
        .when(c("disk_fp") != c("recorded_fp"), "generated_human_modified")
        .when(~c("wanted"), "stale_generated")
        .otherwise("generated_unchanged")
    )


def reconcile(desired: DataFrame, manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """What happens to every note: a full outer join of wanted, recorded and present.

    ``desired(note_id, fp)``, ``manifest(note_id, recorded_fp)``,
    ``disk(note_id, disk_fp, marker)``.
    """
    rows = desired.withColumn("wanted", F.lit(True)).join(manifest.withColumn("listed", F.lit(True)), "note_id", "full_outer").join(disk.withColumn("on_disk", F.lit(True)), "note_id", "full_outer")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    rows = rows.withColumns({n: yes(n) for n in ("wanted", "listed", "on_disk", "marker")})
    rows = rows.withColumn("ownership", ownership())
    action = (
        F.when(F.col("wanted") & ~F.col("on_disk"), "create")
        .when(F.col("wanted") & F.col("ownership").isin("human_owned", "unknown_ownership"), "edit_conflict")
        .when(F.col("wanted") & (F.col("ownership") == "generated_human_modified"), F.when(F.col("fp") == F.col("recorded_fp"), "human_modified").otherwise("edit_conflict"))
        .when(F.col("wanted") & (F.col("fp") == F.col("disk_fp")), "unchanged")
        .when(F.col("wanted"), "update")
        .when(F.col("listed") & (F.col("ownership") == "stale_generated"), "retire")
        .when(F.col("listed") & ~F.col("on_disk"), "forget")
        .when(F.col("listed"), "preserve")
        .otherwise("ignore")
    )
    return rows.select("note_id", "ownership", action.alias("action"))


def siblings(actions: DataFrame, desired: DataFrame) -> DataFrame:
    """What an edit conflict writes: the wanted body in a new note beside the one a person changed."""
    beside = F.concat(F.regexp_replace("note_path", r"\.md$", ""), F.lit(".new.md"))
    return desired.join(actions.where("action = 'edit_conflict'").select("note_id"), "note_id", "left_semi").select("note_id", beside.alias("note_path"), "body")


def conflict_notes(records: DataFrame, ident: str, key: Column) -> DataFrame:
    """Conflicted records by explicit key; a record without a key stands alone."""
    own = F.coalesce(key, F.concat(F.lit("alone|"), F.col(ident)))
    return records.where(F.col("lifecycle") == "conflicted").groupBy(own.alias("conflict_key")).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id"))


def write_notes(notes: DataFrame, path: str) -> None:
    """Write changed notes as Parquet of (path, body); a sync tool lays them out as files."""
    notes.select("note_path", "body").write.mode("overwrite").parquet(path)
