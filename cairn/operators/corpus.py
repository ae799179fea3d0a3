"""The document corpus: units, dedup, versions, sharing, keywords, secret gate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import text as X
from cairn.scratch import written


def identify_units(units: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Add ``unit_id`` and ``content_hash`` to normalized units."""
    return units.withColumns({
        "unit_id": I.unit_id(F.col("source_ref"), F.col("location_id"), ascii_only),
        "content_hash": I.content_id(F.col("text"), F.coalesce(F.col("kind"), F.lit("text")) if "kind" in units.columns else F.lit("text"), ascii_only),
    })


def dedup_units(units: DataFrame, content: str = "content_hash", ident: str = "location_id") -> DataFrame:
    """``duplicate_of``: the first unit of the same source with the same content, if another.

    ``content`` is a hash (pass texts as one: it is what gets shuffled).  Units are made and shuffled once; the first
    is carried along the lines, so a content that stands often is streamed.  Null contents and sources repeat nothing.
    """
    along = Window.partitionBy(content, "source_ref").orderBy("line_no")
    first = F.first(ident).over(along)
    known = F.col(content).isNotNull() & F.col("source_ref").isNotNull()
    return units.withColumn("__first", first).withColumn("duplicate_of", F.when(known & (F.col("__first") != F.col(ident)), F.col("__first"))).drop("__first")


def shared_content(units: DataFrame, content: str = "content_hash") -> DataFrame:
    """Contents that more than one source holds."""
    return units.select(content, "source_ref").distinct().groupBy(content).agg(F.count(F.lit(1)).alias("sources")).where("sources > 1")


def version_chain(records: DataFrame) -> DataFrame:
    """Versions of each source in order: what each supersedes, and the content before it.

    A version that repeats an id is the same version; unchanged content names no
    predecessor.  Repeats are dropped by a pre-aggregated minimum; a source's chain is
    cut into ordered ranges, and each range's last version is carried to the next, so
    no task holds a whole source.
    """
    rest = [c for c in records.columns if c != "version_id"]
    once = records.groupBy("version_id").agg(F.min_by(F.struct(*rest), "position").alias("r")).select("version_id", "r.*")
    return carried_lag(once, "source_id", ["position", "version_id"], "version_id", "content_hash")


def carried_lag(rows: DataFrame, key: str, order: list[str], ident: str, content: str) -> DataFrame:
    """``supersedes`` and ``predecessor_content_hash`` of each row: the row of its key before it."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(width, key, *order).withColumn("__range", F.spark_partition_id()), "chain")
    last = ranged.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__at")).agg(F.max_by(F.struct(F.col(ident).alias("i"), F.col(content).alias("h")), F.struct(*order)).alias("__last"))
    along = Window.partitionBy("__key").orderBy("__at")
    carried = last.select("__key", "__at", F.lag("__last").over(along).alias("__carried"))
    chain = Window.partitionBy(key, "__range").orderBy(*order)
    local = ranged.withColumn("__lag", F.lag(F.struct(F.col(ident).alias("i"), F.col(content).alias("h"))).over(chain))
    known = local.join(carried, local[key].eqNullSafe(carried["__key"]) & (F.col("__range") == F.col("__at")))
    before = F.coalesce("__lag", "__carried")
    return known.select(*rows.columns, before["i"].alias("supersedes"), F.when(before["h"] != F.col(content), before["h"]).alias("predecessor_content_hash"))


def _versioned(rows: DataFrame, ascii_only: bool) -> DataFrame:
    """Rows with the ids of source, content and version, each with the version before it."""
    ids = rows.withColumn("content_hash", I.source_content_hash(F.col("content"))).drop("content").withColumn("source_id", I.source_id(ascii_only))
    ids = ids.withColumn("version_id", I.source_version_id(F.col("source_id"), F.col("content_hash"), ascii_only))
    return carried_lag(ids, "source_id", ["position"], "version_id", "content_hash")


def register_sources(registry: DataFrame, batch: DataFrame, ascii_only: bool = False) -> DataFrame:
    """What a batch of registrations adds: ``position, source_id, version_id, outcome, ...``.

    Both sides have ``external_ref, kind, profile_id, project_id, knowledge_space_id,
    content`` and a ``position`` in one order, the registry's before the batch's.
    Content equal to the latest of its source is that ``existing`` version; any other is
    ``registered`` and names the version that it supersedes, even one that returns to an
    older content.  Nulls in a scope are scopes of their own; a null content has no
    bytes and counts as an empty one.
    """
    columns = ["external_ref", "kind", *I.SCOPE, "position"]
    side = lambda df, new: df.select(*columns, F.coalesce("content", F.lit("")).alias("content"), F.lit(new).alias("new"))
    chained = _versioned(side(registry, False).unionByName(side(batch, True)), ascii_only)
    same = F.coalesce(F.col("supersedes") == F.col("version_id"), F.lit(False))
    told = chained.where("new").withColumn("outcome", F.when(same, "existing").otherwise("registered"))
    return told.withColumn("supersedes", F.when(~same, F.col("supersedes"))).drop("new")


def rebind_version(registry: DataFrame, change: DataFrame) -> DataFrame:
    """The registry with the rows of ``change`` in place of their versions; unknown versions are added."""
    keys = ["source_id", "version_id"]
    return registry.join(change.select(*keys), keys, "left_anti").unionByName(change)


def rekey_legacy(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Records of an older registry under the ids of now, none left out.

    The old ``source_id`` and ``content_hash`` stay as ``legacy_source_id`` and
    ``legacy_content_hash``; each record names the version before it and its content.
    """
    old = records.withColumnsRenamed({"source_id": "legacy_source_id", "content_hash": "legacy_content_hash"})
    chained = _versioned(old.withColumn("content", F.coalesce("content", F.lit(""))), ascii_only)
    before = F.when(F.col("supersedes").isNotNull(), F.coalesce("predecessor_content_hash", "content_hash"))
    return chained.withColumn("predecessor_content_hash", before)


def latest_sources(records: DataFrame) -> DataFrame:
    """The last record of each source: a pre-aggregated maximum."""
    rest = [c for c in records.columns if c != "source_id"]
    return records.groupBy("source_id").agg(F.max_by(F.struct(*rest), "position").alias("r")).select("source_id", "r.*")


def secret_gate(units: DataFrame, body: str = "text") -> DataFrame:
    """Add the secret rule that a unit breaks and whether it may be published."""
    rule = X.secret_rule(F.col(body))
    return units.withColumn("rule", rule).withColumn("accepted", F.col("rule").isNull())


def extracted(sources: DataFrame, composed: bool = False) -> DataFrame:
    """Normalized units of ``source_ref, text`` and scope columns, with the secret rule that each breaks."""
    from cairn.sources.text_units import units_of_text

    # Composition makes no white space and no text empty, so units of collapsed lines stay collapsed.
    lines = units_of_text(sources)
    return secret_gate(lines if composed else lines.withColumn("text", X.nfc(F.col("text"))))


def first_lines(units: DataFrame) -> DataFrame:
    """The accepted of ``units`` with ``first``, the line of the first of them with the same source and text.

    The units of a source must lie together and in order, as those of distinct sources do where they are extracted.
    So nothing is shuffled, and a task holds the hashes of one source.  Units are left out by having no first, which
    depends on the rows before: a filter by their rule would be moved before the texts and make them again for each rule.
    """

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        source, seen = None, {}
        for refs, numbers, hashes in parts:
            out = []
            for ref, n, h in zip(refs, numbers.tolist(), hashes, strict=True):
                if ref != source:
                    source, seen = ref, {}
                out.append(None if h is None else seen.setdefault(h, n))
            yield pd.Series(out, dtype="Int32")

    told = F.when(F.col("accepted"), F.unhex(F.sha2("text", 256)))
    first = F.pandas_udf(run, "int").asNondeterministic()
    return units.withColumn("first", first("source_ref", "line_no", told)).where("first IS NOT NULL")


def project_corpus(sources: DataFrame, composed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources to units, edges and a report: extract, normalize, identify, gate, drop repeats.

    ``sources`` has ``source_ref, text`` and scope columns.  A unit that holds a secret
    is left out before repeats are looked for, so nothing can stand for a hidden unit;
    repeats stay as rows that name their first.  The report counts sources, sources
    without any unit, units, rejected units, repeats and edges.
    """
    gated = written(identify_units(extracted(sources, composed)), "units")
    units = written(dedup_units(gated.where("accepted").drop("rule", "accepted")), "kept")
    edges = corpus_edges(units)  # a plain projection of written units
    given, parts = sources.select("source_ref").distinct(), gated.select("source_ref").distinct()
    counted = {"sources": given, "empty_sources": given.join(parts, "source_ref", "left_anti"), "units": units, "rejected": gated.where("NOT accepted"), "repeats": units.where("duplicate_of IS NOT NULL"), "edges": edges}
    report = None
    for name, rows in counted.items():
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        report = row if report is None else report.unionByName(row)
    return units, edges, report


def keyword_enrichment(units: DataFrame, ident: str = "unit", body: str = "text", top: int = 8) -> DataFrame:
    """Top words and word pairs of each unit with their share of the top's count.

    Units that hold a secret have none.  A unit's terms are all in its row, so an
    Arrow function counts them there, row by row; nothing is shuffled.
    """
    safe = units.where(X.secret_rule(F.col(body)).isNull()).select(F.col(ident).alias("unit"), X.keywords(F.col(body)).alias("kept"))

    def count(batches):
        for batch in batches:
            rows, terms, numbers, ranks, weights = [], [], [], [], []
            for i, kept in enumerate(batch.column(1)):
                words = kept.as_py() or []
                counts = Counter(words)
                counts.update(map(" ".join, zip(words, words[1:], strict=False)))
                best = nsmallest(top, counts.items(), key=lambda x: (-x[1], x[0]))
                total = sum(n for _, n in best)
                rows += [i] * len(best)
                terms += [t for t, _ in best]
                numbers += [n for _, n in best]
                ranks += range(1, len(best) + 1)
                weights += [n / total for _, n in best]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(numbers, pa.int64()), pa.array(ranks, pa.int32()), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["unit", "term", "n", "rank", "weight"])

    return safe.mapInArrow(count, f"unit {safe.schema['unit'].dataType.simpleString()}, term string, n long, rank int, weight double")


def quality_gate(docs: DataFrame, body: str = "text", least: int = 500, garbage: float = 0.3) -> DataFrame:
    """Whether extracted text is long and clean enough."""
    share = X.garbage_share(F.col(body))
    reason = F.when(F.length(body) < least, "too_short").when(share > garbage, "garbage")
    return docs.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def corpus_edges(units: DataFrame) -> DataFrame:
    """``source_of`` from a source to each unit, ``derived_from`` from a copy to its first."""
    own = units.select(F.col("source_ref").alias("from_id"), F.lit("source_of").alias("relation"), F.col("location_id").alias("to_id"))
    copies = units.where(F.col("duplicate_of").isNotNull()).select(F.col("location_id").alias("from_id"), F.lit("derived_from").alias("relation"), F.col("duplicate_of").alias("to_id"))
    return own.unionByName(copies)


def semantic_rank(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """Vectors by cosine to a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding")
    score = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return vectors.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit)
