"""Delta sync of the corpus: only sources that changed are extracted again.

Sources lie in hash buckets, each bucket with a version, and each source tells the segment that holds its units.  A sync
compares the digests of the given sources with those it holds, projects the new and the changed ones by the code of a
whole projection, and writes their units as a segment.  Units of changed and removed sources stay in their segments,
where no source points to them, until half of a segment is such or as many sources as it has come anew: then the sync
writes what is left of it with its own.  So what is written follows the change, and what lies there is at most twice
the corpus.  Repeats are elected within a source, so each source's first is elected anew with its units.  A sync
without changes writes nothing; one that runs again under its number writes the same.

A unit is written as a line and the line of its first.  Ids, hashes and edges follow from these and are told on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.corpus import corpus_edges, extracted, first_lines, identify_units
from cairn.scratch import discard, temporary, written
from cairn.streaming.maintained import Store

TABLES = {
    "sources": "source_ref string, digest binary, segment long",
    "units": "source_ref string, line_no int, location_id string, raw_text string, text string, unit_id string, content_hash string, duplicate_of string",
}
#: A unit as it is written: ``text`` only where it differs from the raw one, ``first`` only where it is another line.
STORED = "source_ref string, line_no int, raw_text string, text string, first int"
#: Bits for each reference in the filter that texts meet before they are shuffled; words of 2^15 bits, 8 MB at most.
BITS, WORD, WORDS = 16, 1 << 15, 2_048


def store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    return Store(spark, root, buckets, {"sources": TABLES["sources"]}, {"sources": "source_ref"})


def sync(held: Store, sources: DataFrame, number: int) -> dict[str, int]:
    """Bring the store to ``sources`` (``source_ref, text``): how many were new, changed, removed and unchanged.

    Of repeated references the least digest stands for the source; null references are left out.
    """
    with temporary(held.spark):
        return _sync(held, sources.where("source_ref IS NOT NULL").select("source_ref", "text"), number)


def _sync(held: Store, sources: DataFrame, number: int) -> dict[str, int]:
    versions = held.manifest(number)
    given = sources.select("source_ref", _digest()).groupBy("source_ref").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("rows"))
    known = held.read("sources", versions).withColumnRenamed("digest", "before")
    state = F.when(F.col("before").isNull(), "new").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("before"), "changed").otherwise("unchanged")
    told = written(given.join(known, "source_ref", "full_outer").select("source_ref", "digest", "rows", "segment", state.alias("state")), "compared")
    seen = told.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).collect()
    counts = dict.fromkeys(("new", "changed", "removed", "unchanged"), 0) | {r["state"]: r["n"] for r in seen}
    held.touched = {"sources": sorted(int(b) for b in versions.get("sources", {})), "units": []}
    if counts["unchanged"] == sum(counts.values()):
        return counts
    _sweep(held, number)

    # Units: the new ones, and what is left of segments that are written again.
    same, n_fresh = told.where("state = 'unchanged'"), counts["new"] + counts["changed"]
    before = {int(s): n for s, (n, _) in versions.get("units", {}).items()}
    live = {r["segment"]: r["count"] for r in same.groupBy("segment").count().collect()}
    again = _again(before, live, n_fresh)
    fresh, parts = told.where("state IN ('new', 'changed')").select("source_ref", "digest"), []
    if n_fresh:
        whole = counts["unchanged"] == 0 and max(r["most"] or 0 for r in seen) == 1
        parts.append(_lines(sources if whole else _texts(sources, fresh, n_fresh)))
    if again:
        parts.append(_segments(held, again).join(same.select("source_ref", "segment"), ["source_ref", "segment"], "left_semi").drop("segment"))
    versions["units"] = {str(s): [before[s], n] for s, n in live.items() if s not in again}
    if parts:
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{held.root}/units/segment={number}")
        versions["units"][str(number)] = [n_fresh + sum(live[s] for s in again)] * 2

    # Sources: the buckets of what moved, all of them if units moved to another segment.
    buckets = list(range(held.buckets)) if again else held.keys(told.where("state <> 'unchanged'"), sources=F.array("source_ref"))["sources"]
    place = F.when((F.col("state") == "unchanged") & ~F.col("segment").isin(*again), F.col("segment")).otherwise(F.lit(number).cast("long"))
    for b in buckets:  # a bucket may have become empty
        versions.get("sources", {}).pop(str(b), None)
    held.write("sources", told.where("state <> 'removed'").where(held.bucket("source_ref").isin(*buckets)).withColumn("segment", place), number, versions)
    held.touched["units"] = again
    held.seal(number, versions)
    return counts


def _digest():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")


def _texts(sources: DataFrame, fresh: DataFrame, n: int) -> DataFrame:
    """The texts of ``fresh``, told by reference and digest, once each.

    A broadcast bit for each reference keeps nearly all other texts out of the shuffle; more references than it has
    room for only let more of them through.
    """
    words = min(WORDS, -(-n * BITS // WORD))
    bit = F.pmod(F.xxhash64("source_ref"), F.lit(words * WORD))
    word, place = F.shiftright(bit, 15).cast("int"), bit.bitwiseAND(F.lit(WORD - 1))
    bits = fresh.groupBy(word.alias("word")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.bit_get(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    near = sources.withColumn("word", word).join(F.broadcast(bits), "word").where(held)
    return near.select("source_ref", "text", _digest()).join(fresh, ["source_ref", "digest"], "left_semi").dropDuplicates(["source_ref", "digest"])


def _lines(texts: DataFrame) -> DataFrame:
    """Units of distinct sources as they are written; nothing is shuffled."""
    units = first_lines(extracted(texts.select("source_ref", "text")))
    return units.select("source_ref", "line_no", "raw_text", F.nullif("text", "raw_text").alias("text"), F.nullif("first", "line_no").alias("first"))


def _again(before: dict[int, int], live: dict[int, int], fresh: int) -> list[int]:
    """Segments to be written again, by the sources that they had and those that they still have: with half of them
    gone, and from the smallest on while a segment has no more than what is written anyway, so that sizes stay apart."""
    out = [s for s, n in live.items() if 2 * n <= before[s]]
    size = fresh + sum(live[s] for s in out)
    for n, s in sorted((n, s) for s, n in live.items() if s not in out):
        if n > size:
            break
        out.append(s)
        size += n
    return sorted(out)


def _sweep(held: Store, number: int) -> None:
    """Delete what the sync before ``number`` replaced."""
    held.sweep(number)
    for segment in held.manifest(number - 1).get("units", {}).keys() - held.manifest(number).get("units", {}).keys():
        discard(held.spark, f"{held.root}/units/segment={segment}")


def _segments(held: Store, segments: list) -> DataFrame:
    paths = [f"{held.root}/units/segment={s}" for s in segments]
    kind = f"{STORED}, segment long"
    return held.spark.read.schema(kind).option("basePath", f"{held.root}/units").parquet(*paths) if paths else held.spark.createDataFrame([], kind)


def units(held: Store) -> DataFrame:
    """All units; segments of which a source is gone are held against the sources."""
    versions = held.manifest()
    segments = versions.get("units", {})
    rows = _segments(held, [s for s, (n, live) in segments.items() if n == live])
    if partly := [s for s, (n, live) in segments.items() if n != live]:
        now = held.read("sources", versions).select("source_ref", "segment")
        rows = rows.unionByName(_segments(held, partly).join(now, ["source_ref", "segment"], "left_semi").select(*rows.columns))
    at = lambda line: F.concat(F.col("source_ref"), F.lit("#L"), F.col(line).cast("string"))
    rows = rows.withColumns({"location_id": at("line_no"), "text": F.coalesce("text", "raw_text"), "duplicate_of": at("first")})
    return identify_units(rows).select(*[f.split()[0] for f in TABLES["units"].split(", ")])


def edges(held: Store) -> DataFrame:
    return corpus_edges(units(held))
