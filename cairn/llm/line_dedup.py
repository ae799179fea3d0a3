"""Line deduplication over levelled sorted runs of line hashes.

The store is a handful of runs.  A run is a Parquet table with one row for each
line key (two 64-bit hashes): how many documents hold the line and the largest
of their ids, sorted by hash within its parts.  A new batch of documents is
reduced to such rows and merge-anti-joined with the runs: rows whose key a run
has settled already (``min_docs`` documents or more, and none of the batch's ids
is larger) add nothing and are left out.  The rest becomes a run of level 0; as
soon as a level holds ``fanout`` runs, they are merged into one of the next
level.  So a row is rewritten a logarithmic number of times, and a hot line does
not grow the store with every batch.

``repeated_lines`` feeds a whole table through a store, batch by batch from the
largest ids down, and ``drop_repeated_lines`` then drops the lines whose key lies
in ``min_docs`` documents or more, but for the largest id that holds it.

Defined cases: a null or empty text is one empty line; lines whose key is
shorter than ``MIN_CHARS`` code points always stay; rows that share an id count
as one document; a null id counts as one document, smaller than all others; an
empty table gives an empty result; other columns pass through, whatever their
names.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import discard, fresh, let_go, materialise, scratch

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2

# Fixed value: the characters stripped from both ends of a line.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

RUN = "h1 long, h2 long, docs long, largest long"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The UTF-8 key of a line, or None if it is too short to count."""
    if len(line) < min_chars or len(bare := line.strip(BLANKS)) < min_chars:
        return None
    return bare.encode("utf-8").lower()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key)
    return _signed(d >> 64), _signed(d & 0xFFFFFFFFFFFFFFFF)


class LineStore:
    """Levelled sorted runs of line keys in the shared scratch folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def rows(self) -> DataFrame:
        """The rows of all runs: a key once for each run that holds it."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def totals(self) -> DataFrame:
        return self._merged(self.rows())

    def add(self, batch: DataFrame) -> None:
        """Take in ``h1, h2, doc_id``; an id's rows must come in one batch."""
        each = batch.select("h1", "h2", "doc_id").distinct()
        new = self._merged(each.select("h1", "h2", F.lit(1).cast("long").alias("docs"), F.col("doc_id").alias("largest")))
        if any(self.levels):
            settled = self.rows().where(F.col("docs") >= self.min_docs)
            same = (new.h1 == settled.h1) & (new.h2 == settled.h2)
            new = new.join(settled, same & (new.largest.isNull() | (settled.largest >= new.largest)), "left_anti")
        self._write(new, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(self.spark.read.schema(RUN).parquet(*old)), level + 1)
            for path in old:
                discard(self.spark, path)
            level += 1

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))

    def _write(self, run: DataFrame, level: int) -> None:
        path = scratch(self.spark, f"run{level}")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, uid, h1, h2, places``: each distinct key of each row's text."""

    def run(batches):
        let_go()
        for batch in batches:
            ids, uids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, uid, text in zip(ids, uids, batch.column(2), strict=True):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        found.setdefault(key, []).append(at)
                for key, places in found.items():
                    h1, h2 = key_hash(key)
                    for column, value in zip(out, (doc_id, uid, h1, h2, places), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "uid", "h1", "h2", "places"])

    return docs.mapInArrow(run, "doc_id long, uid long, h1 long, h2 long, places array<int>")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``doc_id, uid, drop``: the places of the lines that each text loses.

    ``uid`` is the hash of the text; rows without losses are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("uid"), F.col(text_col).cast("string").alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1_000)).first()[0] or []
    lines = line_hashes(rows, min_chars)
    number = sum([(F.coalesce(F.col("doc_id") <= F.lit(c), F.lit(True))).cast("int") for c in sorted(set(cuts))], F.lit(0))
    lines = materialise(lines.withColumn("batch", number), "lines", partition_by="batch")
    store = LineStore(spark, min_docs)
    for batch in range(len(set(cuts)) + 1):  # from the largest ids down
        store.add(lines.where(F.col("batch") == batch))
    # Written, so that the join below is between two plain shuffles and hot lines can be split.
    heavy = materialise(store.totals().where(F.col("docs") >= min_docs), "heavy")
    lost = lines.join(heavy, ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("largest")))
    return lost.groupBy("doc_id", "uid").agg(F.flatten(F.collect_set("places")).alias("drop"))


def _without(texts: pd.Series, drops: pd.Series) -> pd.Series:
    """The texts less the lines at the given places; null where there are none."""

    def kept(text, drop):
        if drop is None or text is None:
            return None
        gone = set(drop.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([kept(t, d) for t, d in zip(texts, drops, strict=True)], dtype=object)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated lines dropped from their texts.

    ``counts`` names two more columns: lines before dropping, lines dropped.
    """
    i, u, d = fresh(docs, "id", "uid", "drop")
    lost = repeated_lines(docs, id_col, text_col, min_docs).select(F.col("doc_id").alias(i), F.col("uid").alias(u), F.col("drop").alias(d))
    same = docs[id_col].cast("long").eqNullSafe(lost[i]) & (F.xxhash64(docs[text_col]) == lost[u])
    joined = docs.join(lost, same, "left")
    text = docs[text_col]
    changed = F.pandas_udf(_without, "string")(F.when(F.col(d).isNotNull(), text), F.col(d))
    new = F.when(F.col(d).isNotNull(), changed).otherwise(text)
    out = [new.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if counts:
        n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        out += [F.coalesce(n_lines, F.lit(1)).cast("long").alias(counts[0]), F.coalesce(F.size(d), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)
