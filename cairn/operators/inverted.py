"""A written inverted index: segments of a batch each, merged in levels, read by term.

A posting row holds a term of a column, a block of documents, their ids and the places of the term in each, the
number of documents and the largest frequency in the block.  A document's block is told by its id, so the rows of
several terms meet block by block and are intersected as arrays, beginning with the rarest term; only phrases and
nearness meet document by document, so that no document is looked for along its block.  Rows lie in buckets by term, sorted, so a search reads the buckets of its terms and
a prefix the stretch of terms it covers.

A batch writes one segment.  Its documents are dealt by block, once, as they are; a block's words are gathered where it
lies, so tokens are never shuffled and no key, however frequent its word, goes to one task.  Whenever ``FANOUT`` segments of a level have gathered, they become one of the next level,
without the documents deleted by then; deletions after that are a list of ids that hits are held against.  A
manifest for each batch tells the segments, so a batch that runs again writes the same.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators.search import Condition, QueryError
from cairn.scratch import exists, written

#: Buckets of terms, documents and characters of a block (about), and segments of a level.
BUCKETS, BLOCK, BLOCK_CHARS, FANOUT = 32, 2_048, 1 << 24, 4
ROW = "term string, block int, n int, most int, ids array<string>, places array<array<int>>"
MARK = "\x1f"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _blocks(docs: int, chars: int) -> int:
    return max(1, -(-docs // BLOCK), -(-chars // BLOCK_CHARS))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")


def _blocked(each: DataFrame, blocks: int) -> DataFrame:
    """Rows from ``term, id, at``, one for each term of a document."""
    entry = F.struct("id", "at")
    rows = each.groupBy("term", _block(blocks).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.max(F.size("at")).alias("most"))
    return rows.select("term", "block", F.size("e").alias("n"), "most", F.col("e.id").alias("ids"), F.col("e.at").alias("places"))


def _gathered(columns: list[str]):
    """Rows from one block of documents: ``block, id`` and the words of each column."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks().dictionary_encode()
        sort = pc.sort_indices(ids.dictionary).to_numpy()
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        named, own = ids.dictionary.take(pa.array(sort)), rank[ids.indices.to_numpy()]
        parts = []
        for k, c in enumerate(columns):
            lists = table.column(f"words{k}").combine_chunks()
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            word, doc = words.indices.to_numpy(), np.repeat(own, n)
            at = (np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            order = np.lexsort((at, doc, word))
            word, doc, at = word[order], doc[order], at[order]
            entry = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])
            size = np.diff(np.r_[entry, len(at)])
            term = np.flatnonzero(np.r_[True, word[entry][1:] != word[entry][:-1]])
            upto = pa.array(np.r_[term, len(entry)].astype(np.int32))
            places = pa.ListArray.from_arrays(pa.array(np.r_[entry, len(at)].astype(np.int32)), pa.array(at))
            parts.append(pa.table({
                "term": pc.binary_join_element_wise(c + MARK, words.dictionary.take(pa.array(word[entry[term]])), ""),
                "block": pa.repeat(pa.scalar(table.column("block")[0].as_py(), pa.int32()), len(term)),
                "n": pa.array(np.diff(np.r_[term, len(entry)]).astype(np.int32)),
                "most": pa.array(np.maximum.reduceat(size, term).astype(np.int32)),
                "ids": pa.ListArray.from_arrays(upto, named.take(pa.array(doc[entry]))),
                "places": pa.ListArray.from_arrays(upto, places),
            }))
        return pa.concat_tables(parts) if parts else _NONE

    return run


_INTS = pa.list_(pa.int32())
_NONE = pa.table({"term": pa.array([], pa.string()), "block": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "most": pa.array([], pa.int32()), "ids": pa.array([], pa.list_(pa.string())), "places": pa.array([], pa.list_(_INTS))})


class Index:
    """An index under ``root`` over text columns; ``fold`` reads letters without accents."""

    def __init__(self, spark: SparkSession, root: str, columns: list[str], fold: bool = True, buckets: int = BUCKETS):
        self.spark, self.root, self.columns, self.fold, self.buckets = spark, root.rstrip("/"), columns, fold, buckets

    # ------------------------------------------------------------------ writing

    def segments(self, before: int | None = None) -> list[dict]:
        """``name, level, docs, blocks`` of the segments after the last batch (below ``before``)."""
        folder = f"{self.root}/manifest"
        if not exists(self.spark, folder):
            return []
        own = f"{folder}/batch={before - 1}" if before else None
        rows = self.spark.read.schema("number long, text string").json(own if own and exists(self.spark, own) else folder)
        rows = rows if before is None else rows.where(F.col("number") < before)
        last = rows.orderBy(F.desc("number")).limit(1).collect()
        return json.loads(last[0]["text"]) if last else []

    def add(self, docs: DataFrame, ident: str, number: int, deleted: DataFrame | None = None) -> None:
        """Take in a batch of documents, none of which came before, and the ids (``id``) deleted by it."""
        segments = self.segments(number)
        if deleted is not None:
            deleted.select(F.col("id").cast("string").alias("id")).write.mode("overwrite").parquet(f"{self.root}/deleted/batch={number}")
        text = lambda c: X.fold_accents(F.col(c)) if self.fold else F.col(c)
        size = reduce(lambda x, y: x + y, [F.coalesce(F.length(c), F.lit(0)) for c in self.columns])
        n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        given = docs.select(F.col(ident).cast("string").alias("id"), *[F.col(c).alias(f"text{k}") for k, c in enumerate(self.columns)]).where("id IS NOT NULL")
        dealt = given.withColumn("block", _block(_blocks(n, chars))).repartition("block").sortWithinPartitions("block")
        words = dealt.select("block", "id", *[X.tokens(text(f"text{k}")).alias(f"words{k}") for k in range(len(self.columns))])
        segments.append(self._write(f"b{number}", 0, words.groupBy("block").applyInArrow(_gathered(self.columns), ROW), n, chars))
        level = 0
        while len(group := [s for s in segments if s["level"] == level]) >= FANOUT:
            segments = [s for s in segments if s["level"] != level]
            rows = self._rows(group).select("term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("places").alias("at"))))
            gone = self._deleted(number)
            rows = rows if gone is None else rows.join(gone, "id", "left_anti")
            n, chars = (sum(s.get(k, 0) for s in group) for k in ("docs", "chars"))
            rows = _blocked(rows, _blocks(n, chars)).repartition("block")
            segments.append(self._write(f"m{number}-{level + 1}", level + 1, rows, n, chars))
            level += 1
        row = self.spark.createDataFrame([(number, json.dumps(segments))], "number long, text string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/batch={number}")

    def _write(self, name: str, level: int, rows: DataFrame, docs: int, chars: int) -> dict:
        """Each task writes its blocks to all buckets: as many files in a bucket as tasks, each sorted."""
        sorted_ = rows.withColumn("bucket", _bucket(F.col("term"), self.buckets)).sortWithinPartitions("bucket", "term", "block")
        sorted_.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/{name}")
        return {"name": name, "level": level, "docs": docs, "chars": chars, "blocks": _blocks(docs, chars)}

    # ------------------------------------------------------------------ reading

    def _deleted(self, upto: int | None = None) -> DataFrame | None:
        if not exists(self.spark, f"{self.root}/deleted"):
            return None
        rows = self.spark.read.schema("id string, batch long").parquet(f"{self.root}/deleted")
        return (rows if upto is None else rows.where(F.col("batch") <= upto)).select("id").distinct()

    def _rows(self, segments: list[dict], buckets: list[int] | None = None) -> DataFrame:
        out = None
        for s in segments:
            base = f"{self.root}/postings/{s['name']}"
            paths = [base] if buckets is None else [p for b in buckets if exists(self.spark, p := f"{base}/bucket={b}")]
            if paths:
                one = self.spark.read.schema(ROW).parquet(*paths).withColumn("segment", F.lit(s["name"]))
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{ROW}, segment string")

    def bucket_of(self, terms: list[str]) -> list[int]:
        if not terms:
            return []
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return sorted({r[0] for r in rows.select(_bucket(F.col("term"), self.buckets)).collect()})

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each term (column, mark and word) stands."""
        rows = self._rows(self.segments(), self.bucket_of(terms)).where(F.col("term").isin(*terms))
        return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def find(self, condition: Condition) -> DataFrame:
        """``id`` of every document that a composed condition matches."""
        search = _Search(self)
        hits = search.evaluate(condition).select(F.explode(F.col("e.id")).alias("id")).distinct()
        gone = self._deleted()
        return hits if gone is None else hits.join(gone, "id", "left_anti")

    def find_or(self, words: list[str]) -> DataFrame:
        """``id, match_mode``: documents that hold every word in some column, or any of them if none holds all."""
        from cairn.operators import search as S

        parts = [S.term(w) for w in sorted(set(words))]
        strict = written(self.find(S.all_of(*parts)), "strict")
        if len(parts) < 2 or not strict.isEmpty():
            return strict.withColumn("match_mode", F.lit("strict"))
        return self.find(S.any_of(*parts)).withColumn("match_mode", F.lit("any_term"))

    def counts(self, words: list[str], column: str) -> DataFrame:
        """``id, n``: how often these words stand in a column of each document that holds one of them."""
        terms = [column + MARK + w for w in words]
        rows = self._rows(self.segments(), self.bucket_of(terms)).where(F.col("term").isin(*terms))
        each = rows.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.transform("places", F.size).alias("n"))))
        return each.groupBy("id").agg(F.sum("n").cast("long").alias("n"))


class _Search:
    """The evaluation of one condition: each part becomes ``segment, block, e``, e being ids with places."""

    def __init__(self, index: Index):
        self.index, self.segments = index, index.segments()
        self.often: dict[str, int] = {}

    def evaluate(self, condition: Condition) -> DataFrame:
        kind, *rest = condition.plan
        if kind == "run":
            words, by_prefix, first, column = rest
            return self._any([self._run(c, words, by_prefix, first) for c in self._columns(column)])
        if kind == "near":
            runs, room, column = rest
            return self._any([self._near(c, runs, room) for c in self._columns(column)])
        if kind == "any":
            return self._any([self.evaluate(p) for p in rest[0]])
        if kind == "all":
            parts = sorted(rest[0], key=self._size)
            return reduce(self._both, [self.evaluate(p) for p in parts])
        wanted, others = rest
        return reduce(self._without, [self.evaluate(p) for p in others], self.evaluate(wanted))

    def _columns(self, column: str | None) -> list[str]:
        if column is not None and column not in self.index.columns:
            raise QueryError(f"no column {column!r}")
        return [column] if column else self.index.columns

    def _size(self, condition: Condition) -> float:
        """About how many documents a part matches, from the frequencies of its words."""
        kind, *rest = condition.plan
        if kind == "run":
            words, by_prefix, _, column = rest
            terms = [[c + MARK + w for w in (words[:-1] if by_prefix else words)] for c in self._columns(column)]
            if missing := [t for own in terms for t in own if t not in self.often]:
                self.often |= dict.fromkeys(missing, 0) | self.index.frequencies(missing)
            return sum(min((self.often[t] for t in own), default=1e9) for own in terms)
        if kind == "near":
            return 1e6
        if kind == "but_not":
            return self._size(rest[0])
        return (min if kind == "all" else sum)(self._size(p) for p in rest[0])

    def _term(self, column: str, word: str, by_prefix: bool) -> DataFrame:
        term = column + MARK + word
        entries = F.arrays_zip(F.col("ids").alias("id"), F.col("places").alias("at")).alias("e")
        if not by_prefix:
            rows = self.index._rows(self.segments, self.index.bucket_of([term]))
            return rows.where(F.col("term") == term).select("segment", "block", entries)
        rows = self.index._rows(self.segments).where((F.col("term") >= term) & F.col("term").startswith(term))
        return self._any([rows.select("segment", "block", entries)])

    def _any(self, parts: list[DataFrame]) -> DataFrame:
        """A block's entries once, with all their places."""
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        rows = rows.groupBy("segment", "block").agg(F.flatten(F.collect_list("e")).alias("e"))
        places = lambda i: F.array_sort(F.flatten(F.transform(F.filter("e", lambda x: x["id"] == i), lambda x: x["at"])))
        ids = F.array_distinct(F.col("e.id"))
        merged = F.transform(ids, lambda i: F.struct(i.alias("id"), places(i).alias("at")))
        return rows.select("segment", "block", F.when(F.size(ids) == F.size("e"), F.col("e")).otherwise(merged).alias("e"))

    @staticmethod
    def _both(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.join(b.withColumnRenamed("e", "other"), ["segment", "block"])
        other = F.col("other.id")
        e = F.filter("e", lambda x: F.array_contains(other, x["id"]))
        return met.select("segment", "block", e.alias("e")).where(F.size("e") > 0)

    @staticmethod
    def _without(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.join(b.withColumnRenamed("e", "other"), ["segment", "block"], "left")
        other = F.coalesce(F.col("other.id"), F.array().cast("array<string>"))
        return met.select("segment", "block", F.filter("e", lambda x: ~F.array_contains(other, x["id"])).alias("e")).where(F.size("e") > 0)

    def _run(self, column: str, words: list[str], by_prefix: bool, first: bool) -> DataFrame:
        """Documents with the words side by side; ``at`` are the places of the first one."""
        out = None
        order = sorted(range(len(words)), key=lambda i: self._size_of(column, words[i]) if not (by_prefix and i == len(words) - 1) else 1e9)
        for i in order:
            rows = self._term(column, words[i], by_prefix and i == len(words) - 1)
            rows = rows.select("segment", "block", self._shifted(i).alias("e"))
            out = rows if out is None else self._adjacent(out, rows)
        if first:
            out = out.select("segment", "block", F.filter("e", lambda x: F.array_contains(x["at"], 0)).alias("e"))
        return out.where(F.size("e") > 0)

    def _size_of(self, column: str, word: str) -> int:
        term = column + MARK + word
        if term not in self.often:
            self.often[term] = self.index.frequencies([term]).get(term, 0)
        return self.often[term]

    @staticmethod
    def _shifted(by: int) -> Column:
        """Entries with the places that lie so many tokens before."""
        return F.transform("e", lambda x: F.struct(x["id"].alias("id"), F.filter(F.transform(x["at"], lambda p: p - by), lambda p: p >= 0).alias("at")))

    @staticmethod
    def _entries(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("segment", "block", F.inline("e")).select("segment", "block", "id", F.col("at").alias(name))

    @staticmethod
    def _regrouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("segment", "block").agg(F.collect_list(F.struct("id", "at")).alias("e"))

    def _adjacent(self, a: DataFrame, b: DataFrame) -> DataFrame:
        met = self._entries(a, "at").join(self._entries(b, "other"), ["segment", "block", "id"])
        return self._regrouped(met.withColumn("at", F.array_intersect("at", "other")).where(F.size("at") > 0))

    def _near(self, column: str, runs: list[list[str]], room: int) -> DataFrame:
        """Documents in which all runs lie within ``room`` tokens: some window's start suits each of them."""
        met = self._entries(self._run(column, runs[0], False, False), "at")
        starts = lambda places, run: F.array_distinct(F.flatten(F.transform(places, lambda q: F.sequence(q - (room - len(run)), q))))
        met = met.withColumn("starts", starts("at", runs[0]))
        for run in runs[1:]:
            met = met.join(self._entries(self._run(column, run, False, False), "other"), ["segment", "block", "id"])
            met = met.withColumn("starts", F.array_intersect("starts", starts("other", run))).where(F.size("starts") > 0).drop("other")
        return self._regrouped(met)
