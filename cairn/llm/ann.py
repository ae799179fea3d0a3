"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.
It sends a unit vector to the nearest of the 2d signed axes.  A table joins several
rotations to one code, the last one over fewer axes, so that the code has as many
bits as ``code_bits`` gives: they grow half as fast as those of the number of vectors,
so a query's share of the vectors falls as a table grows.  A query probes, in each of
``TABLES`` tables, the joint codes that it is nearest to (least sum of squared gaps to
its best axes); their number grows slowly with that of the vectors (``probe_count``), so
that recall does not fall.  Whatever lies there is a candidate and is ranked
exactly, by cosine in double precision.  A query that finds fewer than k this way is
compared with all vectors of its length, so a list is short only where there are
fewer than k others.

Equal vectors form a class that is hashed once.  As a query can only return its
k nearest, a class keeps its k + 1 least ids: the others could not appear.  A table's
codes are dealt into slices of about ``CHUNK`` vectors; a slice that holds far more (a
hot code) is dealt into chunks of candidates and of queries, and every pair of chunks
is searched by a task of its own.  A query goes to a slice once, with all its codes
there.

Measured recall against brute force and candidates for each query are in the README.

Defined cases: vectors that are null, empty, all zero, or hold a null or
non-finite component take no part, and neither do rows with a null id; rows that
repeat id and vector count once; rows with the query's id are never its
neighbours; vectors of different length are never neighbours; ties go to the
smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._common import materialise

TABLES = 16
ROUNDS = 3
SEED = 7
NEIGHBOURS = 5
#: Vectors of a slice or a chunk of candidates, and of a chunk of queries.
CHUNK = 8_192
#: Cells whose sizes are broadcast at most; more of them are joined by a shuffle.
GRID = 1_000_000
#: Pairs of a query and a candidate that are compared at once.
PAIRS = 262_144


def code_bits(vectors: int) -> int:
    """Bits of a table's code for so many vectors: 11 for 500, 14 for 50,000, 20 for 10^8."""
    return max(2, round(log2(max(1, vectors)) / 2 + 6.4))


def probe_count(vectors: int) -> int:
    """Probes of a table for so many vectors: 80 up to 2,048 of them, twice as many for each 2,048-fold."""
    return round(80 * 2 ** (max(0.0, log2(max(1, vectors)) - 11) / 11))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row."""
    n, width = x.shape[1], 1
    while width < n:
        pairs = x.reshape(len(x), -1, 2, width)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """The joint codes of all tables for one dimension."""

    def __init__(self, dim: int, tables: int, bits: int, seed: int = SEED):
        self.dim, self.size = dim, 1 << max(0, dim - 1).bit_length()
        whole = self.size.bit_length()  # bits of one rotation: an axis and its sign
        full, rest = divmod(bits, whole)
        self.axes = [self.size] * full + ([1 << (rest - 1)] if rest else [])
        signs = np.random.default_rng(seed).integers(0, 2, (tables, len(self.axes), ROUNDS, self.size))
        self.signs = np.where(signs == 1, 1.0, -1.0)

    def rotated(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """The axes of each of the table's rotations."""
        unit = np.zeros((len(x), self.size))
        unit[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for rounds, axes in zip(self.signs[table], self.axes, strict=True):
            r = unit
            for signs in rounds:
                r = hadamard(r * signs)
            out.append(r[:, :axes])
        return out

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for r in self.rotated(x, table):
            axis = np.abs(r).argmax(axis=1)
            code = code * (2 * r.shape[1]) + 2 * axis + (r[np.arange(len(r)), axis] < 0)
        return code

    def probes(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The codes of the ``probes`` least sums of squared gaps to the best axes, in no order."""
        gaps = codes = np.zeros((len(x), 1))
        codes = codes.astype(np.int64)
        for r in self.rotated(x, table):
            both = np.stack([r, -r], axis=2).reshape(len(r), -1)
            gap = (both.max(axis=1, keepdims=True) - both) ** 2
            own = np.broadcast_to(np.arange(gap.shape[1]), gap.shape)
            gap, own = self._least(gap, own, probes)
            width = 2 * r.shape[1]
            gaps = (gaps[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * width + own[:, None, :]).reshape(len(x), -1)
            gaps, codes = self._least(gaps, codes, probes)
        return codes

    @staticmethod
    def _least(gaps: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if gaps.shape[1] <= n:
            return gaps, codes
        at = np.argpartition(gaps, n - 1, axis=1)[:, :n]
        return np.take_along_axis(gaps, at, 1), np.take_along_axis(codes, at, 1)


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = np.asarray(column.value_lengths())
    flat, begins = np.asarray(column.flatten(), np.float64), np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[(begins[rows][:, None] + np.arange(d))]))
    return out


def _slice_of(codes: np.ndarray, slices: int) -> np.ndarray:
    """Codes dealt over slices by a multiplicative hash."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(slices)).astype(np.int32)


def _hashed(rows: DataFrame, tables: int, asked: bool, probes: int | None, counts: dict[int, int], chunk: int) -> DataFrame:
    """``id..., dim, tab, slice, codes`` for the first columns of ``rows``, whose last column is the vector.

    An index row (not ``asked``) has one code for each table; a query has a row
    for each slice that it probes, with its codes there.  ``counts`` has the number
    of vectors of each length.
    """
    keep = rows.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        hashes: dict[int, CrossPolytope] = {}
        for batch in batches:
            for at, x in _vectors(batch.column(len(keep) - 1)):
                d = x.shape[1]
                n = counts.get(d, 1)
                if d not in hashes:
                    hashes[d] = CrossPolytope(d, tables, code_bits(n))
                slices = -(-n // chunk)
                for t in range(tables):
                    for a in range(0, len(at), 128):
                        codes = hashes[d].probes(x[a : a + 128], t, probes or probe_count(n)) if asked else hashes[d].codes(x[a : a + 128], t)[:, None]
                        own = np.repeat(np.arange(len(codes)), codes.shape[1]) * slices + _slice_of(codes.ravel(), slices)
                        order = np.argsort(own, kind="stable")
                        cells, begins = np.unique(own[order], return_index=True)
                        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)).astype(np.int32)), pa.array(codes.ravel()[order]))
                        columns = [*batch.take(pa.array(at[a + cells // slices])).columns, *(pa.array(np.full(len(cells), v, np.int32)) for v in (d, t)), pa.array((cells % slices).astype(np.int32)), lists]
                        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "dim", "tab", "slice", "codes"])

    return rows.mapInArrow(run, f"{fields}, dim int, tab int, slice int, codes array<long>")


def _candidates(codes: np.ndarray, wanted: list[np.ndarray]):
    """Blocks of ``query row, candidate row`` for candidates sorted by code."""
    rows = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    asked = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
    low, high = np.searchsorted(codes, asked, "left"), np.searchsorted(codes, asked, "right")
    held = np.flatnonzero(high > low)
    rows, low, sizes = rows[held], low[held], (high - low)[held]
    a = 0
    while a < len(rows):  # whole queries, of about PAIRS candidates together
        upto = np.searchsorted(np.cumsum(sizes[a:]), PAIRS, "right") + a
        last = rows[min(max(upto, a + 1), len(rows)) - 1]
        z = int(np.searchsorted(rows, last, "right"))
        n = sizes[a:z]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(rows[a:z], n), np.repeat(low[a:z], n) + step
        a = z


def nearest(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES, probes: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each query.

    ``queries`` is a condition over ``id`` that tells which rows are queries.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    number = kind if kind in ("float", "double") else "double"  # vectors travel as they are; cosines are of doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0)
    rows = materialise(rows.where(sound).dropDuplicates(["id", "v"]), "vectors")
    by_vector = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    classes = materialise(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v"), "classes")
    asked = rows.where(queries)
    counts = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length

    cell = ["dim", "tab", "slice"]
    part = [*cell, "i", "j"]
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if candidates.num_rows and wanted.num_rows:
            codes = candidates.column("codes").combine_chunks().flatten().to_numpy()
            order = np.argsort(codes, kind="stable")
            candidates = candidates.take(pa.array(order))
            matrix = lambda c: np.asarray(c.combine_chunks().flatten(), np.float64).reshape(len(c), -1)
            c, q = matrix(candidates.column("v")), matrix(wanted.column("v"))
            ids, q_ids = candidates.column("ids"), wanted.column("id").to_pylist()
            c_norm, q_norm = np.sqrt(np.einsum("ij,ij->i", c, c)), np.sqrt(np.einsum("ij,ij->i", q, q))
            for asks, near in _candidates(codes[order], [np.asarray(w) for w in wanted.column("codes").to_pylist()]):
                cosine = np.empty(len(asks))
                for a in range(0, len(asks), PAIRS):
                    z = a + PAIRS
                    cosine[a:z] = np.einsum("ij,ij->i", q[asks[a:z]], c[near[a:z]]) / c_norm[near[a:z]]
                ranked = np.lexsort((-cosine, asks))
                begins = np.flatnonzero(np.diff(asks[ranked], prepend=-1))
                for a, z in zip(begins, [*begins[1:], len(ranked)], strict=True):
                    row, values = asks[ranked[a]], cosine[ranked[a:z]]
                    floor = values[min(k, len(values) - 1)]
                    close = ranked[a : a + int(np.count_nonzero(values >= floor - 1e-12 * abs(floor)))]
                    found = [(-float(np.dot(q[row], c[n])) / (q_norm[row] * c_norm[n]), v) for n in near[close] for v in ids[int(n)].as_py() if v != q_ids[row]]
                    for score, v in sorted(found)[:k]:
                        out[0].append(q_ids[row])
                        out[1].append(v)
                        out[2].append(-float(score))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def searched(index: DataFrame, probed: DataFrame) -> DataFrame:
        held = index.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (2 * chunk)).cast("int").alias("parts"))
        wanted = probed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("shares"))
        grid = materialise(held.join(wanted, cell), "grid")
        if grid.count() <= GRID:
            grid = F.broadcast(grid)
        left = index.join(grid, cell).withColumn("i", own("v", "parts")).withColumn("j", every("shares")).select(*part, "ids", "v", "codes")
        right = probed.join(grid, cell).withColumn("j", own("id", "shares")).withColumn("i", every("parts")).select(*part, "id", "v", "codes")
        return left.groupBy(*part).cogroup(right.groupBy(*part)).applyInArrow(search, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = materialise(ranked(searched(_hashed(classes, tables, False, None, counts, chunk), _hashed(asked, tables, True, probes, counts, chunk))), "found")
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialise(asked.join(full, "id", "left_anti").select("id", "v"), "short")
    if short.isEmpty():
        return first
    # One slice of one code holds every class of the dimension once.
    whole = {"dim": F.size("v"), "tab": F.lit(-1), "slice": F.lit(0), "codes": F.array(F.lit(0).cast("long"))}
    return ranked(first.select("query_id", "vec_id", "score").unionByName(searched(classes.withColumns(whole), short.withColumns(whole))))
