"""SimHash near-duplicates through vantage-point trees over Hamming space.

1. Every text becomes a 64-bit fingerprint of its word shingles, in one narrow
   pass; equal fingerprints become one point.
2. A bounded sample of the points shapes a vantage-point tree: a node parts its
   points by their distance to a vantage point, near ones (distance at most
   ``mu``) from far ones.  The leaves are the shards.
3. Every point goes home to one leaf.  Two points within ``radius`` that a node
   parts have distances within ``radius`` of each other, so the far one's lies
   in (mu, mu + radius]; such far points also visit the near side.  Thus each
   link meets in at least one leaf, and the result is exact.
4. A leaf is searched by the same recursion down to small blocks.  It returns a
   spanning forest of its links, which keeps the output linear in the points.
   A leaf that holds many points is dealt out as a grid of blocks.
5. Star contraction joins the forests into components.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows share a
fingerprint; rows with a null id are labelled by their component's least
non-null id, or null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import fresh, let_go, materialise
from cairn.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Points that shape the shard tree at most (expected number).
SAMPLE = 65_536
#: Points meant for a shard.
LEAF = 32_768
#: Points of a block when a leaf outgrows it.
BLOCK = 131_072
#: Points compared all with all.
DIRECT = 1_024


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    w = text.encode("utf-8").lower().split() if text else []
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    n = len(w) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 8_160):
        bits = np.unpackbits(h[a : a + 8_160].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            counts += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    ones = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, uid, fp``: a hash of the text and the fingerprint, as signed longs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("uid"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        let_go()
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "uid", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, uid long, fp long")


# ------------------------------------------------------------------ shard tree


def _distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and threshold whose boundary holds the fewest points."""
    best = None
    for vantage in points[:: max(1, len(points) // 12)][:12]:
        seen = np.bincount(_distance(points, vantage), minlength=65)[:65]
        below = np.cumsum(seen)
        for mu in range(64):
            near = below[mu]
            if not 0.25 * len(points) <= near <= 0.75 * len(points):
                continue
            edge = below[min(64, mu + radius)] - near
            if best is None or edge < best[0]:
                best = (edge, vantage, mu)
    if best is None or best[0] > 0.6 * len(points):  # too dense to part
        return None
    return best[1], best[2]


class ShardTree:
    """Vantage points, thresholds and children as arrays; a leaf's child is -1 - leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.vantage, self.mu, self.near, self.far = [], [], [], []
        self.radius, self.leaves = radius, 0
        self.root = self._grow(sample, max(16, -(-len(sample) // max(1, leaves))))

    def _grow(self, points: np.ndarray, small: int) -> int:
        split = _split(points, self.radius) if len(points) > small else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.mu)
        self.vantage.append(split[0])
        self.mu.append(split[1])
        self.near.append(0)
        self.far.append(0)
        d = _distance(points, split[0])
        self.near[node] = self._grow(points[d <= split[1]], small)
        self.far[node] = self._grow(points[d > split[1]], small)
        return node

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``leaf, point index, at home``."""
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-1 - node, rows, home))
                continue
            d, mu = _distance(points[rows], self.vantage[node]), self.mu[node]
            near = d <= mu
            inside = d <= mu + self.radius  # far home points visit the near side
            outside = ~near | (~home & (d > mu - self.radius))  # a visitor may link with either side
            todo.append((self.near[node], rows[inside], (home & near)[inside]))
            todo.append((self.far[node], rows[outside], (home & ~near)[outside]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([np.full(len(r), leaf) for leaf, r, _ in out]), np.concatenate([r for _, r, _ in out]), np.concatenate([h for _, _, h in out])


# ---------------------------------------------------------------- local search


def _direct(a: np.ndarray, b: np.ndarray | None, radius: int, out: list) -> None:
    other = a if b is None else b
    step = max(1, 1_048_576 // max(1, len(other)))
    for s in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[s : s + step, None] ^ other[None, :]) <= radius)
        if b is None:
            keep = i + s < j
            i, j = i[keep], j[keep]
        if len(i):
            out.append(_forest(a[s : s + step][i], other[j]))


def _within(a: np.ndarray, radius: int, out: list) -> None:
    """Links among ``a``."""
    split = _split(a, radius) if len(a) > DIRECT else None
    if split is None:
        return _direct(a, None, radius, out)
    d, mu = _distance(a, split[0]).astype(np.int16), split[1]
    _within(a[d <= mu], radius, out)
    _within(a[d > mu], radius, out)
    _across(a[(d <= mu) & (d > mu - radius)], a[(d > mu) & (d <= mu + radius)], radius, out)


def _across(a: np.ndarray, b: np.ndarray, radius: int, out: list) -> None:
    """Links between ``a`` and ``b``."""
    if not len(a) or not len(b):
        return
    split = _split(a, radius) if len(a) * len(b) > DIRECT * DIRECT else None
    if split is None:
        return _direct(a, b, radius, out)
    d, e, mu = _distance(a, split[0]).astype(np.int16), _distance(b, split[0]).astype(np.int16), split[1]
    _across(a[d <= mu], b[e <= mu + radius], radius, out)
    _across(a[d > mu], b[e > mu - radius], radius, out)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links (u, v) as keep the same points together."""
    if len(u) < 64:
        return u, v
    points, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(points))
    while True:  # least label of the neighbours, then jump to the label's label
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def local_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links that have an end in ``home``."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    _within(home, radius, out)
    _across(home, visitors, radius, out)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out]))


# ------------------------------------------------------------------- operators


def near_links(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` that hold together all distinct ``fp`` within ``radius``.

    ``points`` has one row for each fingerprint and can be read again cheaply.
    """
    n = points.count()
    share = min(1.0, sample / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))).select("fp")
    shaped = np.sort(np.array([r.fp for r in chosen.collect()], np.int64).view(np.uint64))
    shaped = shaped[np.random.default_rng(SEED).permutation(len(shaped))]
    tree = ShardTree(shaped, max(1, n // leaf), radius)

    def routed(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            leaf_no, row, home = tree.route(fp)
            yield pa.RecordBatch.from_arrays([pa.array(leaf_no.astype(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    rows = points.select("fp").mapInArrow(routed, "leaf long, fp long, home boolean")
    held = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # a row for each leaf
    large = {k: -(-c // block) for k, c in held.items() if c > block}

    def dealt(batches):
        for batch in routed(batches):  # in one worker: Spark gives each Python step of a task a worker of its own
            leaf_no, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts = []
            for k in np.unique(leaf_no):
                at, blocks = leaf_no == k, large.get(int(k), 1)
                f, h = fp[at], home[at]
                own = (f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                for other in range(blocks):
                    i, j = np.minimum(own, other), np.maximum(own, other)
                    parts.append((np.full(len(f), k), i, j, own == i, f, h))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["leaf", "i", "j", "first", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home, first = table.column("home").to_numpy(), table.column("first").to_numpy()
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            u, v = local_links(fp[home], fp[~home], radius)
        else:
            out: list = []
            _across(fp[home & first], fp[~first], radius, out)
            _across(fp[~home & first], fp[home & ~first], radius, out)
            u = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
            v = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.uint64)
            u, v = _forest(u, v)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    units = points.select("fp").mapInArrow(dealt, "leaf long, i long, j long, first boolean, fp long, home boolean")
    return units.groupBy("leaf", "i", "j").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, uid, root`` for every row of ``docs``.

    ``component_id`` is the least id that links reach, the row's own included;
    ``root`` names the component even where no row of it has an id.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = connected_components(near_links(points, radius)).withColumnRenamed("node", "fp")
    linked = roots.join(points, "fp")
    by_root = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = points.join(linked.join(by_root, "component").select("fp", "component_id", "component"), "fp", "left")
    labels = labels.select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("root"))
    # Written, so that the join is between two plain shuffles and a hot fingerprint can be split.
    return prints.join(materialise(labels, "labels"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "uid", "root")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the least id of each group, columns unchanged.

    A group without any id keeps one text.  Among rows that repeat the chosen id
    and text, one stays; among different texts under one id, the one with the
    least hash.
    """
    groups = materialise(near_duplicates(docs, id_col, text_col, shingle, radius).select("doc_id", "uid", "root"), "groups")
    i, u = fresh(docs, "id", "uid")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias(i), F.col("uid").alias(u))
    chosen = groups.groupBy("root").agg(F.min(order).alias("c")).select(f"c.{i}", f"c.{u}")
    same = docs[id_col].eqNullSafe(chosen[i]) & (F.xxhash64(docs[text_col]) == chosen[u])
    kept = docs.join(chosen, same, "left_semi")
    if groups.groupBy("doc_id", "uid").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn(u, F.xxhash64(text_col)).dropDuplicates([id_col, u]).drop(u)
