"""Trie of conversation prefixes by range minima over sorted LCPs.

Turns are numbered within their conversation and hashed to 128 bits with their place.  A node of
the trie is the sequence of a conversation's first ``depth`` turns; its key is the exclusive-or of
their hashes, so a key needs no walk from the root.

1. A conversation is cut into segments of ``SEGMENT`` turns.  A segment's context is the key of what
   comes before it, so the trie under a context is told by the segments that have it, and no
   conversation is ever gathered whole.
2. Segments are sorted by context, hashes and conversation, in ranges of bounded size.  A range with
   the last row before it and the first one behind it knows how many turns each segment shares with
   the one before (its LCP) and the one behind.
3. A segment owns the nodes beyond its LCP.  The turns that a conversation does not own are those that a
   prefix cache saves, and it owns its leaf if the next one does not go on from it; both add up over a
   node's members, those of later segments too.
4. In each range a sparse table gives the least LCP of any stretch.  Every prefix of every segment
   searches its left and right extents by itself, by halving steps over that table; a prefix that is the
   leftmost of its extent stands for the node.  Sums over an extent come from running totals.  A
   node that lies in several ranges is the sum of its parts.

Ids of the conversations that end at a node are hashed in order, range by range, without being gathered.

Defined cases: a null role or text is empty; a null turn number comes first; turns of equal number are
ordered by role and text; repeated rows are turns of their own; rows with a null conversation id are
left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._common import materialise, shuffle_width

SEGMENT = 128
#: Segments and turns of a range, about.
RANGE_SEGMENTS, RANGE_TURNS = 8_192, 65_536
#: Fixed value: what a word is made of.
WORD = r"[^\x20\x09-\x0D]+"

TURNS = ["conv_id", "place", "t1", "t2", "words"]
ROW = "part long, seq long, conv_id long, seg int, c1 long, c2 long, last boolean, z1 array<long>, z2 array<long>, words array<long>"
NODE = "id1 long, id2 long, depth long, up1 long, up2 long, conv_id long, n_convs long, n_leaves long, saved long, ends string, piece string, part long"


def ordered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, t1, t2, words``: turns hashed and numbered from 1.

    The rows are sorted in ranges, so that a conversation of any length is numbered by many tasks.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id IS NOT NULL")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # Parts are ranges in order and rows are sorted in them, so this number follows the order.
    seq = F.monotonically_increasing_id()
    turns = turns.select(seq.alias("seq"), "conv_id", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = materialise(turns.withColumn("part", F.shiftright("seq", 33)), "turns")
    spans = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = materialise(spans.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")), "spans")
    return turns.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("place"), "t1", "t2", "words")


def shared_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared heads: the first h turns of conversation ``c - c % group``, then
    c's own behind its first h; h is the checksum of c modulo ``heads``.

    The turns as ``ordered`` gives them, and all conversations' ids.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    all_ = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = all_.join(bases, "base", "left").withColumn("from_base", F.least("h", F.coalesce("n_base", F.lit(0))))
    info = materialise(info.select("conv_id", "base", "h", "from_base"), "heads")
    own = turns.join(info.select("conv_id", "h", "from_base"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("from_base")).alias("place"), "t1", "t2", "words")
    head = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    head = info.select("conv_id", "base", "h").join(head, "base").where("place <= h").select(*TURNS)
    return own.unionByName(head), info.select("conv_id")


def _segments(turns: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """One row for each segment; a conversation without turns has one, too."""
    turns = turns.select("conv_id", "place", F.xxhash64("place", "t1", "t2").alias("z1"), F.xxhash64(F.lit(1), "place", "t1", "t2").alias("z2"), "words")
    zero = F.lit(0).cast("long")
    turns = turns.unionByName(members.select("conv_id", *(zero.alias(c) for c in ("place", "z1", "z2", "words"))))
    seg = F.when(F.col("place") > 0, F.floor((F.col("place") - 1) / size)).otherwise(0).cast("int")
    row = F.struct("place", "z1", "z2", "words")
    cut = turns.groupBy("conv_id", seg.alias("seg")).agg(F.filter(F.sort_array(F.collect_list(row)), lambda t: t["place"] > 0).alias("turns"), F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    by_conv = Window.partitionBy("conv_id").orderBy("seg")
    past = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    context = [F.coalesce(F.bit_xor(x).over(past), zero).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))]
    return cut.select("conv_id", "seg", *context, F.lead("seg").over(by_conv).isNull().alias("last"), *(F.col(f"turns.{c}").alias(c) for c in ("z1", "z2", "words")))


def _sorted(segments: DataFrame, ranges: int) -> DataFrame:
    """Segments in ranges by context, hashes and conversation, those that go on behind those that end; ``seq`` follows the order."""
    keys = ["c1", "c2", F.arrays_zip("z1", "z2"), ~F.col("last"), "conv_id"]
    rows = segments.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id())
    return rows.withColumn("part", F.shiftright("seq", 33))


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """Every range's rows, the last one before it and the first one behind it."""
    ends = rows.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("end"))
    order = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", F.lag("end").over(order).alias("before"), F.lead("first").over(order).alias("behind"))
    wanted = ends.select(F.col("part").alias("of"), F.explode(F.array("before", "behind")).alias("seq")).where("seq IS NOT NULL")
    return rows.withColumn("of", F.col("part")).unionByName(rows.join(wanted, "seq").select(*rows.columns, "of"))


class Rows:
    """A range's segments in order, their turns one after another."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("seq")
        self.table, self.n = table, table.num_rows
        lists = [table.column(c).combine_chunks() for c in ("z1", "z2", "words")]
        self.sizes = np.asarray(lists[0].value_lengths(), np.int64)
        self.begin = np.append(0, np.cumsum(self.sizes))
        self.z1, self.z2, self.words = (np.asarray(x.flatten(), np.int64) for x in lists)
        self.conv, self.seg, self.c1, self.c2 = (table.column(c).to_numpy().astype(np.int64) for c in ("conv_id", "seg", "c1", "c2"))
        self.last = np.asarray(table.column("last")).astype(bool)
        self.row = np.repeat(np.arange(self.n), self.sizes)
        self.turn = np.arange(len(self.row)) - self.begin[self.row] + 1

    def shared(self) -> np.ndarray:
        """Turns that each row shares with the row before; -1 where the context is another, or for the first."""
        out = np.full(self.n, -1, np.int64)
        same = np.append(False, (self.c1[1:] == self.c1[:-1]) & (self.c2[1:] == self.c2[:-1]) & (self.seg[1:] == self.seg[:-1]))
        at = np.flatnonzero(same)
        n = np.minimum(self.sizes[at], self.sizes[at - 1])
        own = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        other = np.repeat(self.begin[at - 1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        differ = (self.z1[own] != self.z1[other]) | (self.z2[own] != self.z2[other])
        step = np.arange(len(differ)) - np.repeat(np.cumsum(n) - n, n)
        out[at] = n
        np.minimum.at(out, np.repeat(at, n)[differ], step[differ])
        return out

    def running(self, values: np.ndarray) -> np.ndarray:
        """Running totals of the turns' values within their rows, a zero before the first; by ``begin[row] + row + turn``."""
        total = np.append(0, np.cumsum(values))
        out = np.zeros(len(values) + self.n, np.int64)
        out[self.begin[:-1] + np.arange(self.n)] = 0
        out[np.arange(len(values)) + self.row + 1] = total[1:] - total[self.begin[self.row]]
        return out


class SparseTable:
    """Least values of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least value from ``left`` to ``right``, both included."""
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][left[at]], self.levels[k][right[at] - (1 << k) + 1])
        return out

    def extents(self, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leftmost and rightmost rows to which no value between (the one of the leftmost row apart) is below ``need``."""
        left, right, n = at.copy(), at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            step, held = 1 << k, self.levels[k]
            far = left - step
            go = (far >= 0) & (held[np.clip(far + 1, 0, len(held) - 1)] >= need)
            left = np.where(go, far, left)
            far = right + step
            go = (far < n) & (held[np.clip(right + 1, 0, len(held) - 1)] >= need)
            right = np.where(go, far, right)
        return left, right


def _compared(table: pa.Table) -> pa.Table:
    """A range's own rows with ``lcp`` and ``lcp_next``, the words they do not own, and whether they own a leaf."""
    rows = Rows(table)
    lcp = rows.shared()
    behind = np.append(lcp[1:], -1)
    part = rows.table.column("part").to_numpy()
    own = np.flatnonzero(part == rows.table.column("of").to_numpy())
    saved = rows.running(np.where(rows.turn <= lcp[rows.row], rows.words, 0))
    saved = saved[rows.begin[:-1] + np.arange(rows.n) + rows.sizes]
    leaf = (rows.last & (behind < rows.sizes)).astype(np.int64)
    out = rows.table.drop_columns(["of"]).take(pa.array(own))
    for name, values in (("lcp", lcp), ("lcp_next", behind), ("saved", saved), ("leaf", leaf)):
        out = out.append_column(name, pa.array(values[own]))
    return out


def _nodes(table: pa.Table, size: int) -> pa.Table:
    """The nodes of a range, or their parts in it."""
    rows = Rows(table)
    n = rows.n
    lcp, after = (rows.table.column(c).to_numpy() for c in ("lcp", "lcp_next"))
    later, leaf = (rows.table.column(c).to_numpy() for c in ("later", "leaf"))
    roots = np.flatnonzero(rows.seg == 0)
    row, turn = np.append(rows.row, roots), np.append(rows.turn, np.zeros(len(roots), np.int64))
    left, right = SparseTable(lcp).extents(row, turn)
    node = left == row
    row, turn, right = row[node], turn[node], right[node]

    # Running exclusive-or of the hashes, from the context on.
    keys = []
    for z, c in ((rows.z1, rows.c1), (rows.z2, rows.c2)):
        run = np.append(0, np.bitwise_xor.accumulate(z)) if len(z) else np.zeros(1, np.int64)
        place = rows.begin[row] + turn
        base = run[rows.begin[row]] ^ c[row]
        keys.append((run[place] ^ base, run[np.maximum(place - 1, rows.begin[row])] ^ base))
    (id1, up1), (id2, up2) = keys

    cell = rows.begin[:-1] + np.arange(n)
    words, saved = rows.running(rows.words), rows.running(np.where(rows.turn <= lcp[rows.row], rows.words, 0))
    total = np.append(0, np.cumsum(saved[cell + rows.sizes] + later))
    leaves = np.append(0, np.cumsum(leaf))
    above = np.maximum(turn - 1, 0)
    kept = total[right + 1] - total[row] - (right - row) * words[cell[row] + above] - saved[cell[row] + above]

    # Members that end at a node are its first rows, and equal.
    ends, piece = np.full(len(row), None, object), np.full(len(row), None, object)
    equal = np.append(False, (lcp[1:] == rows.sizes[1:]) & (rows.sizes[1:] == rows.sizes[:-1]))
    run = np.append(np.flatnonzero(~equal), n)
    closing = dict(pairwise(run.tolist()))
    for at in np.flatnonzero(rows.sizes[row] == turn).tolist():
        i = int(row[at])
        stop = closing.get(i)
        told = ",".join(map(str, rows.conv[i:stop][rows.last[i:stop]].tolist()))
        if (i == 0 and lcp[0] >= turn[at]) or (stop == n and after[-1] >= turn[at]):
            piece[at] = told  # it may go on in another range
        elif told:
            ends[at] = hashlib.sha256(told.encode()).hexdigest()
    root = (rows.seg[row] == 0) & (turn == 0)
    names = NODE.replace(" long", "").replace(" string", "").split(", ")
    columns = [id1, id2, rows.seg[row] * size + turn, pa.array(up1, mask=root), pa.array(up2, mask=root), SparseTable(rows.conv).least(row, right), right - row + 1, leaves[right + 1] - leaves[row], kept, pa.array(ends, pa.string()), pa.array(piece, pa.string()), np.full(len(row), rows.table.column("part")[0].as_py())]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _digests(pieces: DataFrame) -> DataFrame:
    """``id1, id2, told``: the digest of each node's ids, whose pieces come in the order of their ranges."""

    def run(batches):
        key, digest, some = None, None, False
        done: list[tuple] = []
        for batch in batches:
            for id1, id2, piece in zip(*(batch.column(c).to_pylist() for c in ("id1", "id2", "piece")), strict=True):
                if (id1, id2) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest, some = (id1, id2), hashlib.sha256(), False
                if piece:
                    digest.update(("," * some + piece).encode())
                    some = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["id1", "id2", "told"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["id1", "id2", "told"])

    rows = pieces.select("id1", "id2", "part", "piece").repartition("id1", "id2").sortWithinPartitions("id1", "id2", "part")
    return rows.mapInArrow(run, "id1 long, id2 long, told string")


def prefix_trie(turns: DataFrame, members: DataFrame, segment: int = SEGMENT, ranges: int | None = None) -> DataFrame:
    """One row for each distinct prefix of ``turns`` (see ``ordered``); ``members`` are all conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: the least
    member, its parent's least member, members, children, childless nodes of the subtree, the words that a
    cache of prefixes saves there, and the digest of the conversations that end at the node.
    """
    segments = materialise(_segments(turns, members, segment), "segments")
    if ranges is None:
        sizes = segments.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("z1")), F.lit(0))).first()
        ranges = max(shuffle_width(turns.sparkSession), -(-sizes[0] // RANGE_SEGMENTS), -(-sizes[1] // RANGE_TURNS))
    rows = materialise(_sorted(segments, ranges), "sorted")
    compared = _with_neighbours(rows).groupBy("of").applyInArrow(_compared, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, lcp long, lcp_next long, saved long, leaf long")
    by_conv = Window.partitionBy("conv_id").orderBy(F.desc("seg"))
    compared = compared.withColumn("later", F.coalesce(F.sum("saved").over(by_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    compared = compared.withColumn("leaf", F.first("leaf").over(by_conv)).drop("saved")
    parts = materialise(compared.groupBy("part").applyInArrow(lambda t: _nodes(t, segment), NODE), "nodes")

    key = ["id1", "id2"]
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved")]
    nodes = parts.groupBy(*key).agg(F.first("depth").alias("depth"), F.first("up1").alias("up1"), F.first("up2").alias("up2"), F.min("conv_id").alias("conv_id"), *total, F.max("ends").alias("ends"))
    nodes = materialise(nodes, "trie")
    parents = nodes.where("depth > 0").select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent"))
    top = F.broadcast(nodes.where("depth = 0").agg(F.min("conv_id").alias("top")))  # one row
    children = nodes.where("depth > 0").groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count(F.lit(1)).alias("n_children"))
    told = _digests(parts.where("piece IS NOT NULL"))
    deep = nodes.where("depth > 1").join(parents, ["up1", "up2"]).select(*key, "depth", "conv_id", "parent", "n_convs", "n_leaves", "saved", "ends")
    high = nodes.where("depth <= 1").crossJoin(top).select(*key, "depth", "conv_id", F.when(F.col("depth") == 1, F.col("top")).alias("parent"), "n_convs", "n_leaves", "saved", "ends")
    out = deep.unionByName(high).join(children, key, "left").join(told, key, "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", "told", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
