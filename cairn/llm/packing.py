"""Packing documents into windows of 2048 tokens, best fit decreasing.

Every document is its vocabulary ids and a closing id.  A document longer than
a window is first cut into full windows, each a sequence of its own; what is
left of it, and every shorter document, is one piece.  Pieces are placed by
falling length into the open window with the least room that still takes them.
A segment tree over the remaining capacities finds that window.

The texts are cut in one narrow pass that writes a row of numbers for each piece.
Only these rows are shuffled: they are counted and dealt by hash into shards of
about ``SHARD`` pieces, and each shard is packed by a task of its own.  So the
result does not depend on how the documents are partitioned, and no task keeps
more than a shard's numbers.  A shard leaves a few half-filled windows, a share
of padding that falls as the shard grows.

Defined cases: a null or empty text is the closing id alone; repeated rows and
null ids are packed as rows of their own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import words
from cairn.llm._common import kept, materialise

WINDOW = 2048
CLOSING_ID = 1
#: Pieces that are packed together; bounds a task's memory.
SHARD = 131_072
#: Bytes of a worker's table of chunks.
TABLE_BYTES = 320 << 20
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class CapacityTree:
    """Open windows by remaining capacity, with the tightest fit found in O(log)."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.live = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_no: int) -> None:
        self.open[capacity].append(window_no)
        node = self.leaves + capacity
        while node:
            self.live[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that an open window has, or -1."""
        live, node = self.live, self.leaves + need
        if live[node]:
            return need
        while node > 1:
            if not node & 1 and live[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node *= 2
            if not live[node]:
                node += 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        node = self.leaves + capacity
        while node:
            self.live[node] -= 1
            node >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of every piece, and the number of windows."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity = tree.tightest(need)
        if capacity < 0:
            number, capacity = used, window
            used += 1
        else:
            number = tree.take(capacity)
        place[i], offset[i] = number, window - capacity
        if capacity > need:
            tree.add(capacity - need, number)
    return place, offset, used


class IdBytes:
    """A text's ids as little-endian unsigned 32-bit numbers, chunk by chunk.

    The vocabulary's own model encodes each distinct word; a table keeps the bytes.
    """

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.special = {x: struct.pack("<I", tokenizer.token_to_id(x)) for x in words.SPECIAL}
        self.table = words.ChunkTable(path, self._word, b"".join, self.special, table_bytes)

    def _word(self, letters: str) -> bytes:
        tokens = self.model.tokenize(letters)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.table.__getitem__, words.chunks(text))) if text else b""


def _encoder(path: str) -> IdBytes:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("packing", path), lambda: IdBytes(path))


def _cut(data: bytes, window: int) -> list[tuple[int, int, int, int]]:
    """``start, length, crc32, tokens`` of the pieces of a document's ids."""
    tokens, view = len(data) // 4, memoryview(data)
    cuts = [(start, view[4 * start : 4 * min(tokens, start + window)]) for start in range(0, tokens, window)]
    return [(start, len(part) // 4, zlib.crc32(part), tokens) for start, part in cuts]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = words.VOCABULARY, window: int = WINDOW, closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece and, with ``with_ids``, its ``ids``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    closing = struct.pack("<I", closing_id)

    def run(batches):
        encoder = _encoder(words.vocabulary_path(vocabulary))
        for batch in batches:
            ids, numbers, lists = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.of(text.as_py()) + closing
                cut = _cut(data, window)
                ids += [doc_id] * len(cut)
                numbers += cut
                if with_ids:
                    whole = np.frombuffer(data, "<u4").astype(np.int64)
                    lists += [whole[a : a + n] for a, n, _, _ in cut]
            arrays = [pa.array(ids, batch.column(0).type), *(pa.array(c, pa.int64()) for c in np.array(numbers, np.int64).reshape(-1, 4).T)]
            if with_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=COLUMNS + ["ids"] * with_ids)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def placed(parts: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``parts`` with ``sequence_id, offset``; the shards are counted, and dealt by hash."""
    shards = max(1, -(-parts.count() // shard))
    number = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))

    def place(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("tie", "ascending")]
        table = table.sort_by(order)
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = int((lengths == window).sum())  # these come first
        sequence[:full] = np.arange(full)
        at, off, _ = best_fit_decreasing(lengths[full:], window)
        sequence[full:], offset[full:] = at + full, off
        sequence += table.column("shard")[0].as_py() << 40
        return table.drop_columns(["shard", "tie"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return parts.withColumns({"shard": number, "tie": F.xxhash64("doc_id")}).groupBy("shard").applyInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = words.VOCABULARY, window: int = WINDOW, closing_id: int = CLOSING_ID, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """One row for each piece: where it starts in its document and where it lies.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    with ``with_ids``, the piece's ``ids``.
    """
    found = placed(materialise(pieces(docs, id_col, text_col, vocabulary, window, closing_id, with_ids), "pieces"), window, shard)
    return found.select(*COLUMNS, "sequence_id", "offset", *["ids"] * with_ids)
