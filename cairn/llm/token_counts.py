"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of symbols.  Adjacent pairs that the
vocabulary can merge lie in a heap by (rank, position); the lowest is popped
again and again and its two links become one.  A word's count is its initial
symbols minus its merges; no identifiers are made.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows are
counted each; an empty table gives an empty result; columns beyond the id and
the text are not read.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import words

WINDOW = 2048
#: Bytes of a worker's table of chunks.
TABLE_BYTES = 320 << 20


class MergeCounter:
    """Counts the tokens of words for one vocabulary."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        self.ranks = words.load_merges(path)
        self.table = words.ChunkTable(path, self._word, sum, dict.fromkeys(words.SPECIAL, 1), table_bytes)

    def count(self, text: str | None) -> int:
        return sum(map(self.table.__getitem__, words.chunks(text))) if text else 0

    def _word(self, letters: str) -> int:
        symbols = list(letters)
        symbols[-1] += "</w>"
        n, ranks = len(symbols), self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        merged = 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            # An entry is stale once either side has been merged away or has grown.
            if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h))
            merged += 1
        return n - merged


_counters: dict[str, MergeCounter] = {}


def _counter(path: str) -> MergeCounter:
    """One counter for each vocabulary and worker process."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = words.VOCABULARY, limit: int = WINDOW) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, in one narrow pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = _counter(words.vocabulary_path(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
