"""Benchmark decontamination by pigeonhole edit matching over words.

Text is lower-cased and cut into words of letters and digits.  A test item of n
words tolerates k = floor((1 - similarity) * n) word edits.  It is cut into
k + 1 pieces: by the pigeonhole principle, an occurrence with at most k edits
holds one piece unchanged.

1. The items become a table of pieces, each with a 64-bit hash of its first words
   (at most ``LOOKUP``).  All hashes set bits in a filter of at most
   ``2 ** MAX_BITS`` bits, whatever the number of items; it is all that reaches
   the driver and the workers.
2. One pass over the documents hashes every run of that many words in whole texts
   and writes the texts with runs that pass the filter, with their places.
3. The places are joined with the pieces by hash, and every distinct text and item
   that meet are verified once: around each hit, Myers' bit-parallel algorithm
   finds the least edit distance of the item to any part of the text.

Hash collisions and false passes of the filter only cost a verification.  Edits are counted in words: a
text in a script without spaces is a handful of very long words, so there k is mostly 0 and only unchanged sentences
between punctuation are found.

Defined cases: a null or empty text or item matches nothing, and so does an
item without words; an item so short that k is 0 must occur unchanged; equal
items each report their own match; repeated rows report each; a row's null id is
reported as null; empty tables give an empty result; other columns are not read
by ``find_leaks`` and pass through ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import fresh, let_go, materialise

SIMILARITY = 0.8
#: Words of a piece that are looked up at most.
LOOKUP = 8
#: Bits of the filter: 2 to this power at most, about 64 for each piece below that.
MAX_BITS = 27
#: Bits that a piece sets, each by an odd multiplier of its own (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Words that are hashed together.
TOGETHER = 262_144
#: Entries of a worker's table of word hashes, and characters of a word that is kept there.
TABLE_LIMIT, KEEP = 1_000_000, 32

_NOT_WORD = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    return _NOT_WORD.sub(" ", text.lower()).split() if text else []


class Myers:
    """Least edit distance of a word pattern to any part of a text.

    The columns of the distance table are held as differences, one bit a row, in
    two integers as long as the pattern.
    """

    def __init__(self, pattern: list[str]):
        self.length = len(pattern)
        self.full, self.top = (1 << self.length) - 1, 1 << (self.length - 1)
        self.at: dict[str, int] = defaultdict(int)
        for i, word in enumerate(pattern):
            self.at[word] |= 1 << i

    def best(self, text: list[str]) -> tuple[int, int]:
        """The least distance, and the place just behind where it is reached first."""
        up, down, score = self.full, 0, self.length
        best, end = score, 0
        at, full, top = self.at, self.full, self.top
        for place, word in enumerate(text, 1):
            eq = at.get(word, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            right = down | (full & ~(diagonal | up))
            left = up & diagonal
            if right & top:
                score += 1
            elif left & top:
                score -= 1
            right, left = (right << 1) & full, (left << 1) & full  # row 0 is free: a match may start anywhere
            up = left | (full & ~(diagonal | right))
            down = right & diagonal
            if score < best:
                best, end = score, place
        return best, end


class WordHashes(dict):
    """64-bit hashes of words, filled as words come and emptied when full."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= KEEP:
            if len(self) >= TABLE_LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def budget(words: int, similarity: float) -> int:
    return int(round((1 - similarity) * words, 9))


def pieces(words: list[str], similarity: float) -> list[tuple[int, int]]:
    """First word and number of looked-up words of each piece."""
    k = budget(len(words), similarity)
    cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
    return [(a, min(LOOKUP, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _windows(starts: list[int], length: int, k: int) -> list[tuple[int, int]]:
    """Stretches of words that hold every occurrence with a hit, overlaps joined."""
    out: list[list[int]] = []
    for s in starts:
        a, z = s - k, s + length + k
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    return [(a, max(0, z)) for a, z in out]


def distance(text: list[str], item: list[str], starts: list[int], k: int, myers: Myers | None = None) -> int:
    """The least distance of the item to a part of the text near ``starts``, or more than k."""
    myers, best = myers or Myers(item), k + 1
    for a, z in _windows(sorted(starts), len(item), k):
        best = min(best, myers.best(text[max(0, a) : z])[0])
    return best


def _item_pieces(tests: DataFrame, similarity: float) -> DataFrame:
    """``piece, size, first, i1, i2`` of every distinct item text."""

    def run(batches):
        table = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for text, i1, i2 in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if w := words_of(text):
                    h = table.of(w)
                    out += [(int(run_hashes(h[a : a + n], n)[0].astype(np.int64)), n, a, i1, i2) for a, n in pieces(w, similarity)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["piece", "size", "first", "i1", "i2"])

    return tests.select("item_text", "i1", "i2").mapInArrow(run, "piece long, size int, first int, i1 long, i2 long")


def _slots(hashes: np.ndarray, bits: int, multiplier: int) -> np.ndarray:
    return (hashes * np.uint64(multiplier)) >> np.uint64(64 - bits)


def _filter(found: DataFrame, max_bits: int) -> tuple[np.ndarray, int, list[int]]:
    """The filter's words of 64 bits, the power of two of its size, and the lengths of the runs."""
    told = found.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()  # at most LOOKUP sizes
    bits = min(max_bits, max(6, (64 * told["n"]).bit_length()))

    def marks(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            slots = np.unique(np.concatenate([_slots(h, bits, m) for m in MULTIPLIERS]))
            bit = np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

    words = found.select("piece").mapInArrow(marks, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out, bits, told["sizes"]


def _passing(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    at = np.arange(len(hashes))
    for m in MULTIPLIERS:
        slot = _slots(hashes[at], bits, m)
        at = at[((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)]
    return at


def _meetings(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, similarity: float, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified ``k1, k2, i1, i2, distance, item_words``, the documents' and the items' keys."""
    spark = docs.sparkSession
    key = lambda c: (F.xxhash64(c), F.xxhash64(c, F.lit(1)))
    tests = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    tests = tests.where(F.col("item_text").isNotNull()).select("item_id", "item_text", *(k.alias(n) for k, n in zip(key("item_text"), ("i1", "i2"), strict=True)))
    distinct = tests.select("item_text", "i1", "i2").dropDuplicates(["i1", "i2"])
    found = materialise(_item_pieces(distinct, similarity), "pieces")
    bitmap, bits, sizes = _filter(found, max_bits)
    shared = spark.sparkContext.broadcast(bitmap)  # of bounded size

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = rows.select("doc_id", "text", *(k.alias(n) for k, n in zip(key("text"), ("k1", "k2"), strict=True)))

    def passing(batches):
        let_go()
        table, bitmap = WordHashes(), shared.value

        def flush(batch, first, hashes):
            sizes_of = np.array([len(h) for h in hashes])
            ends = np.cumsum(sizes_of)
            every = np.concatenate(hashes)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, run, place
            for size in sizes:
                runs = run_hashes(every, size)
                at = _passing(runs, bitmap, bits)
                own = np.searchsorted(ends, at, "right")
                whole = at + size <= ends[own]  # not across two texts
                at, own = at[whole], own[whole]
                found.append((own, runs[at].view(np.int64), at - (ends - sizes_of)[own]))
            own, runs, places = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            order = np.argsort(own, kind="stable")
            texts, begins = np.unique(own[order], return_index=True)
            offsets = pa.array(np.append(begins, len(own)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order], k)) for c, k in ((runs, pa.int64()), (places, pa.int32()))]
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(first + texts)).columns, *lists], names=["doc_id", "text", "k1", "k2", "runs", "places"])

        for batch in batches:
            first, waiting, words = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                waiting.append(table.of(words_of(text.as_py())))
                words += len(waiting[-1])
                if words >= TOGETHER or i + 1 == batch.num_rows:
                    yield flush(batch, first, waiting)
                    first, waiting, words = i + 1, [], 0

    held = materialise(rows.mapInArrow(passing, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, k1 long, k2 long, runs array<long>, places array<int>"), "held")
    once = held.select("k1", "k2", "runs", "places").dropDuplicates(["k1", "k2"])
    hits = once.select("k1", "k2", F.inline(F.arrays_zip("runs", "places"))).withColumnsRenamed({"runs": "piece", "places": "place"})
    meet = hits.join(found, "piece").groupBy("k1", "k2", "i1", "i2").agg(F.collect_set(F.col("place") - F.col("first")).alias("starts"))
    pairs = materialise(meet, "meet").join(distinct, ["i1", "i2"]).join(held.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]), ["k1", "k2"])

    def verify(batches):
        last, w, patterns = None, [], {}
        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(("k1", "k2", "i1", "i2", "item_text", "text", "starts"))}
            out: list[tuple] = []
            for i in range(batch.num_rows):
                k1, k2, i1, i2 = (names[n][i].as_py() for n in ("k1", "k2", "i1", "i2"))
                if (k1, k2) != last:
                    last, w = (k1, k2), words_of(names["text"][i].as_py())
                if (i1, i2) not in patterns:
                    if len(patterns) >= 10_000:
                        patterns.clear()
                    item = words_of(names["item_text"][i].as_py())
                    patterns[i1, i2] = item, Myers(item)
                item, myers = patterns[i1, i2]
                k = budget(len(item), similarity)
                if (best := distance(w, item, names["starts"][i].as_py(), k, myers)) <= k:
                    out.append((k1, k2, i1, i2, best, len(item)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "i1", "i2", "distance", "item_words"])

    verified = pairs.select("k1", "k2", "i1", "i2", "item_text", "text", "starts").mapInArrow(verify, "k1 long, k2 long, i1 long, i2 long, distance int, item_words int")
    return materialise(verified, "verified"), held.select("doc_id", "k1", "k2"), tests.select("item_id", "i1", "i2")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, item_id, distance, item_words`` for each text that holds an item."""
    verified, held, tests = _meetings(docs, items, id_col, text_col, item_id_col, item_text_col, similarity, max_bits)
    return held.join(verified, ["k1", "k2"]).join(tests, ["i1", "i2"]).select("doc_id", "item_id", "distance", "item_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged; rows are judged by their own text."""
    verified, _, _ = _meetings(docs, items, id_col, text_col, "item_id", "text", similarity, max_bits)
    a, b = fresh(docs, "k1", "k2")
    gone = materialise(verified.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "gone")
    text = docs[text_col].cast("string")
    return docs.join(gone, (F.xxhash64(text) == gone[a]) & (F.xxhash64(text, F.lit(1)) == gone[b]), "left_anti")
