"""Text quality by histogram gradient-boosted trees over document statistics.

A text becomes a row of statistics of its bytes, words and lines.  Trees of fixed
depth are grown level by level on binned statistics for the logistic loss, and
are kept flattened: one array of split features, one of thresholds and one of
leaf values, with the children of node i at 2i + 1 and 2i + 2.  Scoring walks all
rows through all trees at once in numpy.

Training takes at most about ``MAX_ROWS`` labelled rows, chosen by hash of the
id; scoring covers every row and whole texts.

Defined cases: a null text counts as empty, and an empty text has a score like
any other; labels other than 0 and 1 teach nothing, repeated labels of an id
count once with the larger value; without labels every score is 0.5; repeated
rows are scored alike; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import crc_bucket

#: Labelled rows that are fitted at most (expected number).
MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS = 64
DEPTH = 4
ROUNDS = 120
RATE = 0.1

STATISTICS = (
    "log_bytes log_words mean_word share_upper share_digit share_mark share_symbol share_bar share_bang share_newline share_high"
    " distinct_words top_word next_word distinct_lines top_line words_per_line upper_words marked_words short_words long_words compressed"
    " echoed_words distinct_pairs sentence_ends capital_lines"
).split()

_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_MARK = np.array([ord(c) for c in ".,;:?'\"-()"])
_SYMBOL = np.array([ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"])


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts, line_counts = Counter(words), Counter(lines)
    top = counts.most_common(2)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = [x[0] for x in lines if x]
    return np.array(
        [
            np.log1p(len(raw)),
            np.log1p(len(words)),
            lengths.mean() if len(words) else 0,
            seen[_UPPER].sum() / n,
            seen[_DIGIT].sum() / n,
            seen[_MARK].sum() / n,
            seen[_SYMBOL].sum() / n,
            seen[ord("|")] / n,
            seen[ord("!")] / n,
            seen[10] / n,
            seen[128:].sum() / n,
            len(counts) / w,
            top[0][1] / w if top else 0,
            top[1][1] / w if len(top) > 1 else 0,
            len(line_counts) / len(lines),
            line_counts.most_common(1)[0][1] / len(lines),
            len(words) / len(lines),
            sum(map(str.isupper, words)) / w,
            (len(words) - sum(map(str.isalpha, words))) / w,
            (lengths <= 2).sum() / w,
            (lengths >= 14).sum() / w,
            len(zlib.compress(raw, 1)) / n,
            sum(map(eq, words, words[1:])) / w,
            pairs / w,
            (seen[ord(".")] + seen[ord("?")] + seen[ord("!")]) / w,
            sum(map(str.isupper, first)) / max(1, len(first)),
        ],
        np.float64,
    )


class BoostedTrees:
    """Complete binary trees in flat arrays."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.base = depth, 0.0
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.threshold = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 1.0) -> BoostedTrees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(n, self.base)
        features, thresholds, values = [], [], []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                begin, count = 2**level - 1, 2**level
                local = node - begin
                total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
                best = np.full(count, 1e-6)
                cut = np.full(count, bins)
                for f in range(width):
                    key = local * bins + binned[:, f]
                    left_g = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(axis=1)
                    left_h = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(axis=1)
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    gain[(left_h < least) | (right_h < least)] = 0
                    gain[:, len(edges[f]) :] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(count), at] > best
                    best[better], cut[better] = gain[np.arange(count), at][better], at[better]
                    feature[begin : begin + count][better] = f
                    threshold[begin : begin + count][better] = edges[f][at[better]]
                node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[local])
            leaf = node - (2**self.depth - 1)
            value = -rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + ridge)
            raw += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
        self.feature, self.threshold, self.value = np.array(features), np.array(thresholds), np.array(values)
        return self

    def predict(self, x: np.ndarray, block: int = 2_048) -> np.ndarray:
        """Probability of label 1 for each row."""
        out, trees = np.empty(len(x)), np.arange(len(self.feature))
        for a in range(0, len(x), block):
            part = x[a : a + block]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            raw = self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
            out[a : a + block] = 1 / (1 + np.exp(-raw))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> BoostedTrees:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.where(crc_bucket("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # About max_rows ids at most: small enough to send to every task.
    chosen = texts.join(F.broadcast(marked), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("place")).dropDuplicates(["y", "place"])

    def featurise(batches):
        for batch in batches:
            x = [statistics(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["y", "x", "place"])

    # The least numbers of repeated ids: which rows train never depends on the order of tasks.
    got = chosen.mapInArrow(featurise, "y int, x binary, place long").orderBy("place", "y").limit(2 * max_rows).collect()
    model = BoostedTrees()
    if not got:
        return model
    got.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float64) for r in got])
    return model.fit(x, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_bucket(id_col, 5) == 0).alias("held_out"))

    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if batch.num_rows:
                scores = model.predict(np.stack([statistics(t.as_py()) for t in batch.column(1)]))
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array(predicted)], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
