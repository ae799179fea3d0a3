"""Language identification by hierarchical discrimination.

A text is the square-rooted shares of its hashed letter trigrams.  Families of
related languages are learned: languages whose mean texts are alike are merged, by
average linkage, into about as many families as a family has members.  One-versus-one
linear support vector machines first tell families apart, then, inside the winning
family, its closely related languages.  Each machine's margin is calibrated on
held-back training rows; the score of a prediction is the product of the winner's
least pairwise confidence at both levels.

Training takes at most about ``PER_LANGUAGE`` labelled rows of each language and
about ``MAX_ROWS`` in all (fewer of each where languages are many), chosen by hash;
every language is learned, and everything else covers all rows and whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
labels that are null teach nothing; without any usable label every text is
``und``; a single learned language is predicted with score 1; ties between
languages go to the alphabetically first; repeated rows are predicted alike; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import crc_bucket, let_go

UNDETERMINED = "und"
BITS = 12
#: Labelled rows of each language that are fitted (expected number).
PER_LANGUAGE = 500
#: Labelled rows that are fitted in all (expected number); bounds what reaches the driver.
MAX_ROWS = 20_000

_LETTER = regex.compile(r"\p{L}")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_ASCII_ONLY_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def trigram_shares(text: str | None) -> np.ndarray | None:
    """Square-rooted shares of hashed byte trigrams of the lower-cased letters."""
    if not text:
        return None
    if text.isascii():
        raw = text.lower().encode().translate(_ASCII_ONLY_LETTERS).split()
    else:
        if not _LETTER.search(text):
            return None
        raw = _NOT_LETTER.sub(" ", unicodedata.normalize("NFC", text).lower()).encode("utf-8", "replace").split()
    if not raw:
        return None
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    counts = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(data) - 2, 1 << 20):
        b = data[a : a + (1 << 20) + 2].astype(np.uint32)
        key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        counts += np.bincount((key * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss.

    Classes weigh alike.  Accelerated gradient descent from zero.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (2.0 * float((weight * (x * x).sum(axis=1)).sum()) + penalty)
    w = v = np.zeros(x.shape[1], np.float32)
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = penalty * v - 2 * (x.T @ (weight * y * slack))
        ahead = v - rate * gradient
        v, w = ahead + (step - 1) / (step + 2) * (ahead - w), ahead
    return w


def fit_scale(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve over margins, by Newton steps."""
    slope, z = 1.0, margin * y
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * z, -30, 30)))
        first, second = ((1 - p) * z).mean() - 1e-3 * slope, -(p * (1 - p) * z * z).mean() - 1e-3
        slope = float(np.clip(slope - first / second, 0.1, 50))
    return slope


class OneVersusOne:
    """Pairwise machines among classes, with votes by calibrated confidence."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels))
        self.pairs, weights, scales = list(combinations(range(len(self.classes)), 2)), [], []
        for a, b in self.pairs:
            rows = np.flatnonzero((labels == self.classes[a]) | (labels == self.classes[b]))
            y = np.where(labels[rows] == self.classes[a], 1.0, -1.0).astype(np.float32)
            held = np.arange(len(rows)) % 5 == 4
            if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
                held[:] = False
            w = fit_svm(x[rows][~held], y[~held])
            check = held if held.any() else ~held
            scales.append(fit_scale(x[rows][check] @ w[:-1] + w[-1], y[check]))
            weights.append(w)
        self.weights = np.array(weights, np.float32).reshape(len(self.pairs), x.shape[1] + 1)
        self.scales = np.array(scales)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class and its least pairwise confidence."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = (x @ self.weights[:, :-1].T + self.weights[:, -1]) * self.scales
        sure = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        votes, least = np.zeros((n, k)), np.ones((n, k))
        for j, (a, b) in enumerate(self.pairs):
            votes[:, a] += (sure[:, j] >= 0.5) + 1e-6 * sure[:, j]
            votes[:, b] += (sure[:, j] < 0.5) + 1e-6 * (1 - sure[:, j])
            least[:, a] = np.minimum(least[:, a], sure[:, j])
            least[:, b] = np.minimum(least[:, b], 1 - sure[:, j])
        best = votes.argmax(axis=1)
        return best, least[np.arange(n), best]


def learned_families(means: np.ndarray) -> list[int]:
    """The family of each language, named by its first member, from the languages' mean texts.

    The two most alike families are merged while there are more than the square root
    of the languages; none grows beyond twice that, which bounds its machines.
    """
    k = len(means)
    wanted = int(np.ceil(np.sqrt(k)))
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike, size, family = unit @ unit.T, np.ones(k, int), np.arange(k)
    np.fill_diagonal(alike, -np.inf)
    for _ in range(k - wanted):
        fits = np.where(size[:, None] + size[None, :] <= 2 * wanted, alike, -np.inf)
        a, b = sorted(np.unravel_index(fits.argmax(), fits.shape))
        if fits[a, b] == -np.inf:
            break
        row = (size[a] * alike[a] + size[b] * alike[b]) / (size[a] + size[b])
        row[[a, b]] = -np.inf
        alike[a], alike[:, a] = row, row
        alike[b], alike[:, b] = -np.inf, -np.inf
        size[a] += size[b]
        family[family == b] = a
    return family.tolist()


class LanguageModel:
    """Families first, then the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs, dtype=object)
        self.empty = not len(labels)
        if self.empty:
            return
        known = sorted(set(langs))
        family = learned_families(np.stack([x[labels == lang].mean(axis=0) for lang in known]))
        self.family = {lang: known[f] for lang, f in zip(known, family, strict=True)}
        families = np.array([self.family[v] for v in langs], dtype=object)
        self.top = OneVersusOne(x, families)
        self.within = {f: OneVersusOne(x[families == f], labels[families == f]) for f in self.top.classes}

    def predict(self, texts: list[str | None], block: int = 256) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for a in range(0, 0 if self.empty else len(texts), block):
            seen = [(i, x) for i in range(a, min(len(texts), a + block)) if (x := trigram_shares(texts[i])) is not None]
            if not seen:
                continue
            rows, x = np.array([i for i, _ in seen]), np.stack([v for _, v in seen])
            family, sure = self.top.predict(x)
            for k in np.unique(family):
                at, machine = family == k, self.within[self.top.classes[k]]
                best, confidence = machine.predict(x[at])
                scores[rows[at]] = sure[at] * confidence
                for i, b in zip(rows[at], best, strict=True):
                    langs[i] = machine.classes[b]
        return langs, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Fit on labelled rows whose crc32(id as text) mod 3 is not 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket("doc_id", 3) != 1))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return LanguageModel(np.zeros((0, 1 << BITS), np.float32), [])
    per_language = min(per_language, max(1, max_rows // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    place = F.xxhash64("doc_id", "text")
    chosen = rows.where(F.pmod(place, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    chosen = chosen.select("lang", "text", place.alias("place")).dropDuplicates(["lang", "place"])

    def featurise(batches):
        for batch in batches:
            told = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)
            kept = [(lang, x.astype(np.float16).tobytes(), place) for lang, t, place in told if (x := trigram_shares(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "x", "place"])

    # The least numbers, should chance exceed the bound: which rows train never depends on the order of tasks.
    got = chosen.mapInArrow(featurise, "lang string, x binary, place long").orderBy("place", "lang").limit(2 * per_language * len(counts)).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    order = np.random.default_rng(0).permutation(len(got))
    x = np.stack([np.frombuffer(got[i]["x"], np.float16).astype(np.float32) for i in order]) if got else np.zeros((0, 1 << BITS), np.float32)
    return LanguageModel(x, [got[i]["lang"] for i in order])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_bucket(id_col, 3) == 1).alias("held_out"))

    def run(batches):
        let_go()
        for batch in batches:
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows whose language can be told, all columns unchanged."""
    import pandas as pd

    def told(texts):
        let_go()
        langs, scores = model.predict(texts.tolist())
        return pd.Series([v != UNDETERMINED and s >= min_score for v, s in zip(langs, scores, strict=True)], dtype=bool)

    return docs.where(F.pandas_udf(told, "boolean")(F.col(text_col)))
