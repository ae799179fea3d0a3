"""Document fingerprints by randomised edit embedding.

All texts walk by the same random bits: at step j of its walk a text writes out the character it stands
on and goes to the next one if bit (j, character) is set.  Texts a few edits apart fall out of step at an
edit, and soon into step again, so their walks agree at most steps: edit distance becomes Hamming
distance.  A text of n characters makes about 2n steps.

A fingerprint samples ``SAMPLES`` steps of the walk.  Sample k looks at the step whose random number is
the least among those that the text makes: texts of like length look at the same steps, whatever that
length is, and each step is equally likely.  The character found there gives a hexadecimal digit.  The share of equal
digits, less what chance gives, is the likeness of two fingerprints: it estimates the share of steps that agree.

``near_copies`` finds near copies among all texts: digits sampled into bands bring candidates together,
likeness is compared in blocks of bounded size, and the exact edit distance settles each pair.  Walks drift
apart for about the square root of what follows an edit, so copies with many scattered edits in a short
text may go unfound; measured figures are in the README.

Defined cases: a null text is empty; equal texts have equal fingerprints, the empty ones too; rows that share an
id are documents of their own, ordered by a hash of their texts; a null id comes after all others; an empty
table gives an empty result; a single document is its own next one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._common import materialise

SAMPLES = 256
SEED = 11
#: Kinds of characters that have random bits of their own; a step at least so often goes on for all.
KINDS, FORCED = 64, 32
#: Texts that walk together, in characters, and cells of a block of steps.
GROUP_CHARS, CELLS = 6 << 20, 1 << 20
#: Walks of ``near_copies`` by random bits of their own, bands of each, and digits of a band at least.
WALKS, BANDS, BAND_DIGITS = 4, 16, 6
#: Texts of a band's bucket that are compared at once.
CHUNK = 1_024
SIMILARITY = 0.8
#: Likeness of fingerprints from which on the texts are compared.
LIKENESS = 0.35
_PAD = 0xFFFFFFFF
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Fixed mixing of 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walker:
    """The shared random bits, the sampled steps, and walks of many texts side by side."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        self.samples, self.seed = samples, np.uint64(seed)
        self.salt = _mix(np.arange(samples, dtype=np.uint64) + _mix(self.seed + np.arange(1, dtype=np.uint64)))
        #: Steps that some sample looks at, with the sample, for all steps below ``known``.
        self.known = 0
        self.steps, self.of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._windows: dict[int, np.ndarray] = {}

    def _records(self, upto: int) -> None:
        """Sample k's steps are the records of random numbers: after a record r, none follows up to m with
        probability (r + 1) / (m + 1)."""
        if upto < self.known:
            return
        self.known = max(1 << 20, 2 * upto)
        at, k, found = np.zeros(self.samples, np.int64), np.arange(self.samples), []
        for n in range(1_000):
            live = at < self.known
            if not live.any():
                break
            at, k = at[live], k[live]
            found.append((at, k))
            chance = ((_mix(self.salt[k] + np.uint64(n)) >> np.uint64(11)).astype(float) + 1) / 2**53
            at = np.floor(np.minimum((at + 1) / chance, 1e15)).astype(np.int64)
        steps, of = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        order = np.lexsort((of, steps))
        self.steps, self.of = steps[order], of[order]

    def _window(self, base: int, width: int) -> np.ndarray:
        """For each step from ``base`` on and kind of character, the step at which the next one is written."""
        j = np.arange(base, base + width + FORCED, dtype=np.uint64)
        bits = _mix(j ^ (self.seed << np.uint64(32)))
        go = ((bits[:, None] >> np.arange(KINDS, dtype=np.uint64)) & np.uint64(1)).astype(bool)
        go[j % FORCED == FORCED - 1] = True
        step = np.where(go, np.arange(1, len(j) + 1, dtype=np.int32)[:, None], np.int32(2**31 - 1))
        return np.ascontiguousarray(np.minimum.accumulate(step[::-1])[::-1][:width]).ravel()

    def _bits(self, base: int, width: int) -> np.ndarray:
        if base:
            return self._window(base, width)
        if width not in self._windows:
            if len(self._windows) > 8:
                self._windows.clear()
            self._windows[width] = self._window(0, width)
        return self._windows[width]

    def fingerprints(self, texts: list[str]) -> list[str]:
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        order = np.argsort(-sizes, kind="stable")
        seen = np.full((len(texts), self.samples), _PAD, np.uint64)
        at, live, done = np.zeros(len(texts), np.int64), int((sizes > 0).sum()), 0
        self._records(int(sizes.max(initial=0)) * 4 + 64)
        while live:
            block = int(max(64, min(4_096, CELLS // live, -(-int(sizes[order[0]] - done) // 64) * 64)))
            own = order[:live]
            at[own] = self._block(points, sizes, own, done, block, at[own], seen)
            done += block
            live = int((sizes > done).sum())
        digit = (_mix(seen * np.uint64(0x632BE59BD9B4E019) + self.salt) >> np.uint64(60)).astype(np.uint8)
        return [row.tobytes().decode() for row in _HEX[digit]]

    def _block(self, points, sizes, own, done: int, block: int, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The next ``block`` characters of the texts ``own``, which stand at steps ``at``."""
        n = np.minimum(sizes[own] - done, block)
        held = np.zeros((len(own), block), np.uint32)
        for lane, (i, size) in enumerate(zip(own.tolist(), n.tolist(), strict=True)):
            held[lane, :size] = points[i][done : done + size]
        kinds = ((held * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32)
        # A window begins at a whole multiple, so that the first ones can be kept.
        base = int(at.min()) // 64 * 64
        width = -(-(3 * block + int(at.max()) - base + 64) // 1024) * 1024
        while True:
            bits, place = self._bits(base, width), np.empty((block + 1, len(own)), np.int32)
            place[0] = at - base
            cell = np.ascontiguousarray(kinds.T)
            for s in range(block):
                np.take(bits, place[s] * KINDS + cell[s], out=place[s + 1], mode="clip")
            if int(place[-1].max()) < width:
                break
            width *= 2
        steps = np.ascontiguousarray(place.T)
        ends = np.take_along_axis(steps, n[:, None], 1)[:, 0].astype(np.int64) + base
        low, high = np.searchsorted(self.steps, at), np.searchsorted(self.steps, ends)
        for lane, (i, size, a, z) in enumerate(zip(own.tolist(), n.tolist(), low.tolist(), high.tolist(), strict=True)):
            if a < z:
                where = np.searchsorted(steps[lane, : size + 1], self.steps[a:z] - base, "right") - 1
                seen[i, self.of[a:z]] = held[lane, where]  # a sample's later step is written later
        return ends


_walkers: dict[tuple[int, int], Walker] = {}


def walker(samples: int = SAMPLES, seed: int = SEED) -> Walker:
    """One walker for each choice and worker process."""
    if (samples, seed) not in _walkers:
        _walkers[samples, seed] = Walker(samples, seed)
    return _walkers[samples, seed]


def likeness(a: str, b: str) -> float:
    """The share of equal digits, less what chance gives: 1 for equal fingerprints, about 0 for unlike ones."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return max(0.0, (float((x == y).mean()) - 1 / 16) / (1 - 1 / 16))


def _groups(texts: list[str], limit: int = GROUP_CHARS):
    """Stretches of texts, about so many characters together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, seed: int = SEED, walks: int = 1) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row, in one narrow pass; the digits of several walks one after another."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in _groups(texts):
                told = map("".join, zip(*(walker(samples, seed + n).fingerprints(texts[a:z]) for n in range(walks)), strict=True))
                found = [batch.column(0).slice(a, z - a), pa.array([len(t) for t in texts[a:z]], pa.int64()), pa.array(list(told), pa.string())]
                yield pa.RecordBatch.from_arrays(found, names=["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the next one's beginning, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


FIGURES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(w: Walker, rows: list[tuple], known: str | None) -> tuple[list[tuple], str]:
    """Figures of all but the last of these consecutive ``id, text``, and the last one's fingerprint.

    ``known`` is the first one's fingerprint, if it has been told.
    """
    texts = [t for _, t in rows]
    changed = [edited(t, after) for t, after in zip(texts, texts[1:], strict=False)]
    new = texts[1:] if known else texts
    found = w.fingerprints(new + changed)
    own, other = [known] * bool(known) + found[: len(new)], found[len(new) :]
    out = [
        (i, len(t), hashlib.sha256(c.encode()).hexdigest(), f, e, likeness(f, e), likeness(f, g))
        for (i, t), c, f, e, g in zip(rows, changed, own, other, own[1:], strict=False)
    ]
    return out, own[-1]


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document, by falling id.

    The rows are sorted in ranges.  A range's last document meets the first one of the next range behind it;
    only these two rows of each range are written with their texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()
    figures = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def batch_of(found: list[tuple], id_type, end: str | None = None, part: int = 0, text: str | None = None) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
        more = [pa.array([x] * len(found), t) for x, t in ((end, pa.string()), (part, pa.int64()), (text, pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*FIGURES, "end", "part", "text"])

    def walk(batches):
        w, part, last, known, id_type = walker(samples, seed), TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            id_type = batch.column(0).type
            every = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for a, z in _groups([t for _, t in every], GROUP_CHARS // 2):
                if last is None:
                    yield batch_of([(every[a][0], *[None] * 6)], id_type, "first", part, every[a][1])
                found, known = _compared(w, [last] * (last is not None) + every[a:z], known)
                last = every[z - 1]
                if found:
                    yield batch_of(found, id_type)
        if last is not None:
            yield batch_of([(last[0], len(last[1]), None, known, None, None, None)], id_type, "last", part, last[1])

    walked = materialise(rows.mapInArrow(walk, f"{figures}, end string, part long, text string"), "walked")
    order = Window.orderBy("part")  # a row for each range
    firsts = walked.where("end = 'first'").select("part", F.col("text").alias("after"))
    ring = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("behind"))
    lasts = walked.where("end = 'last'").select("part", "doc_id", "text", "fingerprint")
    seams = lasts.join(ring, "part").join(firsts.withColumnRenamed("part", "behind"), "behind").select("doc_id", "text", "fingerprint", "after")

    def seam(batches):
        w = walker(samples, seed)
        for batch in batches:
            for doc_id, text, known, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = _compared(w, [(doc_id, text), (None, after)], known)
                yield batch_of(found, batch.column(0).type).select(FIGURES)

    return walked.where("end IS NULL").select(*FIGURES).unionByName(seams.mapInArrow(seam, figures))


def _bands(count: int, walks: int, bands: int, samples: int = SAMPLES) -> np.ndarray:
    """The digits of each band, all of one walk: more of them the more texts there are, so that chance fills no bucket."""
    digits = max(BAND_DIGITS, int(np.ceil(np.log2(max(2, count)) / 4)))
    rng = np.random.default_rng(SEED)
    return np.stack([walk * samples + rng.choice(samples, digits, replace=False) for walk in range(walks) for _ in range(bands)])


def _buckets(prints: pa.ChunkedArray | pa.Array, bands: np.ndarray) -> np.ndarray:
    """A 64-bit number of each fingerprint's digits in each band."""
    raw = np.frombuffer("".join(prints.to_pylist()).encode(), np.uint8).reshape(len(prints), -1)
    out = np.zeros((len(raw), len(bands)), np.uint64)
    for digit in bands.T:
        out = _mix(out ^ raw[:, digit])
    return out.view(np.int64)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least: float = LIKENESS, walks: int = WALKS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, class_id`` of every document, equal texts being a class named by its least id, and the links
    ``a, b, edits`` between classes found whose edit distance is at most ``1 - similarity`` of the longer text.

    Texts take several walks, as each may drift apart by itself: a pair meets in a band of any of them, and its
    likeness is the best of them.  Rows with a null id take no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    digest = F.sha2("text", 256).alias("digest")
    texts = materialise(rows.groupBy(digest).agg(F.min("doc_id").alias("class_id"), F.first("text").alias("text")), "texts")
    members = rows.select("doc_id", digest).join(texts.select("digest", "class_id"), "digest").select("doc_id", "class_id")
    prints = materialise(fingerprint(texts, "class_id", walks=walks).withColumnRenamed("doc_id", "class_id"), "prints")
    chosen = _bands(prints.count(), walks, bands)

    def keys(batches):
        for batch in batches:
            found = _buckets(batch.column(1), chosen)
            ids = np.repeat(batch.column(0).to_numpy(), len(chosen))
            band = np.tile(np.arange(len(chosen), dtype=np.int32), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(found.ravel()), pa.array(ids)], names=["band", "bucket", "class_id"])

    bucket = ["band", "bucket"]
    held = materialise(prints.select("class_id", "fingerprint").mapInArrow(keys, "band int, bucket long, class_id long"), "buckets")
    shared = materialise(held.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    met = held.join(shared, bucket).join(prints, "class_id")
    own = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, n, part = (table.column(c).to_numpy() for c in ("class_id", "n_chars", "own"))
        raw = np.frombuffer("".join(table.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(len(ids), -1)
        found = _buckets(table.column("fingerprint"), chosen)
        band = table.column("band")[0].as_py()
        out: list[list] = [[], []]
        for x in np.flatnonzero(part == i).tolist():
            near = (part == j) & (ids > ids[x] if i == j else ids != ids[x])
            near &= np.abs(n - n[x]) <= (1 - similarity) * np.maximum(n, n[x])
            y = np.flatnonzero(near)
            agree = (raw[y] == raw[x]).reshape(len(y), walks, raw.shape[1] // walks).mean(axis=2).max(axis=1, initial=0)
            agree = (agree - 1 / 16) / (1 - 1 / 16)
            y = y[agree >= least]
            y = y[~(found[y, :band] == found[x, :band]).any(axis=1)]  # a pair is told by its first band only
            out[0] += np.minimum(ids[y], ids[x]).tolist()
            out[1] += np.maximum(ids[y], ids[x]).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    pairs = materialise(met.groupBy(*bucket, "i", "j").applyInArrow(compare, "a long, b long"), "pairs")

    def verify(batches):
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            most = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(left, right, strict=True)]
            edits = [edit_distance(x, y, m) for x, y, m in zip(left, right, most, strict=True)]
            kept = [k for k, (e, m) in enumerate(zip(edits, most, strict=True)) if e <= m]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in kept], pa.int64()) for c in (a, b, edits)], names=["a", "b", "edits"])

    side = lambda c: texts.select(F.col("class_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return members, both.mapInArrow(verify, "a long, b long, edits long")


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two texts by Myers' bit-parallel columns, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    n = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = full, 0, len(b)
    for i, c in enumerate(a):
        match = masks.get(c, 0)
        cross = match | minus
        same = (((match & plus) + plus) ^ plus) | match
        up, down = minus | (full & ~(same | plus)), plus & same
        score += bool(up & top) - bool(down & top)
        if score - (len(a) - i - 1) > most:
            return most + 1
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(cross | up)), up & cross
    return min(score, most + 1)
