"""Edit embedding, alignment and prefix trie against plain versions; their odd cases; broken pages and long chunks."""

import hashlib
import math
import random
import re
import resource
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cairn.llm import alignment, ann, edit_embedding, html_extract, packing, prefix_trie, queries, token_counts, words

DOCS = "doc_id long, text string, number int, fingerprint string, block long"
ODD = [(1, None, 0, "x", 1), (2, "", 0, "x", 1), (3, "é▁ ﬁ", 0, "x", 1), (4, "alpha beta gamma " * 3_000, 0, "x", 1), (5, "same text", 0, "x", 1), (5, "same text", 0, "x", 1), (None, "no number", 0, None, 1), (6, "same text", 0, "x", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------- edit embedding


def plain_walk(text, w):
    """The walk step by step, and the digits of its sampled steps."""
    at, steps = 0, []
    for c in text:
        kind = ((ord(c) * 2654435761) & 0xFFFFFFFF) >> 26
        while True:
            steps.append(ord(c))
            bits = int(edit_embedding._mix(np.array([at], np.uint64) ^ (w.seed << np.uint64(32)))[0])
            go = at % edit_embedding.FORCED == edit_embedding.FORCED - 1 or bits >> kind & 1
            at += 1
            if go:
                break
    seen = [edit_embedding._PAD] * w.samples
    for step, k in zip(w.steps.tolist(), w.of.tolist(), strict=True):
        if step < len(steps):
            seen[k] = steps[step]
    digits = edit_embedding._mix(np.array(seen, np.uint64) * np.uint64(0x632BE59BD9B4E019) + w.salt) >> np.uint64(60)
    return "".join("0123456789abcdef"[d] for d in digits)


def test_walks_side_by_side_are_the_plain_ones(spark, sf):
    texts = [t[:700] for (t,) in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("text").limit(12).collect()] + ["", "a", "ab" * 300, "中文🙂"]
    w = edit_embedding.walker()
    together = w.fingerprints(texts)
    assert together == [plain_walk(t, w) for t in texts] == [w.fingerprints([t])[0] for t in texts]


def test_op11_against_a_plain_pass(spark, sf):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in queries.op11_edit_embedding(spark, sf).collect()}
    w = edit_embedding.walker()
    own = w.fingerprints([t for _, t in rows])
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        j = (i + 1) % len(rows)
        n = len(text) // 3
        edited = text[: len(text) - n] + rows[j][1][:n]
        print_ = w.fingerprints([edited])[0]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own[i], print_, edit_embedding.likeness(own[i], print_), edit_embedding.likeness(own[i], own[j]))
        assert tuple(got[doc_id])[1:] == want
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 and np.mean([r["near_next"] for r in long if r["near_next"] < 1]) < 0.2


def test_op11_odd_cases(spark, odd, none):
    rows = edit_embedding.against_next(odd.repartition(5)).collect()
    assert len(rows) == len(ODD) and edit_embedding.against_next(none).count() == 0
    empty = {r["fingerprint"] for r in rows if r["n_chars"] == 0}
    assert len(empty) == 1 and len({r["fingerprint"] for r in rows if r["n_chars"] == 9 and r["doc_id"] in (5, 6)}) == 1
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    one = edit_embedding.against_next(odd.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(ODD[3][1])


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(2_000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        most = rng.randrange(12)
        assert edit_embedding.edit_distance(a, b, most) == min(plain(a, b), most + 1)


def test_near_copies(spark, sf, odd, none):
    rng, rows = random.Random(5), []
    base = [t for (t,) in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) BETWEEN 800 AND 4000").select("text").distinct().limit(12).collect()]
    for i, t in enumerate(base):
        for c in range(4):
            s = list(t)
            for _ in range(c):
                s[rng.randrange(len(s))] = "Q"
            rows.append((10 * i + c, "".join(s)))
        rows.append((10 * i + 5, t))
    members, links = edit_embedding.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    classes, found = {r["doc_id"]: r["class_id"] for r in members.collect()}, {(r["a"], r["b"]): r["edits"] for r in links.collect()}
    least: dict = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    assert classes == {i: least[t] for i, t in rows}
    reps, want = sorted((i, t) for t, i in least.items()), {}
    for x, (a, s) in enumerate(reps):
        for b, t in reps[x + 1 :]:
            most = int(0.2 * max(len(s), len(t)) + 1e-9)
            if (e := edit_embedding.edit_distance(s, t, most)) <= most:
                want[a, b] = e
    assert all(want[p] == e for p, e in found.items()) and len(found) >= 0.9 * len(want)
    members, links = edit_embedding.near_copies(odd)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert edit_embedding.near_copies(none)[0].count() == 0 and edit_embedding.near_copies(none)[1].count() == 0


# ------------------------------------------------------------------ alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_JSON))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_MODEL)), alignment.Tokenizers()


def plain_alignment(text, libraries):
    """``n_a, n_b, groups, links`` by the libraries, or None."""
    a_lib, b_lib, t = libraries
    if not text:
        return None
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    if not t.exact((" " + text).encode(), a, b):
        return None
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    ends_a, ends_b = ends(a, t.a_bytes), ends(b, t.b_bytes)
    groups, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        k, m = i, j
        while i < len(a) and ends_a[i] <= e:
            i += 1
        while j < len(b) and ends_b[j] <= e:
            j += 1
        groups.append((a[k:i], b[m:j]))
    return len(a), len(b), groups, Counter((x, y) for p, q in groups for x in p for y in q)


def check_alignment(rows, got, libraries):
    told = [plain_alignment(t, libraries) for _, t in rows]
    docs = Counter(p for x in told if x for p in x[3])
    best: dict = {}
    for (a, _), n in docs.items():
        best[a] = max(n, best.get(a, 0))
    want = []
    for (doc_id, _), x in zip(rows, told, strict=True):
        if x is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2]).encode()).hexdigest()
        want.append((doc_id, x[0], x[1], len(x[2]), sum(x[3].values()), sum(n for p, n in x[3].items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in x[3].items()), digest))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op12_against_the_libraries(spark, sf, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_alignment(rows, queries.op12_cross_tokenizer(spark, sf).collect(), libraries)


def test_op12_odd_cases(spark, odd, none, libraries, monkeypatch):
    rng = random.Random(2)
    letters = ["a", "the ", " ", "  ", "\n", "\t", "é", "▁", "中文", "🙂", "<|endoftext|>", "<s>", "</s>", "12", "x" * 80, " " * 9, "\u0000", " ", "½", "-", "́"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))) for i in range(150)] + [(900, "a" * 40_000), (901, " " * 500), (902, "ab " * 20_000)] + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_alignment(rows, alignment.align(df).collect(), libraries)
    assert alignment.align(odd).count() == len(ODD) and alignment.align(none).count() == 0
    told = alignment.align(odd, with_groups=True).where("doc_id = 4").first()
    assert hashlib.sha256(told["groups"].encode()).hexdigest() == told["groups_sha256"]
    monkeypatch.setattr(alignment, "CHUNKS", 50)  # long texts in slices, a table that is emptied
    encoder = alignment.Encoder(alignment.Tokenizers(), table_bytes=4_000)
    plain = alignment.Encoder(alignment.Tokenizers())
    texts = [t for _, t in rows]
    assert list(encoder.all(texts)) == [plain._both(" " + t) if t else None for t in texts]


def test_bitmaps_come_back():
    rng = np.random.default_rng(1)
    pairs = np.array([5, (9 << alignment.ID_BITS) | 7, (9 << alignment.ID_BITS) | 8], np.int64)
    n = [60_000, 300, 1]
    keys, links = [], []
    for pair, size in zip(pairs, n, strict=True):
        docs = rng.choice(1 << 16, size, replace=False).astype(np.int64)
        keys.append((pair << alignment.DOC_BITS) | docs)
        links.append(rng.integers(1, 40, size))
    keys, links = np.concatenate(keys), np.concatenate(links)
    table = alignment.bitmaps(keys, links)
    assert table.column("docs").to_pylist() == n and sum(table.column("links").to_pylist()) == links.sum()
    row, doc, weight = alignment.postings(table.column("planes"))
    got: Counter = Counter()
    for r, d, w in zip(row.tolist(), doc.tolist(), weight.tolist(), strict=True):
        got[r, d] += w
    assert got == Counter({(int(np.searchsorted(pairs, k >> alignment.DOC_BITS)), int(k & 0xFFFF)): int(v) for k, v in zip(keys.tolist(), links.tolist(), strict=True)})
    spread = alignment.bitmaps(np.repeat(keys, links), None)
    assert spread.equals(table)


# ---------------------------------------------------------------- prefix trie

TURNS = "conv_id long, turn long, role string, text string, part long"


def plain_trie(rows):
    convs: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built, nodes, children = {}, {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*convs.get(c - int(math.fmod(c, 20)), [])[:h], *own[h:])
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        below, members = children.get(p, []), nodes[p]
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **how):
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.shared_heads(prefix_trie.ordered(df)), **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"segment": 4, "ranges": 9}])
def test_op13_against_a_plain_trie(spark, how):
    rng = random.Random(3)
    rows = [(c if rng.random() < 0.98 else None, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, " d\te "]), 1) for c in [rng.choice(range(-25, 90)) for _ in range(800)]]
    rows += [(7, t, "user", "x", 1) for t in range(300)] + [(8, t, "user", "x", 1) for t in range(260)] + [(c, 1, "user", "same", 1) for c in range(200, 290)] + [(c, t, "user", "deep", 1) for c in range(400, 420) for t in range(20)]
    rows += rows[-3:] + [(500, 1, "user", "w " * 50_000, 1)]
    assert trie(spark.createDataFrame(rows, TURNS).repartition(5), **how) == plain_trie(rows)


def test_op13_on_the_table_and_on_none(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, sf).collect()), key=str) == plain_trie(rows)
    assert trie(spark.createDataFrame([], TURNS)) == []


def test_sparse_table_extents():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, 70)
    table = prefix_trie.SparseTable(values)
    for _ in range(300):
        i, need = int(rng.integers(70)), int(rng.integers(7))
        left = right = i
        while left > 0 and values[left] >= need:
            left -= 1
        while right < 69 and values[right + 1] >= need:
            right += 1
        got = table.extents(np.array([i]), np.array([need]))
        assert (int(got[0][0]), int(got[1][0])) == (left, right)
        a, z = sorted(rng.integers(0, 70, 2))
        assert int(table.least(np.array([a]), np.array([z]))[0]) == values[a : z + 1].min()


# ----------------------------------------------------- older operators, mended


@pytest.mark.parametrize("unit", ["<p a='", "<em></i>", "<a ", '<p ">" ', "<svg/>", "<![CDATA[", "<b><p></p>", "<a '\">", "<!--x", "<i><div></b>"])
def test_broken_pages_take_linear_time(unit):
    page = unit * (250_000 // len(unit))
    took = []
    for text in (page, page * 4 + ">"):
        began = time.process_time()
        html_extract.blocks(text)
        took.append(time.process_time() - began)
    assert took[1] < 30 and took[1] < 12 * took[0] + 2


def test_long_chunks_are_not_kept():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counter, ids = token_counts.MergeCounter(words.vocabulary_path()), packing.IdBytes(words.vocabulary_path())
    for i in range(20_000):
        chunk = "".join(chr(0x4E00 + (i * 7 + j) % 5_000) for j in range(100))
        if i < 1_500:
            counter.count(chunk)
        ids.of(chunk)
    assert len(counter.table) == len(ids.table) == 0 and not counter.table.words and not ids.table.words
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400


def test_tables_of_chunks_are_bounded_by_bytes():
    ids = packing.IdBytes(words.vocabulary_path(), 100_000)
    for i in range(5_000):
        ids.of(f"word{i} und{i}é")
        assert ids.table.held <= 100_000
    assert ids.of("alpha beta") == packing.IdBytes(words.vocabulary_path()).of("alpha beta")


def test_recall_holds_as_a_table_grows():
    rng = np.random.default_rng(0)
    for n in (20_000, 200_000):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        asked = rng.standard_normal((60, 64))
        true = np.argsort(-(asked @ x.T), axis=1)[:, :5]
        h = ann.CrossPolytope(64, ann.TABLES, ann.code_bits(n))
        met = np.zeros(true.shape, bool)
        for t in range(ann.TABLES):
            probes = h.probes(asked, t, ann.probe_count(n))
            codes = h.codes(x[true.ravel()], t).reshape(true.shape)
            met |= (probes[:, None, :] == codes[:, :, None]).any(axis=2)
        assert met.mean() >= 0.9
