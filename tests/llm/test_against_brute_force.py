"""Each operator against a plain version of its contract, or held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import ann, chat, components, decontam, html_extract, line_dedup, packing, quality, queries, simhash_dedup, token_counts, words


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(words.vocabulary_path())


ODD = [*"abcAZé É'ßİΣσς \x1c\x85\xa0!?.'s12½Ⅷ中文한글🙂\n\t-_", "́", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'RE", "'ve ", "ſ", "K"]


def test_token_counts_match_the_library(spark, sf, texts, tokenizer):
    rows = queries.op3_token_counts(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    rng, counter = random.Random(1), token_counts.MergeCounter(words.vocabulary_path(), 100)
    for _ in range(2_000):
        t = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 20)))
        assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), t


def test_packing_keeps_every_id_once(spark, sf, texts, tokenizer):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), with_ids=True).collect()
    digest = {(r["doc_id"], r["start"]): r for r in queries.op1_best_fit_packing(spark, sf).collect()}
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] == digest[r["doc_id"], r["start"]]["ids_crc32"]
    for i, t in texts.items():
        ids = [x for r in sorted(pieces[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] and len(ids) == pieces[i][0]["doc_tokens"]
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(n for s in windows.values() for _, n in s) > 0.95 * 2048 * len(windows)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 31) for _ in range(rng.randint(1, 50))])
        place, _, used = packing.best_fit_decreasing(lengths, 32)
        room: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(32 - n)
        assert used == len(room) and sorted(32 - np.bincount(place, lengths, used)) == sorted(room)


def test_language_accuracy(spark, sf):
    rows = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_quality_ranks_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    rows = queries.op4_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    model = quality.BoostedTrees(3).fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), rounds=10)

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.predict(x), [walk(r) for r in x])


def test_ann_recall_and_scores(spark, sf):
    rows = queries.op5_ann(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table}
    unit = {k: v / np.linalg.norm(v) for k, v in x.items()}
    hit = total = 0
    for q in (k for k in x if k % 50 == 0):
        best = sorted((-(unit[q] @ unit[k]), k) for k in x if k != q)[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(s - unit[q] @ unit[v]) < 1e-12 for _, v, s in got)
        hit, total = hit + len({v for _, v, _ in got} & {v for _, v in best}), total + 5
    assert hit >= 0.9 * total


def test_ann_deals_hot_buckets(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(int(i), [float(v) for v in (base if i % 3 == 0 else base + rng.normal(size=16) * 0.01)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = ann.nearest(df, F.col("id") % 50 == 0, probes=32).orderBy("query_id", "rank").collect()
    dealt = ann.nearest(df, F.col("id") % 50 == 0, probes=32, chunk=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in whole] == [(r["query_id"], r["vec_id"]) for r in dealt] and len(whole) == 60


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line number {i} with enough letters" for i in range(8)] + ["short", "", "  LINE number 1 with enough letters\t"]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for i in range(60)}
    holders: dict[str, set] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = {}
    for i, t in docs.items():
        kept = [x for x in t.split("\n") if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        want[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(df, counts=("a", "b")).collect()
    assert {r["doc_id"]: (r["a"], r["b"], r["text"]) for r in got} == want


def test_line_store_adds_batches_in_any_order(spark):
    rows = [(h, d) for d in range(40) for h in range(5) if (d * 7 + h) % 3]
    df = spark.createDataFrame([(h, h, d) for h, d in rows], "h1 long, h2 long, doc_id long")
    want = {h: max(d for g, d in rows if g == h) for h in range(5)}
    for order in (range(4), reversed(range(4))):
        store = line_dedup.LineStore(spark)
        for b in order:
            store.add(df.where(F.floor(F.col("doc_id") / 10) == b))
        got = store.totals().collect()
        assert {r["h1"]: r["largest"] for r in got} == want and all(r["docs"] >= 3 for r in got)
        assert all(len(level) < line_dedup.FANOUT for level in store.levels)


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_near_duplicates_against_brute_force(spark, sf, texts):
    def plain(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))

    ids = list(texts)
    fp = [plain(texts[i]) for i in ids]
    roots = _components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    least: dict[int, int] = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    want = {i: (f"{f:016x}", least[r]) for i, f, r in zip(ids, fp, roots, strict=True)}
    rows = queries.op9_simhash_neardup(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


@pytest.mark.parametrize(("leaf", "block"), [(40, 60), (200, 10_000), (100_000, 100_000)])
def test_shards_lose_no_link(spark, leaf, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flip = lambda a: a ^ (np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64))
    points = np.unique(np.concatenate([base, *[flip(flip(base)) for _ in range(8)], flip(flip(flip(np.full(300, 99, np.uint64))))]))
    at = {int(p): k for k, p in enumerate(points)}
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    edges = simhash_dedup.near_links(df, 2, 500, leaf, block).collect()
    mine = _components(len(points), [(at[e["u"] & (2**64 - 1)], at[e["v"] & (2**64 - 1)]) for e in edges])
    group = lambda roots: {frozenset(k for k, r in enumerate(roots) if r == x) for x in set(roots)}
    assert group(mine) == group(_components(len(points), zip(i, j, strict=True)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[200] == got[201] == 200


def _edit(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(10)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 70 if i == 0 else 14)))) for i in range(12)]
    docs = []
    for d in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = "other"
        t[3:3] = w
        docs.append((d, ", ".join(t).upper()))
    want = {(d, i, _edit(p.split(), decontam.words_of(t)), len(p.split())) for d, t in docs for i, p in items if p and _edit(p.split(), decontam.words_of(t)) <= round(0.2 * len(p.split()), 9)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (27, 6):  # a filter that tells nearly all runs, and one that tells few
        got = {tuple(r) for r in decontam.find_leaks(d, b, max_bits=size).collect()}
        assert got == want
        assert {r["doc_id"] for r in decontam.drop_contaminated(d, b, max_bits=size).collect()} == {x for x, _ in docs} - {x[0] for x in want}


def test_chat_round_trip(spark, sf):
    rng = random.Random(9)
    marks = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", "s>", "=", "~", "a", "\n", "$1"]
    text = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(200) for t in range(3)]
    source: dict[int, list] = {}
    for c, _, role, body in rows:
        source.setdefault(c, []).append((role, body))
    for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert [(p["role"], p["text"]) for p in r["parsed"]] == source[r["conv_id"]]
        assert r["formatted"].count("</s>") == r["formatted"].count("[INST]") == len(r["parsed"])
        assert sum(m["chars"] for m in r["loss_mask"]) == len(r["formatted"])
    own = next(r for r in queries.op7_chat_format(spark, sf).collect() if r["conv_id"] == -1)
    said = "</s>[INST] ok [/INST]"
    assert (own["n_turns"], own["loss_chars"], own["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_ann_fills_short_lists(spark):
    rng = np.random.default_rng(5)
    few, rare = rng.normal(size=(5, 64)), rng.normal(size=(6, 33))
    main = rng.normal(size=64) + 0.01 * rng.normal(size=(300, 64))
    vectors = [*few, *rare, *main, -main[0] + 0.01 * rng.normal(size=64)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    for own in (rows[:5], rows):
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>")
        asked = [i for i, _ in own if i < 11 or i == len(rows) - 1]
        got = {}
        for r in ann.nearest(df, F.col("id").isin(asked)).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        others = {q: [i for i, v in own if i != q and len(v) == len(vectors[q])] for q in asked}
        assert {q: len(v) for q, v in got.items()} == {q: min(5, len(others[q])) for q in asked}
        exact = asked if len(own) == 5 else [*range(5, 11), len(rows) - 1]  # fewer than five in the probed buckets
        assert all(got[q] == sorted(others[q], key=lambda i: -cosine(vectors[q], vectors[i]))[:5] for q in exact)


def test_chat_loss_figures_come_from_the_mask(spark):
    told = ["plain ¿ 🙂 text", "with [INST] and </s> and \\ in it", ""]
    rows = [(1, 0, "user", "asks"), *[(1, 1 + i, "assistant", t) for i, t in enumerate(told)]]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.digest(done).first()
    assert (got["loss_chars"], got["loss_sha256"]) == (len("".join(told)), hashlib.sha256("".join(told).encode()).hexdigest())
    wrong = done.withColumn("loss_mask", F.transform("loss_mask", lambda r: F.struct(r["chars"].alias("chars"), F.lit(False).alias("loss"))))
    assert chat.digest(wrong).first()["loss_chars"] == 0
    off = done.withColumn("loss_mask", F.transform("loss_mask", lambda r: F.struct((r["chars"] + 1).alias("chars"), r["loss"].alias("loss"))))
    with pytest.raises(Exception, match="does not cover"):
        chat.digest(off).collect()


def test_html_main_text(spark, sf):
    import html

    rows = queries.op8_html_extract(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div|ul|li)\b[^>]*>", " ", body))
        assert r["text"] == " ".join(html.unescape(body).split()) and r["n_chars"] == len(r["text"])


def test_html_deletes_what_neighbours_share(spark):
    page = lambda own: f"<body><div>Shop of the year</div><div>{own}</div><p>Call us today</p></body>"
    rows = [(i, f"http://h/{i}", page(f"Article number {i} speaks of many other things than its neighbours do")) for i in range(4)]
    rows.append((9, "http://other/1", page("alone on its host")))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Article number {i} speaks of many other things than its neighbours do" for i in range(4))
    assert got[9] == "Shop of the year alone on its host Call us today"
    copies = [(1, "http://h/1", page("one text")), (2, "http://h/2", page("one text"))]
    got = html_extract.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Shop of the year one text Call us today"}


def test_html_differencing_runs_beside_an_article(spark):
    page = lambda i: f"<body><div>Shop of the year</div><div>Headline {i}</div><article><p>Quoted by all</p><p>Story {i} tells of things that no other one tells</p></article><div>Call us today</div></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Headline {i} Quoted by all Story {i} tells of things that no other one tells" for i in range(4)}


def test_html_nearest_pages_on_a_large_host(spark):
    # Sections of two pages, each with its own unmarked menu, on one host of many ranges.
    page = lambda menu, own: f"<body><div>{menu}</div><div>{own}</div></body>"
    own = lambda i: f"Story {i} tells of things that no other page of this host tells"
    rows = [(i, f"http://h/{i // 2:03d}/{i % 2}", page(f"Menu of section {i // 2}", own(i))) for i in range(120)]
    for bucket in (7, 2_000):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), bucket=bucket).collect()}
        assert got == {i: own(i) for i in range(120)}


def test_html_search_goes_on_behind_copies(spark):
    page = lambda own: f"<body><div>Shop of the year</div><div>{own}</div></body>"
    copy, other = "A long story that stands at many addresses of the host word for word", "Another long story of quite different things"
    rows = [(i, f"http://h/a/{i:03d}", page(copy)) for i in range(60)] + [(99, "http://h/b", page(other))] + [(100 + i, None, page(copy)) for i in range(30)]
    for bucket in (7, 2_000):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), bucket=bucket).collect()}
        assert got == {i: copy for i in range(60)} | {99: other} | {100 + i: "Shop of the year " + copy for i in range(30)}


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(10)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert len(html_extract.shared_lines(a, b)) == length(a, b)


def test_html_alignment_decides_without_marks(spark, monkeypatch):
    # Nothing is marked: a menu and a slogan whose words differ from page to page, and a shared footer line.
    def page(i):
        menu = "".join(f"<li><a href='/{i}{k}'>Entry {i} {k}</a></li>" for k in range(4))
        return f"<title>Story {i}</title><body><ul>{menu}</ul><div class='x'>Slogan number {i}</div><div class='y'><h1>Story {i}</h1><p>Text {i} of its own.</p><p>More of {i}.</p></div><p>Call us today</p></body>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i} Text {i} of its own. More of {i}." for i in range(6)}
    got = {r["page_id"]: r for r in html_extract.extract(df, decided=True).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all((r["n_lines"], r["n_differenced"], r["n_marked"]) == (9, 6, 0) for r in got.values())
    monkeypatch.setattr(html_extract, "shared_lines", lambda a, b: set())
    lines = html_extract.blocks(page(0))[1]
    p = html_extract.Page("h", "/0", 0, *(list(c) for c in list(zip(*lines, strict=True))[:3]), [html_extract._hash(x[3]) for x in lines])
    assert not html_extract.furniture(p, [p])  # without the alignment everything would stay


def test_html_same_texts_under_any_partitioning(spark):
    # 400 pages of one host, two of a section with a menu of its own, long runs of one story between them.
    body = lambda i: f"Story {i} tells of things" if i % 5 else "A story at many addresses"
    page = lambda i: f"<title>{body(i)}</title><body><p>Menu of section {i // 2}</p><p>{body(i)}</p><p>Call us today</p></body>"
    rows = [(i, f"http://h/{i // 2:03d}/{i % 2}", page(i)) for i in range(400)] + [(1000 + i, f"http://h/150/x{i:03d}", page(5)) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = [{r["page_id"]: r["text"] for r in html_extract.extract(df.repartition(n), bucket=bucket).collect()} for n, bucket in ((1, 2_000), (7, 40), (3, 11))]
    assert seen[0] == seen[1] == seen[2] and all("Call us" not in t for t in seen[0].values())


def test_html_long_and_deep_pages(spark):
    deep = "<div>" * 5_000 + "x" + "</div>" * 5_000
    long = "".join(f"<p>line {i % 7}</p>" for i in range(20_000))
    rows = [(1, "http://h/1", deep), (2, "http://h/2", long), (3, "http://h/3", long + "<p>end</p>"), (3, "http://h/3", long + "<p>end</p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in got) == [1, 2, 3, 3] and all(r["n_chars"] == len(r["text"]) for r in got)


def test_tokens_of_every_character_match_the_library(tokenizer):
    import struct

    counter, encoder = token_counts.MergeCounter(words.vocabulary_path()), packing.IdBytes(words.vocabulary_path())
    points = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    held = ["a" + "b/".join(points[i : i + 16]) + " x" for i in range(0, len(points), 16)]
    rng = random.Random(2)
    held += ["".join(rng.choice(points) if rng.random() < 0.5 else rng.choice([*ODD, "'"]) for _ in range(rng.randint(1, 8))) for _ in range(5_000)]
    for t, e in zip(held, tokenizer.encode_batch(held, add_special_tokens=False), strict=True):
        assert counter.count(t) == len(e.ids) and encoder.of(t) == struct.pack(f"<{len(e.ids)}I", *e.ids), t


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = []
    for n in (1, 8, 64, 211):
        rows = packing.pack_documents(docs.repartition(n)).collect()
        windows = {r["sequence_id"] for r in rows}
        assert sum(r["length"] for r in rows) >= 0.98 * 2048 * len(windows)
        seen.append(sorted((r["doc_id"], r["start"], r["sequence_id"], r["offset"]) for r in rows))
    assert all(s == seen[0] for s in seen)
    few = packing.pack_documents(docs, shard=100).collect()  # several shards
    assert len(few) == len(seen[0]) and sum(r["length"] for r in few) >= 0.9 * 2048 * len({r["sequence_id"] for r in few})


def test_language_model_against_a_plain_version():
    from cairn.llm import langid

    rng = np.random.default_rng(3)
    related = {"aa": [3, 1, 0, 0, 0, 1], "ab": [2, 2, 0, 0, 0, 1], "ba": [0, 0, 3, 1, 0, 1], "bb": [0, 0, 1, 3, 1, 0], "ca": [0, 0, 0, 0, 4, 4]}
    langs = [lang for lang in related for _ in range(30)]
    x = np.stack([np.abs(np.array(related[v]) + 0.3 * rng.normal(size=6)) for v in langs]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.LanguageModel(x, langs)
    assert model.family["aa"] == model.family["ab"] and model.family["ba"] == model.family["bb"] and len(set(model.family.values())) == 3

    def plain(machine, row):  # votes of the pairs, a pair's loser keeps its confidence
        if len(machine.classes) == 1:
            return machine.classes[0], 1.0
        won, sure = dict.fromkeys(machine.classes, 0.0), dict.fromkeys(machine.classes, 1.0)
        for (a, b), w, scale in zip(machine.pairs, machine.weights, machine.scales, strict=True):
            p = 1 / (1 + np.exp(-scale * (sum(float(u) * float(v) for u, v in zip(w[:-1], row, strict=True)) + w[-1])))
            for c, q in ((a, p), (b, 1 - p)):
                name = machine.classes[c]
                won[name] += (q > 0.5) + 1e-6 * q
                sure[name] = min(sure[name], q)
        best = max(machine.classes, key=won.__getitem__)
        return best, sure[best]

    right = 0
    for row, lang in zip(x, langs, strict=True):
        family, a = plain(model.top, row)
        told, b = plain(model.within[family], row)
        got, confidence = model.within[model.top.classes[model.top.predict(row[None])[0][0]]].predict(row[None])
        assert model.top.classes[model.top.predict(row[None])[0][0]] == family and model.within[family].classes[got[0]] == told
        assert abs(model.top.predict(row[None])[1][0] * confidence[0] - a * b) < 1e-5
        right += told == lang
    assert right > 0.9 * len(langs)
    y = np.where(np.array(langs) == "aa", 1.0, -1.0).astype(np.float32)[:60]
    ones = np.hstack([x[:60], np.ones((60, 1), np.float32)]).astype(float)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda w: 0.5e-3 * w @ w + (weight * np.maximum(0, 1 - y * (ones @ w)) ** 2).sum()
    w = np.zeros(7)
    for _ in range(40_000):  # plain gradient descent, far longer
        w -= 0.2 * (1e-3 * w - 2 * ones.T @ (weight * y * np.maximum(0, 1 - y * (ones @ w))))
    assert loss(langid.fit_svm(x[:60], y, steps=2_000).astype(float)) <= 1.02 * loss(w)
    assert loss(langid.fit_svm(x[:60], y).astype(float)) <= 1.5 * loss(w)
    margin = x[:60] @ langid.fit_svm(x[:60], y)[:-1]
    cost = lambda s: np.log1p(np.exp(-s * margin * y)).mean() + 0.5e-3 * s * s
    assert cost(langid.fit_scale(margin, y)) <= min(cost(s) for s in np.linspace(0.1, 50, 2_000)) + 1e-4


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[k % 26] * 3 + letters[k // 26 % 26] * 2 for _ in range(4)), f"l{k:03d}") for i, k in enumerate(j % 240 for j in range(240 * 9))]
    from cairn.llm import langid

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, max_rows=3_000)
    assert len(model.family) == 240 and max(len(m.classes) for m in model.within.values()) <= 32
    told = langid.identify(df, model).join(df, "doc_id")
    assert told.where("lang = lang_pred").count() > 0.95 * len(rows)


def test_trees_against_a_plain_split_finder():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = (x[:, 0] * x[:, 1] + 0.1 * rng.normal(size=120) > 0).astype(float)
    model = quality.BoostedTrees(2).fit(x, y, rounds=3, bins=16)
    edges = [sorted(set(np.quantile(x[:, f], [i / 16 for i in range(1, 16)]))) for f in range(3)]
    raw = np.full(120, model.base)
    assert model.base == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    for tree in range(3):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)  # noqa: E731, B023

        def gain(rows, f, t):
            left, right = [i for i in rows if x[i, f] <= t], [i for i in rows if x[i, f] > t]  # noqa: B023
            if not left or not right or h[left].sum() < 1 or h[right].sum() < 1:  # noqa: B023
                return 0.0
            return score(left) + score(right) - score(rows)  # noqa: B023

        def grow(node, rows):
            if node >= 3:
                value = -0.1 * g[rows].sum() / (h[rows].sum() + 1.0)  # noqa: B023
                assert model.value[tree, node - 3] == pytest.approx(value, abs=1e-9)  # noqa: B023
                raw[rows] += value
                return
            best = max(gain(rows, f, t) for f in range(3) for t in edges[f])
            f, t = model.feature[tree, node], model.threshold[tree, node]  # noqa: B023
            assert (gain(rows, f, t) if np.isfinite(t) else 0.0) == pytest.approx(best, abs=1e-9)
            grow(2 * node + 1, [i for i in rows if x[i, f] <= t])
            grow(2 * node + 2, [i for i in rows if x[i, f] > t])

        grow(0, list(range(120)))


def test_decontamination_of_many_items_in_one_pass(spark):
    rng = random.Random(12)
    items = spark.range(100_000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 12), i -> concat('w', pmod(xxhash64(id, i), 5000)))) AS text")
    planted = items.where("item_id % 1000 = 7").collect()
    docs = [(i, f"some words before {r['text']} and some behind") for i, r in enumerate(planted)] + [(1_000 + i, " ".join(f"w{rng.randrange(5_000)}" for _ in range(300))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, items).collect()}
    assert got == {(i, r["item_id"]) for i, r in enumerate(planted)}
