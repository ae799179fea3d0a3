"""The pipeline's stages against plain versions, on the smallest tables."""

import gc
import hashlib
import re

import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from cairn.llm import packing, simhash_dedup, words
from cairn.llm._common import materialise


def _plain_lines(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = {}
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = lambda i, x: len(h := holders.get(key(x), ())) >= 3 and i != max(h)
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in docs.items()}


def _plain_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def _plain_groups(docs):
    prints = {i: _plain_print(t) for i, t in docs.items()}
    group = {i: i for i in docs}
    for _ in docs:  # least id of the links, until nothing changes
        new = {i: min(group[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 2) for i in docs}
        if new == group:
            return group
        group = new
    return group


def _holds(text, item):
    """Whether some part of ``text`` is within a fifth of the item's words of edits."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) <= round(0.2 * len(item), 9)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen[name] = tuple({r["doc_id"]: r.asDict() for r in d.collect()} for d in (before, docs))
    texts = lambda rows: {i: r["text"] or "" for i, r in rows.items()}
    before, after = seen["language_id"]
    assert all(after[i] == before[i] for i in after)
    # What has no letters has no language; what is labelled with one has, so its rows stay.
    assert not any(i in after for i, r in before.items() if not any(c.isalpha() for c in r["text"] or ""))
    assert all(i in after for i, r in before.items() if r["lang"] and len(re.findall(r"[^\W\d_]+", r["text"] or "")) >= 20)
    before, after = seen["line_dedup"]
    assert texts(after) == _plain_lines(texts(before))
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert all({**r, "text": 0, "n_chars": 0} == {**before[i], "text": 0, "n_chars": 0} for i, r in after.items())
    before, after = seen["near_dedup"]
    assert set(after) == set(_plain_groups(texts(before)).values()) and all(after[i] == before[i] for i in after)
    before, after = seen["decontamination"]
    of = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := of(r["text"] or ""))]
    short = {i: of(t) for i, t in texts(before).items() if len(t) < 4_000}  # the plain table is quadratic
    assert {i for i in after if i in short} == {i for i, w in short.items() if not any(_holds(w, item) for item in items if len(set(item) & set(w)) >= 0.6 * len(set(item)))}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(words.vocabulary_path())
    packed, windows = {}, {}
    for r in corpus_pipeline.run(spark, sf).collect():
        packed.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(packed) == set(after)
    for i, rows in packed.items():
        assert sum(r["length"] for r in rows) == len(tokenizer.encode(after[i]["text"], add_special_tokens=False).ids) + 1
    for spans in windows.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False)) and sum(n for _, n in spans) <= 2048


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A data folder with nulls, blanks, repeated rows and clashing columns, and one with empty tables."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, __id long, __uid long, __drop string, k1 string, shard long, tie long"
    text = "the quick brown fox jumps over the lazy dog while the sun is shining on the hill"
    rows = [(i, f"{text} {'abcdefghijkl'[i]} {hashlib.md5(bytes([i])).hexdigest()}", "en", "s", 1, 1, 1, "d", "k", 1, 1) for i in range(12)]
    rows += [(20, None, "en", None, None, 1, 1, "d", "k", 1, 1), (21, "", None, "s", 0, 1, 1, "d", None, 1, 1), (None, text, "en", "s", 1, None, None, None, None, None, None), rows[0], rows[0]]
    folders = {}
    for name, own in (("odd", rows), ("none", [])):
        folder = tmp_path_factory.mktemp(name)
        spark.createDataFrame(own, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "a passage of the benchmark that no text holds"), (2, None)][: len(own)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        folders[name] = str(folder)
    return folders


def test_pipeline_of_odd_and_empty_tables(spark, odd):
    for name, folder in odd.items():
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, folder), stage_name)
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.collect()}
        assert not ids & {20, 21} and (name == "none" or 0 in ids) and docs.where("doc_id = 0").count() <= 1
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == ids


def test_workers_keep_no_tables_of_other_stages(spark, sf):
    """Workers serve all stages in turn: what packing keeps in them goes as another stage's tasks come."""

    def tables(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, packing.IdBytes) for x in gc.get_objects())]})

    held = lambda: [r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(tables, "n long").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(64)  # more tasks than workers, so each has one
    packing.pieces(docs).collect()
    assert max(held()) == 1
    simhash_dedup.fingerprints(docs).collect()
    assert max(held()) == 0


def test_shards_are_dealt_by_one_worker_a_task(spark):
    """Each Python step of a stage takes a worker of its own beside the others."""
    points = spark.range(3_000).selectExpr("xxhash64(id) AS fp")
    plan = simhash_dedup.near_links(points)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bMapInArrow\b", plan)) == 1
