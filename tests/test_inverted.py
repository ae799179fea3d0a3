"""The written index against scans, over batches, merges and deletions."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import inverted as I
from cairn.operators import search as S

CONDITIONS = [
    S.term("ab"), S.term("ab cd"), S.prefix("a"), S.phrase("b a b"), S.prefix("ab c"), S.term("a", "title"), S.term("cd", "body", first=True), S.near(["ab", "cd"], 1), S.near(["a b", "cd", "ab"], 3, "body"),
    S.all_of(S.term("a"), S.term("b"), S.prefix("c")), S.any_of(S.term("cd"), S.phrase("a a")), S.but_not(S.term("a"), S.term("b"), S.term("cd", "title")), S.all_of(S.any_of(S.term("ab"), S.term("zz")), S.but_not(S.term("cd"), S.term("a"))),
    S.term("zz"), S.all_of(S.term("zz"), S.term("a")), S.any_of(S.term("zz"), S.term("qq")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "ab", "cd", "c-a", "É"]) for _ in range(rng.randrange(n)))
    return spark.createDataFrame([(f"d{i}", text(3), "ab cd a" if i in (5, 40, 110) else text(9) or None) for i in range(120)], "id string, title string, body string").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    out = I.Index(spark, str(tmp_path_factory.mktemp("index") / "i"), ["title", "body"], buckets=4)
    number = F.substring("id", 2, 9).cast("int")
    for n, (a, z) in enumerate(((0, 30), (30, 31), (31, 80), (80, 119), (119, 120))):
        batch = docs.where((number >= a) & (number < z))
        gone = docs.where(number.isin(5, 40)).select("id") if n == 2 else docs.where(number == 110).select("id") if n == 4 else None
        out.add(batch, "id", n, gone)
        if n == 2:
            out.add(batch, "id", n, gone)
    return out


@pytest.mark.parametrize("n", range(len(CONDITIONS)))
def test_conditions_find_what_scans_find(docs, index, n):
    want = {r["id"] for r in S.find(docs, "id", ["title", "body"], CONDITIONS[n]).collect()} - {"d5", "d40", "d110"}
    assert {r["id"] for r in index.find(CONDITIONS[n]).collect()} == want


def test_segments_merge_and_forget_the_deleted(index):
    segments = index.segments()
    assert [(s["level"], s["docs"]) for s in segments] == [(1, 119), (0, 1)]
    held = {r[0] for r in index._rows(segments).select(F.explode("ids")).collect()}
    assert "d5" not in held and "d40" not in held and "d110" in held  # deleted after the merge: on the list only
    assert index.frequencies(["body\x1fa"])["body\x1fa"] == sum("d" in i for i in {r["id"] for r in index.counts(["a"], "body").collect()})


def test_a_search_reads_the_buckets_of_its_terms(index):
    every = len(index._rows(index.segments()).inputFiles())
    own = index._rows(index.segments(), index.bucket_of(["body\x1fa"])).inputFiles()
    assert 0 < len(own) <= every / 2 and len({f.split("bucket=")[1].split("/")[0] for f in own}) == 1


def test_fallback(index, docs):
    assert {r["match_mode"] for r in index.find_or(["a", "b"]).collect()} == {"strict"}
    got = index.find_or(["a", "zebra"]).collect()
    assert {r["match_mode"] for r in got} == {"any_term"} and len(got) > 0


def test_tokens_are_never_shuffled(spark, docs, tmp_path, monkeypatch):
    """Only whole texts are dealt; repeated ids, accents and empty texts give the postings that tokens one by one give."""
    seen = []
    write = I.Index._write
    monkeypatch.setattr(I.Index, "_write", lambda self, name, level, rows, *rest: (seen.append(rows), write(self, name, level, rows, *rest))[1])
    index = I.Index(spark, str(tmp_path / "i"), ["title", "body"], buckets=2)
    index.add(docs.unionByName(docs.where("id = 'd7'")), "id", 0)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(term" not in plan and "posexplode" not in plan
    want = {}
    for r in docs.unionByName(docs.where("id = 'd7'")).select("id", *[S.X.tokens(S.X.fold_accents(F.col(c))).alias(c) for c in ("title", "body")]).collect():
        for c in ("title", "body"):
            for at, w in enumerate(r[c] or []):
                want.setdefault((f"{c}\x1f{w}", r["id"]), []).append(at)
    got = {(r["term"], i): list(at) for r in index._rows(index.segments()).collect() for i, at in zip(r["ids"], r["places"], strict=True)}
    assert got == {k: sorted(v) for k, v in want.items()}
    for r in index._rows(index.segments()).collect():
        assert r["n"] == len(r["ids"]) and r["most"] == max(map(len, r["places"])) and list(r["ids"]) == sorted(r["ids"])
