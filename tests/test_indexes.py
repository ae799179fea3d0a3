"""Hash trees, intervals in bins, many tokens at once, fused scores."""

import random

from pyspark.sql import functions as F

from cairn.operators import integrity as Y
from cairn.operators import search as S
from cairn.operators import temporal as T


def test_a_tree_reads_only_odd_leaves(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("i"), (F.col("id") * 7).alias("v"))
    other = rows.where("i <> 'r5'").withColumn("v", F.when(F.col("i") == "r77", 1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("new", 3)], "i string, v long"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    Y.write_tree(rows, "i", ["v"], a)
    Y.write_tree(other, "i", ["v"], b)
    assert {tuple(r) for r in Y.tree_difference(spark, a, b).collect()} == {("r5", "missing"), ("r77", "changed"), ("new", "extra")}
    odd = Y.odd_leaves(spark, a, b)
    assert len(odd) <= 3 and sum(spark.read.parquet(f"{a}/rows/leaf={n}").count() for n in odd) < 20_000 / 100
    assert Y.odd_leaves(spark, a, a) == [] and Y.tree_difference(spark, a, a).count() == 0


def test_intervals_in_bins(spark):
    rng = random.Random(1)
    stamp = lambda s: None if s is None else f"2020-01-{1 + s // 86_400:02d}T{s // 3_600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}.000000Z"
    pick = lambda: rng.choice([None, rng.randrange(20 * 86_400), rng.randrange(20 * 86_400)])
    facts = [(i, pick(), pick()) for i in range(300)] + [(900, 5, 5), (901, 9, 8), (902, 0, 1), (903, None, None)]
    asked = [rng.randrange(20 * 86_400) for _ in range(60)] + [0, 1, 5, facts[3][1] or 7]
    df = spark.createDataFrame([(i, stamp(a), stamp(b)) for i, a, b in facts], "i long, valid_from string, valid_until string")
    held = T.holding_at(T.interval_bins(df), spark.createDataFrame([(q, stamp(q)) for q in asked], "q long, instant string"))
    want = sorted((q, i) for q in asked for i, a, b in facts if (a is None or a <= q) and (b is None or q < b) and not (a is not None and b is not None and a >= b))
    assert sorted((r["q"], r["i"]) for r in held.collect()) == want
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") <= 1  # the levels, at most 63


def test_many_tokens_are_found_as_one_by_one(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAB ") for _ in range(rng.randrange(1, n)))
    rows, tokens = [(i, word(40), rng.choice([None, word(20)])) for i in range(80)], list({word(6) for _ in range(300)})
    got = {tuple(r) for r in Y.token_scan(spark.createDataFrame(rows, "i long, a string, b string"), "i", ["a", "b"], tokens).collect()}
    lower = {t.lower(): t for t in tokens}
    blob = lambda r: "\x1f".join(x for x in r[1:] if x is not None).lower()
    assert got == {(str(r[0]), t) for r in rows for low, t in lower.items() if low in blob(r)}
    assert Y.token_scan(spark.createDataFrame(rows, "i long, a string, b string"), "i", ["a"], []).count() == 0


def test_a_semantic_score_falls_back_to_the_lexical_one(spark):
    units = spark.createDataFrame([("p", None, "s", f"s#L{i}", i, "word " * i, float(i) if i % 2 else None) for i in range(1, 6)], "profile_id string, project_id string, source_ref string, location_id string, line_no int, text string, sem double")
    triples = [("p", None, None)]
    lexical = {r["line_no"]: r["score"] for r in S.retrieve_corpus(units, triples, "word").collect()}
    fused = {r["line_no"]: r["score"] for r in S.retrieve_corpus(units, triples, "word", semantic=F.col("sem")).collect()}
    assert fused == {i: s + (i if i % 2 else 0) for i, s in lexical.items()}
    none = {r["line_no"]: r["score"] for r in S.retrieve_corpus(units, triples, "word", semantic=F.lit(None).cast("double")).collect()}
    assert none == lexical


def test_intermediate_tables_are_dropped(spark):
    from cairn import scratch

    kept = scratch.written(spark.range(3), "kept")
    with scratch.temporary(spark):
        gone = scratch.written(spark.range(5), "gone")
        with scratch.temporary(spark):
            inner = scratch.folder(spark, "inner")
            gone.write.parquet(inner)
        path = gone.inputFiles()[0].rsplit("/", 1)[0]
        assert gone.count() == 5 and scratch.exists(spark, path) and not scratch.exists(spark, inner)
    assert kept.count() == 3 and not scratch.exists(spark, path)
