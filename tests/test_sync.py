"""A synced corpus equals a rebuilt one; an unchanged sync writes nothing."""

import os

from cairn.operators import corpus as C
from cairn.operators import sync as Y
from cairn.operators.relational import difference
from cairn.scratch import children, folder, written


def files(root):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, names in os.walk(root) for f in names)


def test_sync(spark, tmp_path):
    root = str(tmp_path / "corpus")
    held = Y.store(spark, root, buckets=16)
    text = lambda i, more="": f"line one of {i}\nsame line\nsame line\n\nkey api_key=abc{i}\n{more}"
    rows = {f"s{i}": text(i) for i in range(60)} | {"empty": "", "none": None}
    frame = lambda: spark.createDataFrame(list(rows.items()), "source_ref string, text string")
    assert Y.sync(held, frame(), 0) == {"new": 62, "changed": 0, "removed": 0, "unchanged": 0}
    seen = files(root)
    assert Y.sync(held, frame(), 1)["unchanged"] == 62 and files(root) == seen
    rows["s3"], rows["s61"] = text(3, "a third line"), text(61)
    del rows["s5"]
    for _ in range(2):  # a sync that runs again writes the same
        assert Y.sync(held, frame(), 2) == {"new": 1, "changed": 1, "removed": 1, "unchanged": 60}
        assert len(held.touched["units"]) <= 3
        want = C.project_corpus(frame())
        columns = Y.TABLES["units"].replace(" string", "").replace(" int", "").split(", ")
        assert difference(Y.units(held), want[0].select(*columns)).count() == 0
        assert difference(Y.edges(held), want[1]).count() == 0
    rows.clear()
    assert Y.sync(held, frame(), 3)["removed"] == 62 and Y.units(held).count() == 0


def agrees(spark, held, rows):
    """The store's units and edges are those of a projection of distinct sources at once."""
    units, edges, _ = C.project_corpus(spark.createDataFrame(list(rows.items()), "source_ref string, text string"))
    got = Y.units(held)
    return difference(got, units.select(*got.columns)).count() == 0 and difference(Y.edges(held), edges).count() == 0


def test_a_sync_writes_what_changed_only(spark, tmp_path):
    """Unchanged units are neither shuffled nor written again, edges are not written, and nothing is left in the scratch folder."""
    root, left = str(tmp_path / "corpus"), lambda: set(children(spark, os.path.dirname(folder(spark, "any"))))
    held, text = Y.store(spark, root, buckets=2), lambda i: f"one of {i}\n  two  of {i}\nsame\nsame"
    rows = {f"s{i}": text(i) for i in range(40)}
    frame = lambda: spark.createDataFrame(list(rows.items()), "source_ref string, text string")
    written(frame(), "any")  # the folder is there
    before = left()
    Y.sync(held, frame(), 0)
    rows |= {f"s{i}": text(-i - 1) for i in range(8)} | {"new": "x\n\ny"}
    del rows["s9"]
    assert Y.sync(held, frame(), 1) == {"new": 1, "changed": 8, "removed": 1, "unchanged": 31}
    assert left() == before
    assert spark.read.parquet(f"{root}/units").count() == 40 * 4 + 8 * 4 + 2
    assert sorted(os.listdir(root)) == ["manifest", "sources", "units"]
    assert agrees(spark, held, rows)


def test_units_are_extracted_without_a_shuffle(spark):
    """Once, wherever they lie; the first of a text is found across batches and counts accepted lines only."""
    texts = spark.createDataFrame([(f"s{i}", "a\nb\npassword = x\na\né\npassword = x\né\n\nb") for i in range(20)], "source_ref string, text string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        lines = C.first_lines(C.extracted(texts)).select("source_ref", "line_no", "first")
        assert {tuple(r) for r in lines.collect()} == {(f"s{i}", n, first) for i in range(20) for n, first in ((1, 1), (2, 2), (4, 1), (5, 5), (7, 5), (9, 2))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2


def test_repeated_and_null_references(spark, tmp_path):
    """The least digest stands for a reference, in a first sync and in one that leaves most as it was."""
    import hashlib

    least = lambda *t: min(t, key=lambda x: hashlib.sha256((x or "").encode()).digest())
    held, rows = Y.store(spark, str(tmp_path / "corpus"), buckets=4), {f"s{i}": f"l\n{i}\nl" for i in range(30)}
    frame = lambda more: spark.createDataFrame([*rows.items(), *more], "source_ref string, text string")
    more = [("s1", "other\nother"), ("s2", rows["s2"]), (None, "x"), (None, "y"), ("empty", None), ("empty", "")]
    now = lambda: rows | {"s1": least(rows["s1"], "other\nother"), "empty": ""}
    assert Y.sync(held, frame(more), 0) == {"new": 31, "changed": 0, "removed": 0, "unchanged": 0}
    assert agrees(spark, held, now())
    rows["s3"] = "changed\nchanged"
    more += [("s3", rows["s3"]), ("s31", "new"), ("s31", "new too")]
    assert Y.sync(held, frame(more), 1) == {"new": 1, "changed": 1, "removed": 0, "unchanged": 30}
    assert agrees(spark, held, now() | {"s31": least("new", "new too")})


def test_segments_are_written_again_when_half_is_gone(spark, tmp_path):
    """Segments stay few and half alive, and replaced ones are deleted by the sync behind."""
    assert Y._again({0: 100}, {0: 51}, 10) == [] and Y._again({0: 100}, {0: 50}, 10) == [0]
    assert Y._again({0: 100, 1: 4, 2: 9}, {0: 99, 1: 4, 2: 8}, 4) == [1, 2] and Y._again({0: 100, 1: 9}, {0: 99, 1: 9}, 4) == []
    root = str(tmp_path / "corpus")
    held, rows = Y.store(spark, root, buckets=2), {f"s{i}": f"a {i}\nb\nb" for i in range(20)}
    frame = lambda: spark.createDataFrame(list(rows.items()), "source_ref string, text string")
    segments = lambda: sorted(n for n in os.listdir(f"{root}/units") if n.startswith("segment="))
    Y.sync(held, frame(), 0)
    rows |= {f"s{i}": "c" for i in range(12)}
    assert Y.sync(held, frame(), 1)["changed"] == 12 and held.touched["units"] == [0]
    assert agrees(spark, held, rows) and segments() == ["segment=0", "segment=1"]
    rows["s0"] = "d"
    assert Y.sync(held, frame(), 2)["changed"] == 1 and segments() == ["segment=1", "segment=2"]
    rows["s1"] = "e"
    for _ in range(2):  # a sync that runs again finds what it had
        assert Y.sync(held, frame(), 3)["changed"] == 1 and held.touched["units"] == [2]
        assert agrees(spark, held, rows)
    assert held.manifest()["units"] == {"1": [20, 18], "3": [2, 2]}
    rows.clear()
    assert Y.sync(held, frame(), 4)["removed"] == 20 and Y.units(held).count() == 0 and Y.edges(held).count() == 0
    rows["s"] = "back"
    assert Y.sync(held, frame(), 5)["new"] == 1 and segments() == ["segment=5"] and agrees(spark, held, rows)
