"""Nulls, blanks, long texts, ties, repeated rows, empty tables and odd columns."""

import pytest

from cairn.llm import ann, chat, decontam, html_extract, langid, line_dedup, packing, quality, simhash_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, batch string, drop string"
LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, None, "en", "s", 0, 0, "x", "y"),
    (2, "", "de", "s", 0, 0, "x", "y"),
    (3, " \n\t ", None, "s", 3, 0, "x", "y"),
    (4, LONG, "en", "s", len(LONG), 0, "x", "y"),
    (5, "same words stand here twice over", "en", "s", 1, 0, "x", "y"),
    (5, "same words stand here twice over", "en", "s", 1, 0, "x", "y"),
    (None, "a text without any number at all", "fr", None, 1, 0, None, "y"),
    (6, "123 456 !!", "es", "s", 1, 0, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta", 9), (2, None, 9), (3, "", 9), (4, "...", 9), (5, "same words stand here twice over", 9), (6, "same words stand here twice over", 9)], "item_id long, text string, distance int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")


def test_token_counts(docs, none):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs).collect()}
    assert got[1] == got[2] == (0, 0, False) and got[3] == (4, 0, False)
    assert got[4] == (len(LONG), 80_000, True)
    assert token_counts.count_tokens(docs).count() == len(ROWS) and token_counts.count_tokens(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in rows) == sum({id(x): x for x in rows if x["start"] == 0}[k]["doc_tokens"] for k in {id(x): x for x in rows if x["start"] == 0})
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert len([r for r in rows if r["doc_id"] == 5]) == 2 and len([r for r in rows if r["doc_id"] is None]) == 1
    assert packing.pack_documents(none).count() == 0


def test_language(docs, none):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    blank = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(docs, blank).collect()} == {"und"}
    assert langid.identify(none, blank).count() == 0
    assert langid.keep_identified(docs, langid.train(docs)).columns == docs.columns


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in quality.score(docs, quality.train(none, labels)).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_lines(docs, none):
    out = line_dedup.drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == len(ROWS)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert got[1] == got[2] == (1, 0) and got[3] == (2, 0) and got[5] == (1, 0)  # two rows of one id are one document
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_near_duplicates(docs, none):
    rows = simhash_dedup.near_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and len(rows) == len(ROWS)
    kept = simhash_dedup.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "None"]
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one_of_each_group(none).count() == 0


def test_decontamination(spark, docs, none, items):
    found = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.find_leaks(docs, items).collect())
    assert found == [("4", 1), ("5", 5), ("5", 5), ("5", 6), ("5", 6)]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "6", "None"]
    assert decontam.find_leaks(none, items).count() == 0
    empty = items.where("item_id < 0")
    assert decontam.find_leaks(docs, empty).count() == 0 and decontam.drop_contaminated(docs, empty).count() == len(ROWS)


def test_chat(spark):
    rows = [(1, 0, None, None, "k"), (1, 0, "user", "b", "k"), (1, 0, "user", "a", "k"), (1, None, "system", "first", "k"), (None, 1, "assistant", "x</s>", "k"), (2, 0, "assistant", "", "k"), (2, 0, "assistant", "", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: [(p["role"], p["text"]) for p in r["parsed"]] for r in chat.format_conversations(df).collect()}
    assert got[1] == [("system", "first"), ("", ""), ("user", "a"), ("user", "b")]
    assert got[None] == [("assistant", "x</s>")] and got[2] == [("assistant", "")] * 2
    assert chat.digest(chat.format_conversations(df.where("conv_id > 9"))).count() == 0


def test_html(spark):
    rows = [(1, None, None, "p"), (2, "http://h/a", "", "p"), (3, "nonsense", "<p>x &amp; y<p>z", "p"), (None, "http://h/b", "<article>w</article>", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("x & y z", 7), None: ("w", 1)}
    assert html_extract.extract(df.where("page_id > 9")).count() == 0


def test_ann(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(0, v, 1), (1, v, 1), (2, [2.0, 0.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [float("nan"), 1.0, 0.0], 1), (6, [1.0], 1), (7, [0.0, 1.0, 0.0], 1), (None, v, 1), (0, v, 1), (8, [1.0, None, 0.0], 1), (9, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.0)]
    assert ann.nearest(df.where("vec_id > 99"), F.col("id") % 50 == 0).count() == 0
