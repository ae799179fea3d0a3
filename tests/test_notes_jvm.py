"""Notes and canonical JSON are made inside the JVM, whatever characters they hold."""

import json

from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import text as X
from cairn.operators import notes as O

ODD = ["", "plain", 'q"b\\', "tab\tline\n\r\b\f", "é ß", "😀 x", "\x00\x1f\x7f", " ", "'~ ", None, "x" * 3000, "a<b>&[c]_*"]


def test_json_text_is_that_of_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string").select("i", I.json_text(F.col("t")).alias("j"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["j"] for r in df.orderBy("i").collect()] == [json.dumps(t) for t in ODD]


def test_notes_need_no_python_and_one_escape(spark):
    df = spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(ODD)], "verification_id string, method string")
    notes = O.record_notes(df, "verification")
    plan = notes._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    body = {r["resource_id"]: r["body"] for r in notes.collect()}
    assert "- **Method:** (none)\n" in body["v0"] and "- **Method:** plain\n" in body["v1"] and "- **Method:** a&lt;b&gt;&amp;\\[c\\]\\_\\*\n" in body["v11"]
    assert body["v1"].startswith('---\nmanaged: true\nnote_id: "note-verification-') and 'resource_id: "v1"\nproject_id: null\n' in body["v1"]
    one = spark.createDataFrame([(x,) for x in ODD], "t string").select(X.yaml_scalar(F.col("t")).alias("y"), "t").collect()
    assert {r["t"]: r["y"] for r in one}['q"b\\'] == '"q\\"b\\\\"' and {r["t"]: r["y"] for r in one}[None] == "null"
