"""Whole-table checks: rebuild parity, canonical against derived, secret scan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.relational import row_digest, surplus, table_digest
from cairn.scratch import exists


def parity(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """For each projection: rows on either side only, and whether both agree."""
    out = None
    for name in sorted(a):
        row = surplus(a[name], b[name]).select(F.lit(name).alias("projection"), "only_left", "only_right", ((F.col("only_left") + F.col("only_right")) == 0).alias("equal"))
        out = row if out is None else out.unionByName(row)
    return out


def diagnose(canonical: DataFrame, derived: DataFrame, ident: str = "eid", content: str = "h") -> DataFrame:
    """How a derived table stands to the log: missing, extra, changed or equal rows."""
    a, b = canonical.select(ident, F.col(content).alias("want")), derived.select(ident, F.col(content).alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed").otherwise("equal")
    return a.join(b, ident, "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def secret_scan(tables: dict[str, tuple[DataFrame, str, list[str]]], tokens: list[str]) -> DataFrame:
    """Rows of derived tables that hold one of a list of tokens."""
    out = None
    for name, (df, ident, columns) in tables.items():
        rows = token_scan(df, ident, columns, tokens).select(F.lit(name).alias("table_name"), "row_id", "token")
        out = rows if out is None else out.unionByName(rows)
    return out


def token_scan(df: DataFrame, ident: str, columns: list[str], tokens: list[str]) -> DataFrame:
    """``row_id, token`` for every token that a row's columns hold, whatever their number.

    One automaton of all tokens is walked once over each row's text, in Arrow batches; letters count in lower case.
    The tokens are a bounded list: they travel with the task.
    """
    if not (wanted := {t.lower(): t for t in tokens if t}):
        return df.select(F.col(ident).cast("string").alias("row_id"), F.lit("").alias("token")).limit(0)
    rows = df.select(F.col(ident).cast("string").alias("row_id"), F.lower(F.concat_ws("\x1f", *columns)).alias("blob"))

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low, t in wanted.items():
            automaton.add_word(low, t)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for i, blob in enumerate(batch.column(1)):
                held = sorted({t for _, t in automaton.iter(blob.as_py() or "")})
                ids += [i] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], names=["row_id", "token"])

    return rows.mapInArrow(run, "row_id string, token string")


def digest_gate(df: DataFrame, columns: list[str], expected: str | None) -> bool:
    """Whether a table still has the digest that was recorded for it."""
    return expected is not None and table_digest(df, columns).first()["digest"] == expected


def export_gate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each row may leave: the first of ``columns`` that holds a secret, and its rule."""
    from cairn.functions import text as X

    rule = F.coalesce(*[X.secret_rule(F.col(c)) for c in columns])
    where = F.coalesce(*[F.when(X.secret_rule(F.col(c)).isNotNull(), F.lit(c)) for c in columns])
    return rows.withColumns({"withheld_rule": rule, "withheld_column": where, "exportable": rule.isNull()})


# ------------------------------------------------------------------- hash trees

#: Children of a node; a tree has a root, this many nodes and the square of it as leaves.
WIDTH = 32


def write_tree(df: DataFrame, ident: str, columns: list[str], path: str, width: int = WIDTH) -> None:
    """A table's rows by leaf, and the digests of its leaves, their parents and the root.

    A row's leaf is told by its id.  A node's digest adds up those of its rows, so every level is a small
    aggregate of the one below.
    """
    leaf = F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(width * width)).cast("int")
    rows = df.select(F.col(ident).cast("string").alias("row_id"), row_digest(columns).alias("digest"), leaf.alias("leaf"))
    rows.repartition("leaf").sortWithinPartitions("leaf", "row_id").write.partitionBy("leaf").parquet(f"{path}/rows")
    kept = df.sparkSession.read.schema("row_id string, digest string, leaf int").parquet(f"{path}/rows")
    number = lambda i: F.conv(F.substring("digest", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    leaves = kept.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.sum(number(i)).alias(f"d{i}") for i in range(5)])
    for level, node in ((2, F.col("leaf")), (1, F.floor(F.col("leaf") / width).cast("int")), (0, F.lit(0))):
        one = leaves.groupBy(node.alias("node")).agg(F.sum("n").alias("n"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(5)])
        told = one.select("node", F.sha2(F.concat_ws("-", "n", *[F.col(f"d{i}").cast("string") for i in range(5)]), 256).alias("digest"))
        told.coalesce(1).sortWithinPartitions("node").write.parquet(f"{path}/level{level}")


def odd_leaves(spark: SparkSession, a: str, b: str, width: int = WIDTH) -> list[int]:
    """The leaves in which two trees of one width differ, found from the root down: at most its square."""
    under = None
    for level in range(3):
        side = lambda path, name, n=level: spark.read.schema("node int, digest string").parquet(f"{path}/level{n}").withColumnRenamed("digest", name)
        both = side(a, "x").join(side(b, "y"), "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
        if under is not None:
            both = both.where(F.floor(F.col("node") / width).isin(under) if level == 2 else F.lit(True))
        if not (under := sorted(r["node"] for r in both.select("node").collect())):
            return []
    return under


def tree_difference(spark: SparkSession, a: str, b: str, width: int = WIDTH) -> DataFrame:
    """``row_id, state`` (missing, extra, changed) of the rows in which two written trees differ.

    Only rows of leaves whose digests differ are read.
    """
    leaves = odd_leaves(spark, a, b, width)
    paths = lambda path: [p for n in leaves if exists(spark, p := f"{path}/rows/leaf={n}")]
    none = spark.createDataFrame([], "row_id string, digest string")
    rows = lambda path, name: (spark.read.schema(none.schema).parquet(*found) if (found := paths(path)) else none).withColumnRenamed("digest", name)
    both = rows(a, "want").join(rows(b, "have"), "row_id", "full_outer").where(~F.col("want").eqNullSafe(F.col("have")))
    return both.select("row_id", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").otherwise("changed").alias("state"))
