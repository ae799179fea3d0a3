"""Small relational helpers: latest and first rows, keyset pages, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order.

    A row number with a limit of one: each partition keeps its own first row of a
    key before the shuffle, so a hot key sends one row a partition.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def after(cursor: dict) -> Column:
    """Rows behind a keyset cursor: ``(a, b) > (x, y)`` written out."""
    names = list(cursor)
    tests = []
    for i, name in enumerate(names):
        same = [F.col(n) == F.lit(cursor[n]) for n in names[:i]]
        test = F.col(name) > F.lit(cursor[name])
        for s in reversed(same):
            test = s & test
        tests.append(test)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def page(df: DataFrame, order: list[str], limit: int = 50, cursor: dict | None = None, look_ahead: bool = False) -> DataFrame:
    """One page in a total order, behind a cursor if one is given; with ``look_ahead`` one row more."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    return (df.where(after(cursor)) if cursor else df).orderBy(*order).limit(limit + look_ahead)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, repeats counted, with the side's name."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_left, only_right``: how many rows only one side has, repeats counted, told by one shuffle of both sides."""
    side = lambda df, n: df.select(*a.columns, F.lit(n).alias("__n"))
    odd = side(a, 1).unionByName(side(b, -1)).groupBy(*a.columns).agg(F.sum("__n").alias("__sum"))
    more = lambda n, name: F.coalesce(F.sum(F.greatest(n, F.lit(0).cast("long"))), F.lit(0).cast("long")).alias(name)
    return odd.agg(more(F.col("__sum"), "only_left"), more(-F.col("__sum"), "only_right"))


def row_digest(columns: list[str]) -> Column:
    """A digest of a row; nulls stand apart from empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free digest of a table.

    Row digests are added up as numbers, so the sum is built in parallel.
    """
    part = lambda i: F.conv(F.substring(F.col("d"), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    rows = df.select(row_digest(columns).alias("d"))
    sums = [F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(5)]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))
