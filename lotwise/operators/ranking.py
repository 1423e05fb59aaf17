"""Ordered analytics: top rows, cascades, ranks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1; ``order`` should be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def cascade(tiers: list[DataFrame], by: list[str], identity: list[str], order: list[Column], n: int) -> DataFrame:
    """``n`` rows of each group from tiers that fill what earlier ones leave; a row counts in its first tier only."""
    every = None
    for k, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(k))
        every = t if every is None else every.unionByName(t)
    first = every.withColumn("_first", F.min("tier").over(Window.partitionBy(*by, *identity))).where("tier = _first").drop("_first")
    return top(first, by, [F.col("tier"), *order], n)


def average_rank(c: str, by: list[str] = ()) -> Column:
    """Rank with ties at their mean place."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


#: Rows that a task should hold of groups dealt out by :func:`dealt`.
HELD = 250_000


def dealt(df: DataFrame, by: list[str], held: int | None = None) -> DataFrame:
    """``df`` dealt out by group to as many tasks as keep each to about ``held`` rows, which windows by group then use; the cluster's own number at least."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // (held or HELD)))
    return df.repartition(tasks, *by)


def earlier(value: Column, by: list[str], days: Column) -> tuple[Column, Column]:
    """Count and median of values on strictly earlier days of the same group: what was known before the day."""
    w = Window.partitionBy(*by).orderBy(days).rangeBetween(Window.unboundedPreceding, -1)
    return F.count(value).over(w), F.percentile(value, F.lit(0.5)).over(w)


def stratified(df: DataFrame, cells: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each cell in an order that hashes ``key`` with the seed."""
    mixed = F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed) * F.lit(40503), F.lit(4294967296))
    return top(df.withColumn("_h", mixed), cells, [F.col("_h"), F.col(key)], n).drop("_h")
