"""Ranks and quantiles within groups of any size: rows lie in ranges of their order, and a range knows how much came before it.

A window over a group would hold all of it in one task; here a group is as many tasks as its rows take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.durable import durable


def summed_before(df: DataFrame, group: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """``df`` with ``before`` and ``whole``: the weights (1 by default) of the rows of its group that come earlier, and of all.

    Rows are range-partitioned by group and order and kept so; within a range a window does, and ranges add up by a small
    table of their totals.  Orders must tell the rows of a group apart; nulls come first.
    """
    held = durable(df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight).repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    totals = held.groupBy(*group, "_p").agg(F.sum("_w").alias("_t"))
    by_range = Window.partitionBy(*group).orderBy("_p")  # as many rows as ranges
    offsets = totals.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(Window.partitionBy(*group)).alias("whole"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumn("_b", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return own.join(offsets, same).select(*df.columns, (F.col("_b") + F.col("_o")).alias("before"), "whole")


def average_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the rank of its value within the group, ties at their mean rank; rows with a null value go."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranks = summed_before(counts, group, [value], F.col("_n")).select(*group, value, (F.col("before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*group, value])


def tiles(df: DataFrame, group: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """``df`` with ``name``: which of ``n`` tiles of its group a row is in, the first ones a row larger where they can't be equal."""
    size, more, at = F.floor(F.col("whole") / n), F.col("whole") % n, F.col("before")
    large = more * (size + 1)
    tile = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1
    return summed_before(df, group, order).withColumn(name, tile.cast("int")).drop("before", "whole")


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """``group, n, q0, q1, ..``: exact quantiles, interpolated, from counts by value; nulls take no part."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = summed_before(counts, group, ["_v"], F.col("_n"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("_n")), F.col("_v")))

    values = []
    for k, q in enumerate(shares):
        h = q * (F.col("whole") - 1)
        values += [at(F.floor(h)).alias(f"_l{k}"), at(F.ceil(h)).alias(f"_h{k}")]
    found = placed.groupBy(*group).agg(F.first("whole").alias("n"), *values)
    part = lambda q: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    return found.select(*group, "n", *((F.col(f"_l{k}") + part(q) * (F.col(f"_h{k}") - F.col(f"_l{k}"))).alias(f"q{k}") for k, q in enumerate(shares)))
