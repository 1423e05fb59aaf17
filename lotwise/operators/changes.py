"""Keyed upserts, merges of duplicates and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.durable import durable


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the newest version's values; where these are null, and for ``keep_first``, earlier ones."""
    every = stored.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*keys, version)]
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version)))
    oldest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(version)))
    return every.groupBy(*keys).agg(F.max(version).alias(version), *((oldest(c) if c in keep_first else newest(c)).alias(c) for c in rest))


def new_only(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def repoint(edges: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Edges with ids replaced by their survivors (``old``, ``survivor``), duplicates folded."""
    return edges.join(merges.select(F.col("old").alias(column), "survivor"), column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor").select(*edges.columns).distinct()


def final_survivor(merges: DataFrame, rounds: int = 20) -> DataFrame:
    """Chains of merges followed to their ends; ``rounds`` doublings reach chains of 2 ** rounds.

    A cycle of merges never ends, so merges that are not settled by then raise ValueError.
    """
    found = merges.select("old", "survivor")
    for _ in range(rounds):
        onward = found.select(F.col("old").alias("survivor"), F.col("survivor").alias("_next"))
        after = found.join(onward, "survivor", "left").select("old", F.coalesce("_next", "survivor").alias("survivor"))
        if not after.join(found, ["old", "survivor"], "left_anti").take(1):
            return found
        found = durable(after)
    raise ValueError("merges form a cycle")


def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first rule that a row breaks, null for none; nothing is dropped."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return df.withColumn("reason", out)


def assertions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) in one pass."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return counts.unpivot([], list(rules), "rule", "violations")


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of duplicates."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
