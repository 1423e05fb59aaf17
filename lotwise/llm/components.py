"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import dropped, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each pair with the least of u and its partners; u's rows may be many, the least is one row a key."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a long, b long): the label is the least node it is connected with.

    Every round ties each node's larger neighbours, then its smaller ones, to the least node it knows (large star, small
    star); rounds end when nothing changes, after about the logarithm of the longest chain.  A round's links are written
    to the shared folder.  No links give no rows; repeated links and links of a node to itself are harmless.
    """
    pairs = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        tied = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        after = written(tied.where("u <> v").distinct(), "links")
        dropped(pairs.sparkSession, pairs)
        pairs = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
