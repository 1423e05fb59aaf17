"""Graph operators on node and edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.durable import durable


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each pair with the least of u and its partners."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "u")


def least_reachable(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of undirected pairs (a, b): the least node it is connected with.

    Alternating stars: each round ties a node's larger neighbours, then its smaller ones, to the least node it knows, so a
    chain takes about the logarithm of its length; rounds go on until nothing changes, and each is checkpointed.
    """
    edges = durable(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        tied = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        edges = durable(tied.where("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def weighted_degree(edges: DataFrame, node: str, weight: Column) -> DataFrame:
    return edges.groupBy(node).agg(F.sum(weight).alias("degree"), F.count("*").alias("edges"))


#: Nodes and features of nodes in a block at most, features that a cell counts at once, rows of its strips.
BLOCK, HELD, WIDE, STRIP = 4_096, 4_000_000, 4_096, 512


def similar_nodes(edges: DataFrame, node: str, feature: str, least: int, k: int) -> DataFrame:
    """Each node's ``k`` most similar by Jaccard of features; nodes with fewer than ``least`` features take no part.

    Nodes of equal features are one class, of which the ``k`` + 1 least can be among anybody's most similar.  Classes are
    dealt to blocks, each two of which are a cell that counts shared features by products of matrices and hands on the
    best of each row, so no table of pairs is made and a cell's memory is bounded.
    """
    has = durable(edges.select(F.col(node).alias("node"), F.col(feature).alias("feature")).distinct())
    codes = durable(has.where("feature IS NOT NULL").select("feature").distinct().withColumn("code", F.monotonically_increasing_id()))
    held = has.join(codes, "feature", "left").groupBy("node").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("code")).alias("codes")).where(F.col("node").isNotNull() & (F.col("size") >= least))
    held = durable(held.withColumn("rep", F.min("node").over(Window.partitionBy("size", "codes"))))
    classes = held.where("node = rep").select("rep", "size", "codes")
    many, features = classes.agg(F.count("*"), F.sum(F.size("codes"))).first()
    blocks = max(1, -(-many // BLOCK), -(-(features or 0) // HELD))
    dealt = classes.withColumn("_b", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select("rep", "size", "codes", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def cell(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("rep", "ascending")]))
        part, size = table.column("_b").to_numpy(), table.column("size").to_numpy()
        lists = table.column("codes").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        row, code = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
        code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        width = int(code[-1]) + 1 if len(code) else 0
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(left) or not len(right):
            return pa.table({"rep": table.column("rep").slice(0, 0), "other": table.column("rep").slice(0, 0), "similarity": pa.array([], pa.float64())})
        place = np.zeros(len(part), int)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2 ** 24 are exact
        for lo in range(0, width, WIDE):
            x, y = np.searchsorted(code, (lo, lo + WIDE))
            r, c = row[x:y], code[x:y] - lo
            a, b = (np.zeros((len(side), min(WIDE, width - lo)), np.float32) for side in (left, right))
            for side, at in ((a, i), (b, j)):
                own = part[r] == at
                side[place[r[own]], c[own]] = 1
            shared += a @ b.T
        found = []
        for counts, ours, theirs in ((shared, left, right),) if i == j else ((shared, left, right), (shared.T, right, left)):
            for lo in range(0, len(ours), STRIP):
                both, mine = counts[lo : lo + STRIP].astype(float), ours[lo : lo + STRIP]
                s = both / (size[mine][:, None] + size[theirs][None] - both)
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                rows = np.repeat(np.arange(len(mine)), best.shape[1])
                values = s[rows, best.ravel()]
                some = values > 0
                found.append((mine[rows[some]], theirs[best.ravel()[some]], values[some]))
        x, y, s = (np.concatenate(each) for each in zip(*found, strict=True))
        reps = table.column("rep")
        return pa.table({"rep": reps.take(pa.array(x)), "other": reps.take(pa.array(y)), "similarity": pa.array(s)})

    kind = held.schema["rep"].dataType.simpleString()
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    near = cells.groupBy("_i", "_j").applyInArrow(cell, f"rep {kind}, other {kind}, similarity double").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    first = held.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("node"))).where(F.col("_n") <= k + 1).select(F.col("rep").alias("other"), F.col("node").alias("b"))
    members = near.drop("_n").join(first, "other").withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "b"))).where(F.col("_n") <= k + 1)
    scored = held.select(F.col("node").alias("a"), "rep").join(members.select("rep", "b", "similarity"), "rep").where("a <> b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "rank", "similarity")
