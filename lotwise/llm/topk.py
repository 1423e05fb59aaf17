"""Exact top-k search by term-at-a-time accumulation.

Rows and queries meet in cells of a grid, each cell a batch of queries and a block of rows.  In a cell the rows' postings
are laid out by term; each term of a query scatters its weight times the postings into the query's dense array of scores.
A partition step picks the best of each array and a merge over the blocks ranks them, so every row is scored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a batch; scores are held for ``STRIP`` queries at a time.
BLOCK, BATCH, STRIP = 32_768, 32_768, 64


class Vectors:
    """Vectors of a cell as entries (row, term, weight) without zeros, in the order of their ids."""

    def __init__(self, table: pa.Table, extra: str | None = None):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.extra = table.column(extra).to_numpy()[order] if extra else None
        lists = table.column("weights").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.repeat(place, sizes)
        term = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        weight = lists.flatten().to_numpy(zero_copy_only=False)
        some = np.flatnonzero(weight)
        self.row, self.term, self.weight = row[some], term[some], weight[some]

    def peak(self) -> int:
        return int(np.abs(self.weight).max(initial=0))


def postings(v: Vectors, lo: int = 0, hi: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each term that rows ``lo`` to ``hi`` use: those rows, counted from ``lo``, and the weights."""
    mine = np.arange(len(v.row)) if hi is None else np.flatnonzero((v.row >= lo) & (v.row < hi))
    mine = mine[np.lexsort((v.row[mine], v.term[mine]))]
    term = v.term[mine]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    return {int(term[i]): (v.row[mine[i:j]] - lo, v.weight[mine[i:j]]) for i, j in zip(first, np.append(first[1:], len(term))[: len(first)], strict=True)}


def best(rows: Vectors, queries: Vectors, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Place, row ids and scores of each query's ``k`` best rows, ties to smaller ids; never a row of the query's own id."""
    n, lists, out = len(rows.ids), postings(rows), []
    terms = max(1, len(lists))
    kind = np.int32 if rows.peak() * queries.peak() * terms < 2**31 - 1 else np.int64
    lists = {t: (slice(None) if len(at) == n else at, w.astype(kind)) for t, (at, w) in lists.items()}
    first, last = np.searchsorted(rows.ids, queries.ids, "left"), np.searchsorted(rows.ids, queries.ids, "right")
    for lo in range(0, len(queries.ids), STRIP):
        hi = min(lo + STRIP, len(queries.ids))
        scores = np.zeros((hi - lo, n), kind)
        for t, (asking, q) in postings(queries, lo, hi).items():
            if t in lists:
                at, w = lists[t]
                for i, x in zip(asking.tolist(), q.astype(kind), strict=True):
                    scores[i, at] += x * w
        for i in range(lo, hi):
            own = np.concatenate([scores[i - lo, : first[i]], scores[i - lo, last[i] :]])
            kept = np.arange(len(own))
            if k < len(own):
                least = np.partition(own, len(own) - k)[len(own) - k]
                kept = np.concatenate([np.flatnonzero(own > least), np.flatnonzero(own == least)[:k]])
            kept = kept[np.lexsort((kept, -own[kept].astype(np.int64)))][:k]
            out.append((i, rows.ids[np.where(kept < first[i], kept, kept + last[i] - first[i])], own[kept].astype(np.int64)))
    return out


def search(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each query, from rank 1.

    ``rows`` and ``queries`` have (vec_id long, weights array<long>); terms are places in the array and zeros count as
    absent.  A row never answers the query of its own id; ties go to the smaller id; fewer rows give fewer answers.
    Rows with a null id, null weights or a null among them take no part; of repeated ids each row counts.  Of queries equal in id and weights one is
    asked; queries that share their id only are answered each.  Sums wrap as 64-bit integers.  Every query meets every
    row, in cells: a row is copied to each batch of queries and a query to each block.
    """
    spark = rows.sparkSession
    there = F.col("vec_id").isNotNull() & F.col("weights").isNotNull() & ~F.exists("weights", lambda x: x.isNull())
    rows, queries = rows.select("vec_id", "weights").where(there), queries.select("vec_id", "weights").where(there).dropDuplicates()
    count, asking = rows.count(), queries.count()
    batches = max(1, math.ceil(asking / batch))
    cores = max(1, spark.sparkContext.defaultParallelism)
    blocks = max(math.ceil(count / block), min(3 * cores // batches, math.ceil(count / 1_024)), 1)
    own = F.pmod(F.xxhash64("vec_id", "weights"), F.lit(blocks)).cast("int")
    dealt = rows.select("vec_id", "weights", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    query = F.xxhash64("vec_id", "weights")
    asked = queries.select("vec_id", "weights", query.alias("query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(query, F.lit(batches)).cast("int").alias("batch"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = Vectors(right, "query")
        found = best(Vectors(left), queries, k)
        sizes = [len(ids) for _, ids, _ in found]
        at = np.repeat([i for i, _, _ in found], sizes).astype(np.int64)
        join = lambda j: np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"query_id": queries.ids[at], "query": queries.extra[at], "vec_id": join(1), "score": join(2)})

    # a cell's key is one number, so that cells can be spread evenly
    cells = F.col("block") * F.lit(batches) + F.col("batch")
    left = dealt.withColumn("cell", cells).groupBy("cell")
    right = asked.withColumn("cell", cells).groupBy("cell")
    found = left.cogroup(right).applyInArrow(cell, "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, weights): each component as floor(scale * x); vectors with a null or non-finite component are left out."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("weights"))
