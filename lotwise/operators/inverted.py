"""An inverted-file index over unit vectors: lists around centroids, cut into rings by angle, probed by bound.

A vector lies in the list of its nearest centroid and in a ring of that list by its angle to it.  The angle between a
query and any vector of a ring is at least the gap between the query's own angle to the centroid and the ring, so rings
that can't hold anything better than what is known are left out and the answer is exact all the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.cells import matrix
from lotwise.operators.durable import durable

#: Rows that centroids are fitted on at most, the most lists, rings a radian, rows of a part, rows of a unit and queries that are scored at once.
SAMPLE, LISTS, RINGS, CELL, UNIT, BATCH = 20_000, 2_048, 32, 2_048, 8_192, 4_096
#: Slack of bounds, above the rounding of cosines; of cosines rounded to nine places.
SLACK, PLACES = 1e-6, 2e-9


def whole(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, v): vectors of ``width`` finite numbers at length 1; others, nulls and zeros take no part."""
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", length).where("n > 0 AND n < double('infinity')").select("key", F.transform(v, lambda x: x / F.col("n")).alias("v"))


def centroids_of(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres of length 1 by cosine k-means, begun at the first rows; a centre that loses all its rows takes the worst served one."""
    c = x[:lists].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(s.max(axis=1), kind="stable")[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return c


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1.0, 1.0))


def units(rows: np.ndarray, parts: np.ndarray, near: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first unit of each ring, how many it has, and the parts of a unit: rings that follow each other share a unit of up to ``UNIT`` rows, unless ``near`` tells them apart, and a ring of several parts has units of its own."""
    per = max(1, UNIT // cell)
    first, times = np.zeros(len(rows), np.int64), np.maximum(1, -(-parts // per))
    unit, held = -1, 0
    for i in range(len(rows)):
        alone = parts[i] > 1
        if i == 0 or alone or parts[i - 1] > 1 or near[i] != near[i - 1] or held + rows[i] > UNIT:
            unit, held = (unit + 1 if i == 0 else int(first[i - 1] + times[i - 1])), 0
        first[i], held = unit, held + rows[i]
    return first, times, per


@dataclass
class InvertedFile:
    """Vectors in cells (list, ring, part); ``sizes`` has the parts, rows, first unit and units of each ring, at most ``LISTS`` times pi times ``RINGS`` rows in the order of units.

    A unit is what a query is sent to: rings of lists near each other, so queries are handed out by thousands of vectors,
    not by ring; which of a unit's lists count for a query is told where they are scored.
    """

    cells: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    width: int

    @staticmethod
    def fit(vectors: DataFrame, key: str, vector: str, width: int, lists: int | None = None, sample: int = SAMPLE, cell: int = CELL) -> InvertedFile:
        """Centroids from the ``sample`` rows of least key hash; every vector goes into the index.

        A ring with more than ``cell`` rows is cut by the hash of the key, so many equal vectors are many cells.
        """
        rows = durable(whole(vectors, key, vector, width))
        count = rows.count()
        lists = lists or max(1, min(LISTS, int(count**0.5)))
        taken = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()
        x = matrix(taken.column("v")).reshape(-1, width)
        c = centroids_of(x, min(lists, len(x))) if len(x) else np.zeros((1, width))
        held = rows.sparkSession.sparkContext.broadcast(c)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    a = _angles(matrix(b.column("v")), held.value)
                    own = a.argmin(axis=1)
                    ring = np.floor(a[np.arange(len(a)), own] * RINGS)
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(ring.astype(np.int32))], ["key", "v", "list", "ring"])

        kind = rows.schema["key"].dataType.simpleString()
        placed = durable(rows.mapInArrow(place, f"key {kind}, v array<double>, list int, ring int"))
        sizes = placed.groupBy("list", "ring").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"), F.count("*").cast("int").alias("rows"))
        table = sizes.orderBy("list", "ring").toArrow()
        own, ring, parts, held_rows = (table.column(n).to_numpy().astype(np.int64) for n in ("list", "ring", "parts", "rows"))
        wide = min(len(c), max(1, int(count // UNIT)))
        near = (c @ centroids_of(c, wide).T).argmax(axis=1) if len(own) else np.zeros(len(c), int)
        order = np.lexsort((ring, own, near[own]))
        own, ring, parts, held_rows = own[order], ring[order], parts[order], held_rows[order]
        first, times, per = units(held_rows, parts, near[own], cell)
        where = rows.sparkSession.createDataFrame(pa.table({"list": own.astype(np.int32), "ring": ring.astype(np.int32), "parts": parts.astype(np.int32), "_first": first}))
        cells = placed.join(F.broadcast(where), ["list", "ring"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        cells = cells.withColumn("unit", (F.col("_first") + F.floor(F.col("part") / per)).cast("int")).drop("parts", "_first")
        return InvertedFile(cells, c, np.stack([own, ring, parts, held_rows, first, times], axis=1), width)

    def _asked(self, queries: DataFrame, probes: int, rest: bool) -> DataFrame:
        """(query, v, unit, least, reach) of the units that each query reads: those of the ``probes`` nearest lists, which are as near as ``reach``, or, for ``rest``, of all rings beyond them whose bound is within the angle ``most``."""
        held = queries.sparkSession.sparkContext.broadcast((self.centroids, self.sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, sizes = held.value
            own, ring, first, times = sizes[:, 0], sizes[:, 1], sizes[:, 4], sizes[:, 5]
            starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, int)
            for whole_batch in batches:
                for lo in range(0, whole_batch.num_rows if len(starts) else 0, 256):
                    b = whole_batch.slice(lo, 256)
                    a = _angles(matrix(b.column("v")), c)
                    near = np.argsort(np.argsort(a, axis=1, kind="stable"), axis=1, kind="stable") < probes
                    there, reach = near[:, own], np.where(near, a, 0).max(axis=1) + PLACES
                    if rest:
                        gap = np.maximum(a[:, own] - (ring + 1) / RINGS, ring / RINGS - a[:, own])
                        there, reach = ~there & (gap <= b.column("most").to_numpy()[:, None] + SLACK), np.full(len(a), 4.0)
                    q, at = np.nonzero(np.logical_or.reduceat(there, starts, axis=1))
                    many = times[starts[at]]
                    q, at = np.repeat(q, many), np.repeat(first[starts[at]], many)
                    at += np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    taken = b.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([taken.column("query"), taken.column("v"), pa.array(at.astype(np.int32)), taken.column("least"), pa.array(reach[q])], ["query", "v", "unit", "least", "reach"])

        kind = queries.schema["query"].dataType.simpleString()
        return queries.mapInArrow(run, f"query {kind}, v array<double>, unit int, least double, reach double")

    def _found(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, key, s): the ``k`` best of every unit asked that are as good as ``least``; a unit asked by many is handed out once for each batch of queries."""
        batches = asked.groupBy("unit").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("_n"))
        left = asked.join(batches, "unit").withColumn("_b", F.pmod(F.xxhash64("query"), F.col("_n")).cast("int")).drop("_n")
        right = self.cells.select("key", "v", "list", "unit").join(batches, "unit").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        held, width = asked.sparkSession.sparkContext.broadcast(self.centroids), self.width

        def best(q: pa.Table, x: pa.Table) -> pa.Table:
            out = [pa.table({"query": q.column("query").slice(0, 0), "key": x.column("key").slice(0, 0), "s": pa.array([], pa.float64())})]
            x = x.take(pa.compute.sort_indices(x, [("key", "ascending")]))
            vectors, (lists, of) = matrix(x.column("v")).reshape(-1, width), np.unique(x.column("list").to_numpy(), return_inverse=True)
            keys = x.column("key").combine_chunks()
            codes = pa.compute.index_in(keys, value_set=keys.unique()).to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, int)
            for lo in range(0, q.num_rows if x.num_rows else 0, 256):
                b = q.slice(lo, 256)
                v = matrix(b.column("v"))
                s = v @ vectors.T
                reach = b.column("reach").to_numpy()
                if (reach < 4).any():
                    s[~(_angles(v, held.value[lists]) <= reach[:, None])[:, of]] = -np.inf
                mine = pa.compute.index_in(b.column("query"), value_set=keys.unique()).fill_null(-1).to_numpy()
                for i in np.flatnonzero(mine >= 0):
                    s[i, np.searchsorted(codes, mine[i]) : np.searchsorted(codes, mine[i], side="right")] = -np.inf  # a query isn't its own answer
                least = b.column("least").to_numpy()
                bar = least - PLACES
                if s.shape[1] > k and (s >= bar[:, None]).sum() > 2 * k * len(s):
                    bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k] - PLACES)
                rows, at = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
                values = np.round(s[rows, at], 9)
                order = np.lexsort((at, -values, rows))
                rows, at, values = rows[order], at[order], values[order]
                kept = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & (values >= least[rows])
                out.append(pa.table({"query": b.column("query").take(pa.array(rows[kept])), "key": keys.take(pa.array(at[kept])), "s": pa.array(values[kept])}))
            return pa.concat_tables(out)

        query, key = (df.schema[c].dataType.simpleString() for df, c in ((asked, "query"), (self.cells, "key")))
        return left.groupBy("unit", "_b").cogroup(right.groupBy("unit", "_b")).applyInArrow(best, f"query {query}, key {key}, s double")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
        """(query, key, s, rank): the ``k`` vectors of greatest cosine (to nine places) with each query but itself, ties to the smaller key.

        The nearest ``probes`` lists are read first.  If ``exact``, so is every ring elsewhere that could hold a vector as
        good as the ``k``-th found; a query that has found fewer reads all of them.
        """
        asking = whole(queries, key, vector, self.width).withColumnRenamed("key", "query").repartition(queries.sparkSession.sparkContext.defaultParallelism)
        first = durable(_top(self._found(self._asked(asking.select("query", "v", F.lit(-2.0).alias("least")), probes, False), k), k))
        if not exact:
            return first
        reach = first.groupBy("query").agg(F.count("*").alias("n"), F.min("s").alias("s"))
        full, far = F.col("n") >= k, F.acos(F.least(F.greatest("s", F.lit(-1.0)), F.lit(1.0)))
        bounded = asking.join(reach, "query", "left").select("query", "v", F.when(full, far).otherwise(F.lit(4.0)).alias("most"), F.when(full, F.col("s")).otherwise(F.lit(-2.0)).alias("least"))
        rest = self._found(self._asked(bounded, probes, True), k)
        return _top(first.drop("rank").unionByName(rest).groupBy("query", "key").agg(F.max("s").alias("s")), k)

    def probes_for(self, queries: DataFrame, key: str, vector: str, k: int, share: float, sample: int = 200) -> int:
        """How many lists hold ``share`` of the true ``k`` nearest, by the exact answers of the ``sample`` queries of least key hash."""
        asked = whole(queries, key, vector, self.width).orderBy(F.xxhash64("key"), "key").limit(sample)
        exact = self.search(asked, "key", "v", k)
        rows = exact.join(self.cells.select("key", "list"), "key").join(asked.select(F.col("key").alias("query"), "v"), "query").select("v", "list").toArrow()  # sample * k rows
        if not rows.num_rows:
            return 1
        a = _angles(matrix(rows.column("v")), self.centroids)
        place = (a < a[np.arange(len(a)), rows.column("list").to_numpy()][:, None]).sum(axis=1) + 1
        return int(np.quantile(place, share, method="higher"))


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("s"), "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fused(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(query, key, first, second, rank): two rankings as one, vectors of both before those of one, then by the better cosine, ties to the smaller key."""
    a, b = (df.select("query", "key", F.col("s").alias(n)) for df, n in ((first, "first"), (second, "second")))
    both = a.join(b, ["query", "key"], "full_outer")
    order = [F.desc(F.col("first").isNotNull() & F.col("second").isNotNull()), F.desc(F.greatest("first", "second")), F.col("key")]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(queries, neighbours, recall): the share of the wanted (query, key) that are among the found."""
    hit = wanted.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
