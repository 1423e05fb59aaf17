"""Pairs within a group, compared in cells: blocks of the group's rows against each other, reduced before they leave a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2_048


def matrix(column) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def within_groups(df: DataFrame, group: str, key: str, vector: str, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], dict[str, np.ndarray]], schema: str, block: int | None = None, named: bool = False) -> DataFrame:
    """What ``reduce`` makes of the dot products of every two blocks of a group.

    It gets the keys of the rows, those of the columns, their products, whether both are one block and, if ``named``, the
    group, and returns columns of ``schema``.  A group is cut into blocks of about ``BLOCK`` rows by the hash of the key, so no task holds a
    whole group; vectors are of one length and none is null.
    """
    blocks = df.groupBy(group).agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias("_n"))
    own = df.join(blocks, group).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cells = dealt.select(group, key, vector, "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def cell(table: pa.Table) -> pa.Table:
        b, keys, x = table.column("_b").to_numpy(), table.column(key).to_numpy(), matrix(table.column(vector))
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left, right = b == i, b == j
        return pa.table(reduce(keys[left], keys[right], x[left] @ x[right].T, i == j, *([table.column(group)[0].as_py()] if named else [])))

    return cells.groupBy(group, "_i", "_j").applyInArrow(cell, schema)


def best_below(k: int, ceiling: float) -> Callable:
    """For each row and each column of a cell its ``k`` greatest products under ``ceiling``, ties to smaller keys: a, b, s."""

    def reduce(a: np.ndarray, b: np.ndarray, s: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        out = []
        for rows, columns, m in ((a, b, s),) if same else ((a, b, s), (b, a, s.T)):
            m = np.where(m < ceiling, m, -np.inf)
            if same:
                m = np.where(rows[:, None] == columns[None], -np.inf, m)
            order = np.argsort(columns, kind="stable")
            m, columns = m[:, order], columns[order]
            top = np.argsort(-m, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(rows)), top.shape[1])
            values = m[at, top.ravel()]
            real = np.isfinite(values)
            out.append((rows[at[real]], columns[top.ravel()[real]], values[real]))
        return dict(zip("abs", map(np.concatenate, zip(*out, strict=True)), strict=True))

    return reduce


def links_from(floor: float) -> Callable:
    """Links a, b that connect what a cell's pairs with a product of ``floor`` or more connect: each to the least of its component.

    There are as many as rows and columns, not as pairs.
    """

    def reduce(a: np.ndarray, b: np.ndarray, s: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = np.nonzero(s >= floor)
        x, y = at[: len(a)][x], at[len(a) :][y]
        label = np.arange(len(keys))
        while True:  # least labels, then labels of labels, until nothing changes
            low = label.copy()
            np.minimum.at(low, x, label[y])
            np.minimum.at(low, y, label[x])
            low = low[low]
            if np.array_equal(low, label):
                break
            label = low
        child = np.flatnonzero(label != np.arange(len(keys)))
        return {"a": keys[label[child]], "b": keys[child]}

    return reduce


def nearest_class(df: DataFrame, key: str, vector: str, classes: list[tuple[int, list[float]]]) -> DataFrame:
    """``key, best, margin``: the class of greatest cosine with each vector, ties to the smaller, and how far the second is behind.

    Classes are given by their vectors, a matrix that is sent to every task.
    """
    labels = np.array([c for c, _ in sorted(classes)], np.int64)
    means = np.array([m for _, m in sorted(classes)])
    means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300) if len(means) else means
    held = df.sparkSession.sparkContext.broadcast((labels, means))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = held.value
        for b in batches:
            if b.num_rows and len(names) > 1:
                s = unit_rows(b.column(vector)) @ m.T
                first = s.argmax(axis=1)
                top = s[np.arange(len(s)), first]
                s[np.arange(len(s)), first] = -np.inf
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(names[first]), pa.array(top - s.max(axis=1))], [key, "best", "margin"])

    return df.select(key, vector).mapInArrow(run, f"{key} long, best long, margin double")


#: Buckets that a range of products is cut into in each pass of :func:`group_quantiles`, and the groups it takes.
BUCKETS, GROUPS = 4_096, 100_000


def group_quantiles(df: DataFrame, group: str, key: str, vector: str, quantiles: list[float], least: int, block: int | None = None) -> DataFrame:
    """``group, pairs, values``: exact quantiles (interpolated) of the products of every two rows of a group, of ``least`` pairs or more.

    A pass makes a histogram of each cell, which add up; the bucket that holds the wanted place is cut again in the next
    pass, between its least and greatest product, until these are equal.  So what is shuffled is counts by bucket, never
    pairs, and three passes tell products apart that differ in the tenth place.  Products count to twelve places.
    """
    spark = df.sparkSession
    wanted: dict = {}  # group -> {place: (low, high, how many lie below)}; None before the first pass
    known: dict = {}
    pairs: dict = {}

    def histograms(held) -> DataFrame:
        def reduce(a: np.ndarray, b: np.ndarray, s: np.ndarray, same: bool, name) -> dict[str, np.ndarray]:
            s = np.round(s[np.triu_indices(len(a), 1)] if same else s.ravel(), 12)
            out = []
            for number, (low, high) in enumerate([(-np.inf, np.inf)] if held is None else held.value.get(name, [])):
                begin, end = (-1.0, 1.0) if held is None else (low, high)
                inside = s[(s >= low) & (s <= high)]
                at = np.clip((inside - begin) / max(end - begin, 1e-300) * BUCKETS, 0, BUCKETS - 1).astype(np.int64)
                n = np.bincount(at, minlength=BUCKETS)
                first, last = np.full(BUCKETS, np.inf), np.full(BUCKETS, -np.inf)
                np.minimum.at(first, at, inside)
                np.maximum.at(last, at, inside)
                full = np.flatnonzero(n)
                out.append((np.full(len(full), number), full, n[full], first[full], last[full]))
            return {group: pa.array([name] * sum(len(o[0]) for o in out), kind), **dict(zip(("number", "bucket", "n", "low", "high"), map(np.concatenate, zip(*out, strict=True)), strict=True))} if out else empty

        field = df.schema[group].dataType
        kind = pa.from_numpy_dtype(np.int32 if field.typeName() == "integer" else np.int64) if field.typeName() in ("integer", "long") else pa.string()
        empty = {group: pa.array([], kind), **{c: pa.array([], pa.int64()) for c in ("number", "bucket", "n")}, **{c: pa.array([], pa.float64()) for c in ("low", "high")}}
        parts = within_groups(df, group, key, vector, reduce, f"{group} {field.simpleString()}, number long, bucket long, n long, low double, high double", block, named=True)
        return parts.groupBy(group, "number", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def chosen(hist: DataFrame, places) -> list:
        """(group, place, low, high, below, n of the bucket, n of all) for the buckets that hold a wanted place."""

        def pick(key_: tuple, rows: pa.Table) -> pa.Table:
            name, out = key_[0].as_py(), []
            number, bucket, n, low, high = (rows.column(c).to_numpy() for c in ("number", "bucket", "n", "low", "high"))
            for k in np.unique(number):
                at = np.flatnonzero(number == k)[np.argsort(bucket[number == k])]
                cum, total = np.cumsum(n[at]), int(n[at].sum())
                asked = [(p, p) for p in sorted({int(f(q * (total - 1))) for q in quantiles for f in (np.floor, np.ceil)})] if places is None else [(p, p - below) for p, interval, below in places.value[name] if interval == k]
                for p, rank in asked if places is not None or total >= least else []:
                    i = int(np.searchsorted(cum, rank, side="right"))
                    out.append((name, p, low[at[i]], high[at[i]], p - rank + int(cum[i] - n[at[i]]), int(n[at[i]]), total))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            names = [group, "place", "low", "high", "below", "n", "total"]
            return pa.table({c: pa.array(list(v), rows.schema.field(group).type if c == group else pa.float64() if c in ("low", "high") else pa.int64()) for c, v in zip(names, columns, strict=True)})

        return hist.groupBy(group).applyInArrow(pick, f"{group} {df.schema[group].dataType.simpleString()}, place long, low double, high double, below long, n long, total long").collect()

    if df.select(group).distinct().limit(GROUPS + 1).count() > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    held = places = None
    while True:
        found = chosen(histograms(held), places)
        wanted = {}
        for r in found:
            if held is None:
                pairs[r[group]] = r.total
            if r.low == r.high:
                known[r[group], r.place] = r.low
            else:
                wanted.setdefault(r[group], {})[r.place] = (r.low, r.high, r.below)
        if not wanted:
            break
        intervals = {g: sorted({(low, high) for low, high, _ in w.values()}) for g, w in wanted.items()}
        held = spark.sparkContext.broadcast(intervals)
        places = spark.sparkContext.broadcast({g: [(p, intervals[g].index((low, high)), below) for p, (low, high, below) in w.items()] for g, w in wanted.items()})

    def value(g, q: float) -> float:
        h = q * (pairs[g] - 1)
        low, high = known[g, int(np.floor(h))], known[g, int(np.ceil(h))]
        return float(low + (h - np.floor(h)) * (high - low))

    return spark.createDataFrame([(g, n, [value(g, q) for q in quantiles]) for g, n in sorted(pairs.items(), key=str)], f"{group} {df.schema[group].dataType.simpleString()}, pairs long, values array<double>")


def unit_rows(column) -> np.ndarray:
    """Rows of equally long lists at length 1; zero rows stay."""
    x = matrix(column).astype(np.float64)
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, n, m``: the mean of a class's vectors at length 1, from sums that tasks make."""
    kind = df.schema[label].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, at = np.unique(b.column(label).to_numpy(), return_inverse=True)
                x = unit_rows(b.column(vector))
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at)), pa.array(total.tolist(), pa.list_(pa.float64()))], [label, "n", "m"])

    def unite(key_: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy().sum()
        return pa.table({label: pa.array([key_[0].as_py()], rows.schema.field(label).type), "n": pa.array([int(n)]), "m": pa.array([(matrix(rows.column("m")).sum(axis=0) / n).tolist()], pa.list_(pa.float64()))})

    parts = df.select(label, vector).where(F.col(label).isNotNull() & F.col(vector).isNotNull()).mapInArrow(sums, f"{label} {kind}, n long, m array<double>")
    return parts.groupBy(label).applyInArrow(unite, f"{label} {kind}, n long, m array<double>")


#: Rows of a key up to which the rows of its groups meet in one task, and rows that a task should hold.
WHOLE, HELD = 20_000, 50_000


def beside(left: DataFrame, right: DataFrame, key: str, use: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], pa.Table], schema: str) -> tuple[DataFrame, DataFrame]:
    """What ``use`` makes of the rows of both sides of each key, and the rows of ``left`` whose key has too many rows for it.

    Keys of up to ``WHOLE`` rows on each side are handled several to a task, both sides as arrays by column; the rows of
    other keys come back for a way that spreads a key over tasks.  Null keys take no part.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key, "left")
    marked = left.join(sizes, key).withColumn("_large", F.greatest("_l", F.coalesce("_r", F.lit(0))) > WHOLE).drop("_l", "_r")
    tasks = max(1, -(-right.count() // HELD))
    bucket = F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")
    small = sizes.where(F.greatest("_l", F.coalesce("_r", F.lit(0))) <= WHOLE).select(key)
    parts = max(min(tasks, left.sparkSession.sparkContext.defaultParallelism), tasks // 5)  # so that sorting by bucket holds no more in a larger job
    ours, theirs = (df.withColumn("_b", bucket).repartition(parts, "_b") for df in (marked.where("NOT _large").drop("_large"), right.join(small, key, "left_semi")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        arrays = lambda t: {c: t.column(c).to_numpy() for c in t.column_names if c != "_b"}
        x, y = arrays(a), arrays(b)
        at, of = np.argsort(x[key], kind="stable"), np.argsort(y[key], kind="stable")
        names, first = np.unique(x[key][at], return_index=True)
        ends, out = np.append(first[1:], len(at)), []
        low, high = np.searchsorted(y[key][of], names), np.searchsorted(y[key][of], names, side="right")
        for k in range(len(names)):
            i, j = at[first[k] : ends[k]], of[low[k] : high[k]]
            out.append(use({c: v[i] for c, v in x.items()}, {c: v[j] for c, v in y.items()}))
        return pa.concat_tables(out) if out else use({c: v[:0] for c, v in x.items()}, {c: v[:0] for c, v in y.items()})

    return ours.groupBy("_b").cogroup(theirs.groupBy("_b")).applyInArrow(meet, schema), marked.where("_large").drop("_large")
