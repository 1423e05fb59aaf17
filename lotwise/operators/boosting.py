"""Gradient boosting on histograms: values in bins, sums by node and bin as one aggregate a level, nulls sent the better way.

Rows whose features fall into the same bins become one, with their number and the sum of their targets, which is all
that trees are made of.  A pass sends the trees made so far to every task, which finds its rows' nodes and adds up
gradients by node, feature and bin; these sums are all that comes back, so the driver's work doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.durable import durable
from lotwise.operators.ridges import _blocks, added

#: Combinations of bins up to which a task looks predictions up instead of walking the trees for each row.
LOOKED_UP = 1_000_000


@dataclass
class Tree:
    """Nodes in the order of a heap: the feature split on (-1 for a leaf), the last bin that goes left, whether nulls do, and the leaf's value."""

    feature: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), int)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            own = bins[np.arange(len(bins)), np.maximum(f, 0)]
            left = np.where(own == 0, self.null_left[at], own <= self.cut[at])
            at = np.where(f >= 0, 2 * at + 2 - left.astype(int), at)
        return at


@dataclass
class Boosted:
    """``base`` plus the values of the trees; ``edges`` cut each feature into bins, of which 0 is for nulls."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, side="left")) for x, e in zip(columns, self.edges, strict=True)], axis=1).astype(int)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(bins)))

    def predictor(self) -> Callable[[np.ndarray], np.ndarray]:
        """:meth:`predict`, from a table of all combinations of bins where these are few."""
        widths = [len(e) + 2 for e in self.edges]
        if np.prod(widths, dtype=float) > LOOKED_UP:
            return self.predict
        known = self.predict(np.stack(np.unravel_index(np.arange(int(np.prod(widths))), widths), axis=1))
        return lambda bins: known[np.ravel_multi_index(tuple(bins.T), widths)]


def edges_of(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Cuts at even shares of each feature's values, in one aggregate; equal cuts are one."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.when(~F.isnan(c), F.col(c).cast("double")), shares, 10_000).alias(c) for c in features)).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def best_splits(grad: np.ndarray, count: np.ndarray, ridge: float, least: int) -> list[tuple[float, int, int, bool]]:
    """For each node the gain, feature, last left bin and way of nulls of its best split, from sums by (node, feature, bin); ties to the earlier."""
    out = []
    for g, n in zip(grad, count, strict=True):
        total_g, total_n = g[0].sum(), n[0].sum()
        best = (1e-12, -1, 0, False)
        for null_left in (True, False):
            left_g, left_n = np.cumsum(g[:, 1:], axis=1), np.cumsum(n[:, 1:], axis=1)
            if null_left:
                left_g, left_n = left_g + g[:, :1], left_n + n[:, :1]
            right_g, right_n = total_g - left_g, total_n - left_n
            gain = left_g**2 / (left_n + ridge) + right_g**2 / (right_n + ridge) - total_g**2 / (total_n + ridge)
            gain = np.where((left_n >= least) & (right_n >= least), gain, -np.inf)
            f, cut = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, cut] > best[0] + 1e-9 * abs(best[0]):
                best = (float(gain[f, cut]), int(f), int(cut) + 1, null_left)
        out.append(best)
    return out


def _columns(batch: pa.RecordBatch, features: list[str]) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features]


def grouped(rows: DataFrame, model: Boosted) -> DataFrame:
    """``_0, _1, .., _n, _y``: the bins of each feature, how many rows have them all, and the sum of their ``_y``."""
    held, names = rows.sparkSession.sparkContext.broadcast(model), [f"_{k}" for k in range(len(model.features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = held.value.binned(_columns(b, held.value.features))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k].astype(np.int32)) for k in range(len(names))), b.column("_y")], [*names, "_y"])

    found = rows.mapInArrow(run, f"{', '.join(f'{n} int' for n in names)}, _y double")
    return durable(found.groupBy(*names).agg(F.count("*").cast("double").alias("_n"), F.sum("_y").alias("_y")))


def fit(df: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Boosted:
    """Trees of ``depth`` levels on squared errors of ``target``; rows without a target take no part, nulls and NaN of features have a bin of their own."""
    rows = df.where(F.col(target).isNotNull() & ~F.isnan(target)).select(*(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias("_y"))
    model = Boosted(features, edges_of(rows, features, bins), 0.0)
    held_rows = grouped(rows, model)
    n, y = held_rows.agg(F.sum("_n"), F.sum("_y")).first()
    if not n:
        return model
    model.base = y / n
    width, spark = max(len(e) for e in model.edges) + 2, df.sparkSession

    def sums(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        first, size = (1 << level) - 1, 1 << level
        held = spark.sparkContext.broadcast((model, tree))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, t = held.value
            predict = m.predictor()
            total = np.zeros((2, size, len(features), width))
            for b in batches:
                if b.num_rows:
                    x = np.stack([b.column(f"_{k}").to_numpy() for k in range(len(features))], axis=1).astype(int)
                    n = b.column("_n").to_numpy()
                    g = n * predict(x) - b.column("_y").to_numpy()
                    at = t.nodes(x) - first
                    inside = at >= 0  # rows in leaves above have no further split
                    for k in range(len(features)):
                        key = at[inside] * width + x[inside, k]
                        total[0, :, k] += np.bincount(key, g[inside], size * width).reshape(size, width)
                        total[1, :, k] += np.bincount(key, n[inside], size * width).reshape(size, width)
            yield _blocks(total.ravel())

        both = added(held_rows.mapInArrow(run, "block int, values array<double>"), 2 * size * len(features) * width).reshape(2, size, len(features), width)
        return both[0], both[1]

    for _ in range(trees):
        n = (1 << (depth + 1)) - 1
        tree = Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))
        for level in range(depth):
            grad, count = sums(tree, level)
            for i, (_, f, cut, null_left) in enumerate(best_splits(grad, count, ridge, least)):
                at, g, c = (1 << level) - 1 + i, grad[i, 0], count[i, 0]
                if level == 0 or c.sum():
                    tree.value[at] = -rate * g.sum() / (c.sum() + ridge)
                if f >= 0:
                    tree.feature[at], tree.cut[at], tree.null_left[at] = f, cut, null_left
                    own = np.arange(width)
                    left = np.where(own == 0, null_left, own <= cut)
                    for child, side in ((2 * at + 1, left), (2 * at + 2, ~left)):
                        tree.value[child] = -rate * grad[i, f][side].sum() / (count[i, f][side].sum() + ridge)
        model.trees.append(tree)
    return model


def predicted(df: DataFrame, model: Boosted, name: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = None
        for b in batches:
            if b.num_rows:
                predict = predict or held.value.predictor()
                p = predict(held.value.binned(_columns(b, held.value.features)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, name])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def importance(df: DataFrame, model: Boosted, target: str, seed: int = 1) -> DataFrame:
    """``feature, n, mae, within_double``: errors with each feature's values dealt out anew within batches of rows, and, for a null feature, as they are.

    All are found in one pass.
    """
    held, features = df.sparkSession.sparkContext.broadcast(model), model.features
    rows = df.where(F.col(target).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, total, predict = np.random.default_rng(seed), np.zeros((len(features) + 1, 3)), held.value.predictor()
        for b in batches:
            if b.num_rows:
                x, y = held.value.binned(_columns(b, features)), b.column("_y").to_numpy()
                for k in range(-1, len(features)):
                    z = x.copy()
                    if k >= 0:
                        z[:, k] = rng.permutation(z[:, k])
                    e = np.abs(predict(z) - y)
                    total[k + 1] += len(e), e.sum(), (e <= np.log(2)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([None, *features], pa.string()), *(pa.array(total[:, j]) for j in range(3))], ["feature", "n", "e", "w"])

    found = rows.mapInArrow(run, "feature string, n double, e double, w double").groupBy("feature").agg(*(F.sum(c).alias(c) for c in "new"))
    return found.select("feature", F.col("n").cast("long").alias("n"), F.try_divide("e", "n").alias("mae"), F.try_divide("w", "n").alias("within_double"))
