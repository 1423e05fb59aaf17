"""Statistical estimates: robust spread, shrinkage, fixed effects, calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.learn import running_sums


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def median_and_spread(df: DataFrame, by: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """Count, median and 1.4826 times the median deviation from it, at least ``floor``."""
    mid = df.groupBy(*by).agg(median(value).alias("median"), F.count(value).alias("n"))
    off = df.join(mid, by).groupBy(*by).agg(median(F.abs(F.col(value) - F.col("median"))).alias("_off"))
    return mid.join(off, by).select(*by, "n", "median", F.greatest(F.lit(floor), F.lit(1.4826) * F.col("_off")).alias("spread"))


def shrunk(own: Column, n: Column, prior: Column, strength: float) -> Column:
    """A mean of ``n`` values drawn towards a prior worth ``strength`` values; the prior without values."""
    return (F.coalesce(own * n, F.lit(0.0)) + strength * prior) / (F.coalesce(n, F.lit(0)) + strength)


def within_effects(df: DataFrame, group: str, outcome: str, factor: str, reference) -> DataFrame:
    """(factor, effect): least squares of an outcome on a group's own level and a factor, relative to ``reference``.

    Group levels are taken out by demeaning, the normal equations are sums over the data and only their few numbers, one
    for each pair of factor levels, come to the driver.  Groups of one row say nothing and levels that never vary within
    a group get no effect.
    """
    w = Window.partitionBy(group)
    rows = df.select(group, F.col(outcome).cast("double").alias("y"), F.col(factor).alias("f")).withColumn("n", F.count("*").over(w)).where("n > 1").withColumn("y", F.col("y") - F.avg("y").over(w))
    cells = rows.groupBy(group, "f").agg(F.count("*").alias("c"), F.sum("y").alias("s"), F.first("n").alias("n"))
    b = {r.f: r.s for r in cells.groupBy("f").agg(F.sum("s").alias("s")).collect()}
    own = {r.f: r.v for r in cells.groupBy("f").agg(F.sum("c").alias("v")).collect()}
    left, right = cells.select(group, F.col("f").alias("f1"), F.col("c").alias("c1"), "n"), cells.select(group, F.col("f").alias("f2"), F.col("c").alias("c2"))
    pairs = left.join(right, group).groupBy("f1", "f2").agg(F.sum(F.col("c1") * F.col("c2") / F.col("n")).alias("v")).collect()
    levels = sorted(b)
    at = {f: i for i, f in enumerate(levels)}
    a = np.diag([float(own[f]) for f in levels]) if levels else np.zeros((0, 0))
    for r in pairs:
        a[at[r.f1], at[r.f2]] -= r.v
    free = [i for i, f in enumerate(levels) if f != reference]
    effect = np.zeros(len(levels))
    if free:
        effect[free] = np.linalg.lstsq(a[np.ix_(free, free)], np.array([b[levels[i]] for i in free]), rcond=1e-9)[0]
    kind = df.schema[factor].dataType.simpleString()
    return df.sparkSession.createDataFrame([(f, float(effect[i])) for i, f in enumerate(levels)], f"{factor} {kind}, effect double")


def pooled_line(df: DataFrame, x: list[str], y: str, ridge: float = 0.0) -> list[float]:
    """Intercept and slopes of a least-squares fit, penalised but for the intercept, from sums over the data."""
    terms = ["1", *x]
    col = lambda t: F.lit(1.0) if t == "1" else F.col(t).cast("double")
    sums = df.agg(*(F.sum(col(a) * col(b)).alias(f"a{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)), *(F.sum(col(a) * F.col(y)).alias(f"b{i}") for i, a in enumerate(terms))).first()
    k = len(terms)
    a = np.array([[sums[f"a{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) + ridge * np.diag([0.0] + [1.0] * (k - 1))
    return np.linalg.lstsq(a, np.array([sums[f"b{i}"] or 0.0 for i in range(k)]), rcond=None)[0].tolist()


#: Points of the grid that log prices are spread over, and its reach either side of the witnesses' mean.
GRID, REACH = 601, 4.0


def blend(witnesses: DataFrame, key: str, temperature: float = 1.0, freedom: float = 5.0) -> DataFrame:
    """``key, n, median, p10, p90, divergence``: witnesses (mu, sigma, weight) pooled on a grid of log prices.

    Each witness is a Student t density; logs add up by weight, over a temperature.  Quantiles are read off the right
    edges of cells.  Divergence is the spread of the witnesses' positions against their own.
    """
    w = F.col("weight")
    mid = witnesses.groupBy(key).agg(F.collect_list(F.struct("mu", "sigma", "weight")).alias("all"), (F.sum(w * F.col("mu")) / F.sum(w)).alias("mean"), F.count("*").alias("n"), F.sqrt(F.sum(w * F.col("mu") ** 2) / F.sum(w) - (F.sum(w * F.col("mu")) / F.sum(w)) ** 2).alias("apart"), (F.sum(w * F.col("sigma")) / F.sum(w)).alias("own"))
    step, shares = 2 * REACH / (GRID - 1), (0.5, 0.1, 0.9)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_024):
                b = whole.slice(lo, 1_024)
                lists, mean = b.column("all"), b.column("mean").cast(pa.float64()).to_numpy(zero_copy_only=False)
                mu, sigma, weight = (lists.flatten().field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("mu", "sigma", "weight"))
                counts = lists.value_lengths().to_numpy()
                starts = np.cumsum(counts) - counts
                x = mean[:, None] - REACH + np.arange(GRID) * step
                logs = np.zeros_like(x)
                for j in range(counts.max()):
                    has = np.flatnonzero(counts > j)
                    m, g, v = (c[starts[has] + j][:, None] for c in (mu, sigma, weight))
                    logs[has] -= v * (np.log(g) + (freedom + 1) / 2 * np.log(1 + ((x[has] - m) / g) ** 2 / freedom))
                logs /= temperature
                dens = np.exp(logs - logs.max(axis=1, keepdims=True))
                cum, found = dens.cumsum(axis=1), []
                for q in shares:
                    goal = q * cum[:, -1:]
                    at = (cum >= goal).argmax(axis=1)
                    each = np.arange(len(at))
                    found.append(mean - REACH + (at + 0.5) * step - step * (cum[each, at] - goal[:, 0]) / dens[each, at])
                kept = [b.column(c) for c in (key, "n", "apart", "own")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.exp(f), from_pandas=True) for f in found)], [key, "n", "apart", "own", "median", "p10", "p90"])

    kind = mid.schema[key].dataType.simpleString()
    got = mid.mapInArrow(read, f"{key} {kind}, n long, apart double, own double, median double, p10 double, p90 double")
    return got.select(key, "n", "median", "p10", "p90", (F.coalesce("apart", F.lit(0.0)) / F.col("own")).alias("divergence"))


def ranked_area(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc, positives, negatives``: chance that a positive outranks a negative, ties a half, from average ranks.

    Ranks come from counts by distinct score, so windows run over ranges of scores, not rows.
    """
    by = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p"))
    sums = running_sums(by, score, ["n"])
    ranks = sums.withColumn("rank", F.col("all_n") - F.col("sum_n") + (F.col("n") + 1) / 2)
    s = ranks.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    return s.select(((F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def crps(mu: Column, sigma: Column, x: Column) -> Column:
    """Continuous ranked probability score of a normal forecast, by the logistic approximation of its distribution."""
    z = (x - mu) / sigma
    cdf = 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z**3)))
    pdf = F.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    return sigma * (z * (2 * cdf - 1) + 2 * pdf - 1 / math.sqrt(math.pi))
