"""Ridge regressions from sums over the data: by group, with two sets of effects, and drawn again by cluster.

Rows are reduced to sums by Spark once; what is solved afterwards are the small systems that the sums make up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.durable import durable

#: Levels of the smaller set of effects, whose vector goes to every task: 40 MB at most.
LEVELS = 5_000_000
#: Levels of a factor whose effects are drawn again; the sums are levels squared by draws.
FACTOR = 300
_BLOCK = 1 << 16


def moments(df: DataFrame, group: list[str], x: list[str], y: str) -> DataFrame:
    """``group, n, m``: sums of all products of (1, x, y), the upper triangle row by row; rows with a null take no part."""
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in x), F.col(y).cast("double")]
    full = df.dropna(subset=[*x, y])
    sums = F.array(*(F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))))
    return full.groupBy(*group).agg(F.count("*").alias("n"), sums.alias("m"))


def _square(m: np.ndarray, k: int) -> np.ndarray:
    """Rows of upper triangles as symmetric matrices of ``k`` by ``k``."""
    full = np.zeros((len(m), k, k))
    i, j = np.triu_indices(k)
    full[:, i, j] = full[:, j, i] = m
    return full


def solved(s: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, slopes) of each matrix of moments of (1, x, y); the intercept isn't penalised.

    Columns that say nothing get slope 0: least norm among the best, if ``alpha`` is 0.
    """
    n, k = s[:, 0, 0], s.shape[1] - 2
    mean = s[:, 0, 1:] / n[:, None]
    centred = s[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None]
    a, b = centred[:, :k, :k] + alpha * np.eye(k), centred[:, :k, k]
    slopes = np.linalg.solve(a, b[:, :, None])[:, :, 0] if alpha > 0 else (np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b[:, :, None])[:, :, 0]
    return np.concatenate([(mean[:, k] - (mean[:, :k] * slopes).sum(axis=1))[:, None], slopes], axis=1)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_group(df: DataFrame, group: str, x: list[str], y: str, alpha: float, least: int = 1) -> DataFrame:
    """``group, n, intercept, slopes``: a ridge for each group of ``least`` rows or more."""
    sums, k = moments(df, [group], x, y).where(F.col("n") >= least), len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = solved(_square(_lists(b.column("m")), k + 2), alpha)
                slopes = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * k, pa.int32()), pa.array(c[:, 1:].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(group), b.column("n"), pa.array(c[:, 0]), slopes], [group, "n", "intercept", "slopes"])

    return sums.mapInArrow(run, f"{group} {df.schema[group].dataType.simpleString()}, n long, intercept double, slopes array<double>")


def pooled(df: DataFrame, x: list[str], y: str, alpha: float) -> np.ndarray:
    """(intercept, slopes) of one ridge over all rows."""
    rows = moments(df, [], x, y).collect()
    return solved(_square(np.array([rows[0].m], float), len(x) + 2), alpha)[0] if rows[0].n else np.zeros(len(x) + 1)


def strengths(train: DataFrame, held: DataFrame, group: str, x: list[str], y: str, alpha: float, grid: list[float], least: int = 1) -> DataFrame:
    """``strength, n, error, best``: mean squared error on ``held`` of ridges by group drawn towards the pooled one.

    A group's coefficients count for its rows, the pooled ones for ``strength`` rows; groups of fewer than ``least`` rows,
    and those that aren't in ``train``, have the pooled ones.  Errors follow from the moments of ``held``, so all
    strengths are scored in one pass over groups, and rows are read once for each side.
    """
    k, prior = len(x) + 2, pooled(train, x, y, alpha)
    own = moments(train, [group], x, y).where(F.col("n") >= least).select(group, F.col("m").alias("_own"))
    both = moments(held, [group], x, y).join(own, group, "left").select("m", "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error, n = np.zeros(len(grid)), 0.0
        for b in batches:
            if b.num_rows:
                s = _square(_lists(b.column("m")), k)
                c, size = np.tile(prior, (len(s), 1)), np.zeros(len(s))
                known = b.column("_own").is_valid().to_numpy(zero_copy_only=False)
                if known.any():
                    t = _square(_lists(b.column("_own").filter(pa.array(known))), k)
                    c[known], size[known] = solved(t, alpha), t[:, 0, 0]
                for i, strength in enumerate(grid):
                    total = np.maximum(size + strength, 1e-300)[:, None]
                    drawn = np.where(size[:, None] > 0, (size[:, None] * c + strength * prior) / total, prior)
                    full = np.concatenate([drawn, -np.ones((len(s), 1))], axis=1)
                    error[i] += np.einsum("gi,gij,gj->", full, s, full)
                n += s[:, 0, 0].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(grid, float)), pa.array(error), pa.array(np.full(len(grid), n))], ["strength", "error", "n"])

    sums = both.mapInArrow(run, "strength double, error double, n double").groupBy("strength").agg(F.sum("n").cast("long").alias("n"), F.try_divide(F.sum("error"), F.sum("n")).alias("error"))
    low = sums.agg(F.min(F.struct("error", "strength")).alias("low"))
    return sums.crossJoin(F.broadcast(low)).select("strength", "n", "error", (F.col("strength") == F.col("low.strength")).alias("best"))


def added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors that tasks give as (block, values) rows, added up on the executors by block."""

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in rows.column("values").to_pylist()], axis=0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    out = np.zeros(size)
    for r in parts.groupBy("block").applyInArrow(unite, "block int, values array<double>").collect():
        out[r.block * _BLOCK : r.block * _BLOCK + len(r["values"])] = r["values"]
    return out


def _blocks(v: np.ndarray) -> pa.RecordBatch:
    pieces = [v[lo : lo + _BLOCK].tolist() for lo in range(0, len(v), _BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], ["block", "values"])


class TwoWay:
    """A ridge on columns ``x`` and a level for each value of two columns, all penalised by ``alpha`` but for the intercept.

    Rows become sums by pair of levels, packed into a row for each level of ``many``.  The levels of ``many``, of which
    there may be any number, are eliminated exactly within those rows; conjugate gradients solve for the rest, the levels
    of ``few`` (at most ``LEVELS``), the slopes and the intercept, each step one pass over the packed sums.  Nothing of
    the size of levels squared is ever made.
    """

    def __init__(self, df: DataFrame, many: str, few: str, x: list[str], y: str, alpha: float, tolerance: float = 1e-10, rounds: int = 500):
        self.many, self.few, self.x, self.alpha = many, few, x, alpha
        full = df.dropna(subset=[many, few, *x, y])
        levels = durable(full.select(few).distinct())
        count = levels.count()
        if count > LEVELS:
            raise ValueError(f"{count} levels of {few}; the smaller set of effects may have {LEVELS}")
        self.names = sorted(r[0] for r in levels.collect())
        numbered = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(self.names)], f"_few {df.schema[few].dataType.simpleString()}, _b int")
        sums = full.groupBy(many, few).agg(F.count("*").cast("double").alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(x)), F.sum(F.col(y).cast("double")).alias("y"))
        parts = ["n", *(f"s{i}" for i in range(len(x))), "y"]
        keyed = sums.join(numbered, F.col(few) == F.col("_few"))
        self.packed = durable(keyed.groupBy(many).agg(F.collect_list(F.struct("_b", *parts)).alias("c")).select(many, F.col("c._b").alias("b"), *(F.col(f"c.{p}").alias(p) for p in parts)))
        squares = moments(full, [], x, y).first()
        k = len(x)
        s = _square(np.array([squares.m], float), k + 2)[0] if squares.n else np.zeros((k + 2, k + 2))
        self._xx, self.rows = s[1 : k + 1, 1 : k + 1], squares.n
        size = len(self.names) + k + 1
        right = self._reduced(np.zeros(size), outcome=True) + np.concatenate([np.zeros(len(self.names)), s[1 : k + 1, k + 1], [0.0]])
        self.solution, self.steps = self._solve(right, tolerance, rounds)

    def _each(self, use: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch | None]):
        """A function of batches that unpacks them: which row each cell is of, its level of ``few``, n, sums of x, sum of y."""
        k = len(self.x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
                    at = np.repeat(np.arange(b.num_rows), b.column("b").value_lengths().to_numpy())
                    s = np.stack([flat(f"s{i}") for i in range(k)], axis=1) if k else np.zeros((len(at), 0))
                    yield from use(b, at, flat("b"), flat("n"), s, flat("y"))

        return run

    def _reduced(self, p: np.ndarray, outcome: bool = False) -> np.ndarray:
        """What the system without the levels of ``many`` makes of ``p``, but for the products of x; for ``outcome`` its right side from the sums of y."""
        held = self.packed.sparkSession.sparkContext.broadcast(p)
        m, k, alpha = len(self.names), len(self.x), self.alpha

        def use(_, at, level, n, s, y):
            v = held.value
            base = y if outcome else n * (v[level] + v[-1]) + s @ v[m : m + k]
            z = np.bincount(at, base) / (np.bincount(at, n) + alpha)
            left = base - n * z[at]
            of_x = s.T @ (-z[at] if outcome else v[level] + v[-1] - z[at])
            yield _blocks(np.concatenate([np.bincount(level, left, m), of_x, [left.sum()]]))

        out = added(self.packed.mapInArrow(self._each(use), "block int, values array<double>"), m + k + 1)
        if not outcome:
            out[m : m + k] += self._xx @ p[m : m + k]
            out[: m + k] += alpha * p[: m + k]
        return out

    def _solve(self, b: np.ndarray, tolerance: float, rounds: int) -> tuple[np.ndarray, int]:
        """Conjugate gradients, scaled by the sizes of x; raises RuntimeError if they don't settle."""
        m, k = len(self.names), len(self.x)
        scale = np.ones(m + k + 1)
        scale[m : m + k] = 1 / np.sqrt(np.maximum(np.diag(self._xx) / max(self.rows / max(m, 1), 1), 1e-12)) if k else 1
        x, r = np.zeros(len(b)), b * scale
        p, rr, first = r.copy(), float(r @ r), float(r @ r)
        for step in range(rounds):
            if rr <= tolerance**2 * max(first, 1e-300):
                return x * scale, step
            q = scale * self._reduced(scale * p)
            a = rr / float(p @ q)
            x, r = x + a * p, r - a * q
            rr, before = float(r @ r), rr
            p = r + rr / before * p
        raise RuntimeError(f"not settled after {rounds} steps")

    def coefficients(self) -> tuple[float, dict[str, float]]:
        """Intercept and slopes."""
        m = len(self.names)
        return float(self.solution[-1]), dict(zip(self.x, map(float, self.solution[m:-1]), strict=True))

    def few_effects(self) -> DataFrame:
        """(few, effect)."""
        spark = self.packed.sparkSession
        return spark.createDataFrame(list(zip(self.names, map(float, self.solution), strict=False)), f"{self.few} {self._kind(self.names)}, effect double")

    @staticmethod
    def _kind(values: list) -> str:
        return "string" if values and isinstance(values[0], str) else "long"

    def many_effects(self) -> DataFrame:
        """(many, n, effect)."""
        held, m, k, alpha = self.packed.sparkSession.sparkContext.broadcast(self.solution), len(self.names), len(self.x), self.alpha

        def use(b, at, level, n, s, y):
            v = held.value
            count = np.bincount(at, n)
            effect = np.bincount(at, y - n * (v[level] + v[-1]) - s @ v[m : m + k]) / (count + alpha)
            yield pa.RecordBatch.from_arrays([b.column(self_many), pa.array(count.astype(np.int64)), pa.array(effect)], [self_many, "n", "effect"])

        self_many, each = self.many, self._each(use)
        return self.packed.mapInArrow(each, f"{self.many} {self.packed.schema[self.many].dataType.simpleString()}, n long, effect double")


#: Poisson(1) by cumulative chance, in thousandths.
POISSON = ((368, 0), (736, 1), (920, 2), (981, 3), (996, 4), (1000, 5))


def drawn_weights(cluster: np.ndarray, draws: int) -> np.ndarray:
    """(clusters, draws): how often each cluster is drawn, a Poisson number by a hash of both."""
    with np.errstate(over="ignore"):
        h = cluster.astype(np.int64).view(np.uint64)[:, None] * np.uint64(2654435761) + np.arange(draws, dtype=np.uint64) * np.uint64(40503)
    thousandth = (h % np.uint64(1 << 32)) // np.uint64(7) % np.uint64(1000)
    return np.searchsorted([c for c, _ in POISSON], thousandth, side="right").astype(float)


def bootstrap_effects(df: DataFrame, cluster: str, factor: str, y: str, reference, draws: int) -> DataFrame:
    """``factor, effect, p5, p95``: effects of a factor within clusters, with an interval from whole clusters drawn again.

    A cluster gives one small matrix of its own, whatever the draw; all draws' weighted sums of these are made in one
    pass, and each is solved by itself.  The factor has at most ``FACTOR`` levels; a level that a draw never compares with
    ``reference`` has no effect in it.
    """
    rows = df.dropna(subset=[cluster, factor, y]).groupBy(cluster, factor).agg(F.count("*").cast("double").alias("c"), F.sum(F.col(y).cast("double")).alias("s"))
    names = sorted(r[0] for r in rows.select(factor).distinct().limit(FACTOR + 1).collect())
    if len(names) > FACTOR:
        raise ValueError(f"more than {FACTOR} levels of {factor}")
    m, at = len(names), {v: i for i, v in enumerate(names)}
    packed = rows.groupBy(cluster).agg(F.collect_list(F.struct(factor, "c", "s")).alias("r")).where(F.size("r") > 1).select(F.col(cluster).cast("long").alias("k"), F.col(f"r.{factor}").alias("f"), F.col("r.c").alias("c"), F.col("r.s").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((draws + 1, m, m)), np.zeros((draws + 1, m))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                row = np.repeat(np.arange(b.num_rows), b.column("f").value_lengths().to_numpy())
                level = np.array([at[v] for v in b.column("f").flatten().to_pylist()])
                c, s = np.zeros((b.num_rows, m)), np.zeros((b.num_rows, m))
                c[row, level] = b.column("c").flatten().to_numpy()
                s[row, level] = b.column("s").flatten().to_numpy()
                n = c.sum(axis=1)
                w = np.concatenate([np.ones((b.num_rows, 1)), drawn_weights(b.column("k").to_numpy(), draws)], axis=1)
                gram -= np.einsum("kd,ki,kj->dij", w / n[:, None], c, c, optimize=True)
                gram[:, np.arange(m), np.arange(m)] += w.T @ c
                right += w.T @ (s - c * (s.sum(axis=1) / n)[:, None])
        yield _blocks(np.concatenate([gram.ravel(), right.ravel()]))

    total = added(packed.mapInArrow(run, "block int, values array<double>"), (draws + 1) * m * (m + 1))
    gram, right = total[: (draws + 1) * m * m].reshape(-1, m, m), total[(draws + 1) * m * m :].reshape(-1, m)
    free = [i for i, v in enumerate(names) if v != reference]
    effects = np.full((draws + 1, m), np.nan)
    for d in range(draws + 1):
        linked = _linked(gram[d], at.get(reference))
        use = [i for i in free if i in linked]
        if use:
            effects[d, use] = np.linalg.solve(gram[d][np.ix_(use, use)], right[d, use])
        if at.get(reference) is not None:
            effects[d, at[reference]] = 0.0
    plain = lambda v: None if np.isnan(v) else float(v)
    out = []
    for i, v in enumerate(names):
        seen = effects[1:, i][~np.isnan(effects[1:, i])]
        low, high = np.quantile(seen, [0.05, 0.95]) if len(seen) else (np.nan, np.nan)
        out.append((v, plain(effects[0, i]), plain(low), plain(high)))
    return df.sparkSession.createDataFrame(out, f"{factor} {df.schema[factor].dataType.simpleString()}, effect double, p5 double, p95 double")


def _linked(gram: np.ndarray, start: int | None) -> set[int]:
    """Levels that are compared with ``start``, directly or through others."""
    found, ahead = set(), [] if start is None else [start]
    while ahead:
        i = ahead.pop()
        if i not in found:
            found.add(i)
            ahead += [int(j) for j in np.flatnonzero(gram[i] < -1e-9)]
    return found
