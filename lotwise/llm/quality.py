"""Document quality as an ordinal grade.

One set of hashed-text weights gives a document a position on a line; ordered thresholds cut the line into grades:
P(grade > k) is the logistic function of the position less threshold k.  From these come the expected grade and the
probability of the tail that selection asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import hashed
from lotwise.llm.common import kept_apart


@dataclass
class Model:
    """Selected columns, shared weights and the ascending thresholds between grades."""

    columns: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def fit(docs: DataFrame, ratings: DataFrame, grades: int, ridge: float = 0.2, rows: int = hashed.FIT_ROWS) -> Model:
    """Fit to the texts of ``docs`` (doc_id, text) that ``ratings`` (doc_id, label) grades 0 to ``grades`` - 1.

    ``docs`` may be a table made by ``hashed.with_features``.  Other labels and null ids take no part and null texts are empty.  Without ratings every tail has probability a half.
    Which columns count follows from all rated rows; weights from the ``rows`` of smallest hash.
    """
    rated = hashed.labelled_rows(docs if hashed.AT in docs.columns else hashed.with_features(docs, True), ratings.where(F.col("label").between(0, grades - 1)))
    columns = hashed.telling(rated, grades)
    at, y, _ = hashed.fit_rows(rated, columns, rows)
    x, n, cuts = hashed.Rows(at, len(columns)), len(y), grades - 1
    if not n:
        return Model(columns, np.zeros(len(columns)), np.zeros(cuts))
    above = np.array([((y > k).sum() + 0.5) / (n + 1) for k in range(cuts)])
    first = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    ridge = ridge / n

    def thresholds(t: np.ndarray) -> np.ndarray:
        return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = v[: len(columns)], v[len(columns) :]
        cut, s = thresholds(t), x.times(w)
        upper = np.concatenate([np.full((n, 1), 1.0), hashed.sigmoid(s[:, None] - cut), np.zeros((n, 1))], axis=1)
        p = np.maximum(upper[np.arange(n), y] - upper[np.arange(n), y + 1], 1e-12)
        slope = upper * (1 - upper)
        lo, hi = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        by_score = -(lo - hi) / p / n
        by_cut = np.zeros(cuts)
        for k in range(cuts):
            by_cut[k] = np.sum((lo / p)[y == k + 1]) / n - np.sum((hi / p)[y == k]) / n
        by_t = np.empty(cuts)
        by_t[0] = by_cut.sum()
        for k in range(1, cuts):
            by_t[k] = np.exp(t[k]) * by_cut[k:].sum()
        return float(-np.mean(np.log(p)) + ridge / 2 * (w @ w)), np.concatenate([x.back(by_score) + ridge * w, by_t])

    v = hashed.minimise(objective, np.concatenate([np.zeros(len(columns)), first[:1], gaps]))
    return Model(columns, v[: len(columns)], thresholds(v[len(columns) :]))


@kept_apart(r"expected_grade|tail_probability|keep|_raw")
def score(df: DataFrame, model: Model, tail: int, least: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``expected_grade``, ``tail_probability`` of grade ``tail`` or better and ``keep`` (tail at ``least``).

    A narrow pass over whole texts; null and empty texts are scored by being empty, repeated rows alike.
    """
    raw = hashed.linear_scores(df, model.columns, model.weights[:, None], np.zeros(1), True, keep)
    above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("_raw")[0])) for t in model.thresholds]
    return raw.select(*keep, sum(above[1:], above[0]).alias("expected_grade"), above[tail - 1].alias("tail_probability"), (above[tail - 1] >= least).alias("keep"))
