"""Mixing a corpus to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document a posterior over domains.  Documents then get nonnegative
rates such that the expected tokens of each domain, the sum over documents of rate * tokens * posterior, match a target;
the rates come from projected gradient steps on least squares, of which each is one aggregate over the corpus.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import hashed
from lotwise.llm.common import kept_apart, written


@dataclass
class Model:
    """Selected columns, a weight and an offset for each domain."""

    domains: list[str]
    columns: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], ridge: float = 0.3, rows: int = hashed.FIT_ROWS) -> Model:
    """A multinomial logistic model of ``labels`` (doc_id, domain) on the texts of ``docs`` (doc_id, text).

    Domains not listed and null ids take no part; without labels all domains are equally likely, and with some a domain
    that has none has posterior 0.  Which columns count
    follows from all labelled rows; weights from the ``rows`` rows of smallest hash.
    """
    k = len(domains)
    place = F.create_map(*(F.lit(x) for i, d in enumerate(domains) for x in (d, i)))
    labelled = hashed.labelled_rows(docs if hashed.AT in docs.columns else hashed.with_features(docs, True), labels.select("doc_id", place[F.col("domain")].alias("label")))
    columns = hashed.telling(labelled, k)
    at, y, _ = hashed.fit_rows(labelled, columns, rows)
    x, n, m = hashed.Rows(at, len(columns)), len(y), len(columns)
    if not n:
        return Model(domains, columns, np.zeros((m, k)), np.zeros(k))
    hot = np.eye(k)[y]

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[: m * k].reshape(m, k), v[m * k :]
        s = x.times(w) + b
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        off = (p - hot) / n
        g = x.back(off) + ridge / n * w
        return float(-np.mean(np.log(np.maximum(p[np.arange(n), y], 1e-300))) + ridge / 2 / n * (w * w).sum()), np.concatenate([g.ravel(), off.sum(axis=0)])

    v = hashed.minimise(objective, np.concatenate([np.zeros(m * k), np.log((hot.sum(axis=0) + 0.5) / (n + k / 2))]), 80)
    return Model(domains, columns, v[: m * k].reshape(m, k), np.where(hot.any(axis=0), v[m * k :], -1e9))


def posteriors(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``_tokens`` (words of the text) and ``_posterior``, an array in the order of the model's domains.

    ``docs`` has texts, or is a table made by ``hashed.with_features``.
    """
    ready = docs if hashed.AT in docs.columns else docs.withColumn(hashed.TOKENS, F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")).cast("long"))
    raw = hashed.linear_scores(ready, model.columns, model.weights, model.offsets, True, (*keep, hashed.TOKENS))
    shifted = raw.withColumn("_e", F.transform("_raw", lambda v: F.exp(v - F.array_max("_raw"))))
    return shifted.select(*keep, hashed.TOKENS, F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).alias("_posterior"))


@dataclass
class Mixture:
    """Rated documents, the expected tokens by domain at their rates, the goals, and whether these were met."""

    rated: DataFrame
    got: list[float]
    goal: list[float]
    settled: bool


def goals(have: np.ndarray, targets: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Tokens asked of each domain: the targets' shares of the largest total that raises no domain above what it has.

    With ``whole`` the total is what those domains together have by their shares, and the others give what they can.
    A domain without tokens can't have a share, so the others' shares hold among themselves.
    """
    t = np.where(have > 0, targets, 0.0)
    if not t.sum():
        return np.zeros(len(t))
    t = t / t.sum()
    if whole is not None and t[whole].sum():
        goal = np.minimum(have, t * have[whole].sum() / t[whole].sum())
        goal[whole] = have[whole]
        return goal
    return t * min(have[j] / t[j] for j in range(len(t)) if t[j] > 0)


def rates(members: DataFrame, targets: list[float], whole: list[int] | None = None, steps: int = 100, strict: bool = True, tolerance: float = 1e-4, tokens: str = "_tokens", posterior: str = "_posterior") -> Mixture:
    """``members`` with a ``rate``, such that expected tokens by domain meet :func:`goals` with least change to the rates.

    Least squares of the domains' errors, scaled by their inverse curvature, are brought down by projected gradient
    steps on the rates, from 1: in the metric of tokens the gradient for a document is its posterior times the scaled
    errors, which are summed up unprojected (as one price a domain), and rates are what is left above 0 after every
    step, max(0, 1 - posterior . price).  Where they settle the goals are met with the least change from 1.  A step that
    loses is halved.  A rate follows from the prices, so no
    step rewrites the corpus: one aggregate of sums by domain and by two domains comes back from each.  Prices below 1
    cut off no rate, since posteriors sum to 1; then the sums are known without a pass.  An empty corpus gets no rates.

    Goals that aren't met after ``steps`` raise RuntimeError, or, if not ``strict``, warn and leave the rates as they are.
    """
    k, p, n = len(targets), F.col(posterior), F.col(tokens)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    fall = lambda price: sum((p[j] * float(price[j]) for j in range(1, k)), p[0] * float(price[0]))

    def sums(price: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens by domain, the curvature over the rates above 0, and the dual value less that of the goals."""
        found = members.select(n.alias("n"), p.alias("p"), fall(price).alias("f"))
        q, f = F.col("p"), F.col("f")
        rate, above = F.col("n") * F.greatest(F.lit(0.0), 1 - f), F.when(f < 1, F.col("n")).otherwise(0)
        value = F.sum(F.col("n") * F.when(f < 1, f - f * f / 2).otherwise(0.5))
        row = found.agg(value, *(F.sum(rate * q[j]) for j in range(k)), *(F.sum(above * q[i] * q[j]) for i, j in pairs)).first()
        v = np.array([x or 0.0 for x in row])
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, v[k + 1 :], strict=True):
            curve[i, j] = curve[j, i] = x
        return v[1 : k + 1], curve, float(v[0])

    have, curve, _ = sums(np.zeros(k))
    goal = goals(have, np.array(targets, float), None if whole is None else np.array(whole))
    scale = 1 / np.maximum(goal, have.sum() * 1e-6 or 1.0)
    off = lambda got: float(np.abs(scale * (got - goal))[goal > 0].max(initial=0.0))
    price, got, value, step = np.zeros(k), have, 0.0, 1.0
    full = curve
    for _ in range(steps):
        if off(got) < tolerance:
            break
        if step == 1.0:  # in goal units, damped where a domain has next to nothing
            c = scale[:, None] * curve * scale
            way = scale * np.linalg.solve(c + (1e-9 * np.trace(c) or 1.0) * np.eye(k), scale * (got - goal))
        new = price + step * way
        if new.max() < 1:
            got2, curve2, value2 = have - full @ new, full, new @ have - new @ full @ new / 2
        else:
            got2, curve2, value2 = sums(new)
        if value2 - new @ goal >= value - price @ goal + 1e-4 * step * (way @ (got - goal)) or off(got2) < tolerance or step < 1e-6:
            price, got, curve, value, step = new, got2, curve2, value2, 1.0
        else:
            step /= 2
    settled = off(got) < tolerance
    if not settled:
        said = f"rates stopped {off(got):.2g} off their goals, relative to them"
        if strict:
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=2)
    return Mixture(members.withColumn("rate", F.greatest(F.lit(0.0), 1 - fall(price))), got.tolist(), goal.tolist(), settled)


@kept_apart(r"_tokens|_posterior|_raw|_e|rate")
def mix(docs: DataFrame, model: Model, targets: dict[str, float], keep: tuple[str, ...] = ("doc_id",), whole: tuple[str, ...] = (), strict: bool = True) -> Mixture:
    """``rated`` has ``keep``, ``_tokens``, ``_posterior`` and ``rate`` for every document.

    ``targets`` are relative weights of the model's domains; the total is the largest that raises no domain above what
    it has, or, with ``whole``, such that these domains keep all their tokens.  Null and empty texts have no tokens and
    get the rate of their posterior; repeated rows get equal rates.
    """
    members = written(posteriors(docs, model, keep), "posteriors")
    return rates(members, [targets[d] for d in model.domains], [model.domains.index(d) for d in whole] or None, strict=strict)


def draws(rate, *key):
    """How many copies to take at a rate: its whole part and one more with the chance of the rest, by a hash of ``key``."""
    whole = F.floor(rate)
    chance = F.pmod(F.xxhash64(*key, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return (whole + (chance < rate - whole).cast("long")).cast("int")
