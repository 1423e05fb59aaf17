"""Ridges from sums against dense regressions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.operators import ridges
from lotwise.plans.pricing import logs
from lotwise.sources.tables import works

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lots(spark):
    w = works(spark, SF).select("work", F.log("size").alias("size_log"), "list_price")
    return logs(spark, SF).join(w, "work").select("artist", "work", F.year("sale_date").alias("year"), "edition", "size_log", "premium", "y").persist()


def dense(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    x1 = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    return np.linalg.lstsq(x1.T @ x1 + alpha * np.diag([0.0] + [1.0] * x.shape[1]), x1.T @ y, rcond=None)[0]


@pytest.mark.parametrize(("x", "alpha"), [(["edition", "size_log", "premium"], 10.0), (["edition"], 0.5), (["edition", "size_log"], 0.0)])
def test_ridge_of_each_group(spark, lots, x, alpha):
    frame = lots.toPandas()
    got = {r.artist: r for r in ridges.by_group(lots, "artist", x, "y", alpha, 15).collect()}
    groups = {a: g for a, g in frame.groupby("artist") if len(g) >= 15}
    assert set(got) == set(groups) and got
    for a, g in groups.items():
        want = dense(g[x].to_numpy(float), g.y.to_numpy(), alpha)
        assert got[a].n == len(g) and np.allclose([got[a].intercept, *got[a].slopes], want, atol=1e-6)


def test_ridges_with_nulls_constants_and_no_rows(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", None, 9.0), ("b", 3.0, 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.n, r.intercept, r.slopes) for r in ridges.by_group(df, "g", ["x"], "y", 1.0).collect()}
    assert got == {"a": (2, 2.0, [0.0]), "b": (1, 1.0, [0.0])}
    assert ridges.by_group(df.limit(0), "g", ["x"], "y", 1.0).count() == 0 and list(ridges.pooled(df.limit(0), ["x"], "y", 1.0)) == [0, 0]


def test_strength_by_a_pass_over_rows(spark, lots):
    x, grid, alpha = ["edition", "size_log"], [0.0, 5.0, 50.0, 1e6], 2.0
    train, held = lots.where("year < 1997"), lots.where("year >= 1997").unionByName(lots.limit(3).withColumn("artist", F.lit(-1).cast("long")))
    held = held.persist()
    a, b = train.toPandas(), held.toPandas()
    prior = dense(a[x].to_numpy(float), a.y.to_numpy(), alpha)
    own = {g: (len(r), dense(r[x].to_numpy(float), r.y.to_numpy(), alpha)) for g, r in a.groupby("artist") if len(r) >= 5}
    got = ridges.strengths(train, held, "artist", x, "y", alpha, grid, 5).collect()
    assert [r.strength for r in got if r.best] == [min(got, key=lambda r: r.error).strength] and len(got) == len(grid)
    for r in got:
        error = 0.0
        for g, part in b.groupby("artist"):
            n, c = own.get(g, (0, prior))
            c = (n * c + r.strength * prior) / (n + r.strength) if n else prior
            error += ((part.y - c[0] - part[x].to_numpy(float) @ c[1:]) ** 2).sum()
        assert r.n == len(b) and r.error == pytest.approx(error / len(b), rel=1e-8)


@pytest.mark.parametrize(("many", "few", "x", "alpha"), [("artist", "year", ["edition", "size_log"], 3.0), ("work", "artist", ["premium"], 1.0), ("artist", "year", [], 0.5)])
def test_two_effects_equal_dense_dummies(spark, lots, many, few, x, alpha):
    frame = lots.toPandas()
    found = ridges.TwoWay(lots, many, few, x, "y", alpha)
    a, b = (pd.get_dummies(frame[c]).astype(float) for c in (many, few))
    want = dense(np.concatenate([a, b, frame[x].to_numpy(float).reshape(len(frame), -1)], axis=1), frame.y.to_numpy(), alpha)
    intercept, slopes = found.coefficients()
    effects = {r[many]: r.effect for r in found.many_effects().collect()}
    others = {r[few]: r.effect for r in found.few_effects().collect()}
    assert np.allclose(intercept, want[0], atol=1e-6) and np.allclose(list(slopes.values()), want[1 + a.shape[1] + b.shape[1] :], atol=1e-6)
    assert np.allclose([effects[c] for c in a.columns], want[1 : 1 + a.shape[1]], atol=1e-6) and np.allclose([others[c] for c in b.columns], want[1 + a.shape[1] : 1 + a.shape[1] + b.shape[1]], atol=1e-6)


def test_two_effects_of_few_rows(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 5.0), ("b", 2, None)], "g string, f long, y double")
    one = ridges.TwoWay(df, "g", "f", [], "y", 1.0)
    assert one.rows == 2 and {r.g: r.n for r in one.many_effects().collect()} == {"a": 2}
    assert ridges.TwoWay(df.limit(0), "g", "f", [], "y", 1.0).many_effects().count() == 0
    monkeypatch.setattr(ridges, "LEVELS", 1)
    with pytest.raises(ValueError):
        ridges.TwoWay(df, "g", "f", [], "y", 1.0)


def test_intervals_equal_works_drawn_by_hand(spark, lots):
    draws, frame = 25, lots.toPandas()
    got = {r.year: r for r in ridges.bootstrap_effects(lots, "work", "year", "y", 1995, draws).collect()}
    weight = dict(zip(keys := sorted(frame.work.unique()), ridges.drawn_weights(np.array(keys), draws), strict=True))
    years = sorted(frame.year.unique())
    seen = []
    for d in range(draws):
        again = pd.concat([frame.loc[frame.index.repeat(frame.work.map(lambda w, d=d: int(weight[w][d])))]])
        w, f = pd.get_dummies(again.work.astype(str)).to_numpy(float), np.stack([again.year == v for v in years if v != 1995], axis=1).astype(float)
        seen.append(np.linalg.lstsq(np.concatenate([w, f], axis=1), again.y.to_numpy(), rcond=None)[0][w.shape[1] :])
    low, high = np.quantile(np.array(seen), [0.05, 0.95], axis=0)
    rest = [v for v in years if v != 1995]
    assert np.allclose([got[v].p5 for v in rest], low, atol=1e-6) and np.allclose([got[v].p95 for v in rest], high, atol=1e-6)
    assert got[1995].effect == got[1995].p5 == 0 and all(got[v].p5 <= got[v].effect <= got[v].p95 for v in rest)
    assert 0.9 < np.mean(list(weight.values())) < 1.1


def test_levels_that_are_never_compared(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 3.0), (2, "z", 5.0), (2, "u", 6.0), (3, "x", 1.0)], "k long, f string, y double")
    got = {r.f: r.effect for r in ridges.bootstrap_effects(df, "k", "f", "y", "x", 4).collect()}
    assert got == {"x": 0.0, "y": 2.0, "z": None, "u": None}
