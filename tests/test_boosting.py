"""Boosting on histograms against the same in plain numpy, and against the library's trees on rows with gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import boosting

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 3))
    x[:, 1] = np.round(x[:, 1])
    gap = rng.random((800, 3)) < [0.3, 0.1, 0.0]
    y = np.where(gap[:, 0], 2.0, np.where(x[:, 0] > 0, 1.0, -1.0)) + 0.5 * x[:, 1] * ~gap[:, 1] + 0.05 * rng.normal(size=800)
    x[gap] = np.nan
    data = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y, strict=True)] + [(1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data, "a double, b double, c double, y double").repartition(3).persist()


def plain(x, y, edges, trees, depth, rate, ridge, least):
    """Node by node over all rows, each split tried in turn."""
    bins = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)], axis=1)
    p = np.full(len(y), y.mean())

    def grow(at, g, level):
        out[at] = -rate * g[at].sum() / (at.sum() + ridge)
        if level == depth:
            return
        best = (1e-12, None)
        for null_left in (True, False):
            for k in range(x.shape[1]):
                for cut in range(1, len(edges[k]) + 2):
                    left = at & np.where(bins[:, k] == 0, null_left, bins[:, k] <= cut)
                    right = at & ~left
                    if left.sum() >= least and right.sum() >= least:
                        gain = g[left].sum() ** 2 / (left.sum() + ridge) + g[right].sum() ** 2 / (right.sum() + ridge) - g[at].sum() ** 2 / (at.sum() + ridge)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
        if best[1]:
            for side in best[1]:
                grow(side, g, level + 1)

    for _ in range(trees):
        out = np.zeros(len(y))
        grow(np.ones(len(y), bool), p - y, 0)
        p = p + out
    return p


def test_trees_equal_a_plain_version(rows):
    model = boosting.fit(rows, FEATURES, "y", trees=4, depth=3, bins=8, rate=0.3, ridge=1.0, least=5)
    frame = boosting.predicted(rows, model).toPandas()
    known = frame[frame.y.notna()]
    want = plain(known[FEATURES].to_numpy(float), known.y.to_numpy(), model.edges, 4, 3, 0.3, 1.0, 5)
    assert np.allclose(known.prediction, want, atol=1e-9) and len(frame) == 801


def test_gaps_are_learnt_from(rows):
    """Nulls of ``a`` mean 2, which a fill with the mean hides; the library takes no nulls, so it gets them filled."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    whole = rows.where("y IS NOT NULL").withColumn("held", F.pmod(F.xxhash64(*FEATURES), F.lit(4)) == 0).persist()
    train, held = whole.where("NOT held"), whole.where("held")
    ours = boosting.predicted(held, boosting.fit(train, FEATURES, "y", trees=20)).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    means = train.agg(*(F.avg(c).alias(c) for c in FEATURES)).first().asDict()
    ready = VectorAssembler(inputCols=FEATURES, outputCol="x")
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=20, maxDepth=3, seed=1).fit(ready.transform(train.fillna(means)))
    theirs = model.transform(ready.transform(held.fillna(means))).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert ours < theirs and ours < 0.2


def test_importance_tells_what_matters(rows):
    model = boosting.fit(rows, FEATURES, "y", trees=15)
    found = {r.feature: r for r in boosting.importance(rows, model, "y").collect()}
    assert set(found) == {None, *FEATURES} and all(r.n == 800 for r in found.values())
    assert found["a"].mae > found["b"].mae > found[None].mae and found["c"].mae == pytest.approx(found[None].mae, rel=0.05)


def test_no_rows_constant_features_and_nothing_but_nulls(spark, rows):
    none = boosting.fit(rows.limit(0), FEATURES, "y")
    assert none.trees == [] and boosting.predicted(rows.limit(3), none).where("prediction = 0").count() == 3
    same = spark.createDataFrame([(1.0, None, float("nan"), float(i % 2)) for i in range(20)], "a double, b double, c double, y double")
    model = boosting.fit(same, FEATURES, "y", trees=2)
    assert [round(r.prediction, 9) for r in boosting.predicted(same, model).select("prediction").distinct().collect()] == [0.5]


def test_rows_of_equal_bins_are_one(rows, monkeypatch):
    """Copies of rows add nothing to what is read at each level of a tree, and predictions looked up are those of the trees."""
    read = []
    monkeypatch.setattr(boosting, "grouped", lambda *a, own=boosting.grouped: read.append(own(*a)) or read[-1])
    copies = rows.crossJoin(rows.sparkSession.range(5)).drop("id")
    once, more = (boosting.fit(r, FEATURES, "y", trees=3, bins=6, least=least, ridge=ridge) for r, least, ridge in ((rows, 5, 1.0), (copies, 25, 5.0)))
    counts = [r.count() for r in read]
    assert counts[0] == counts[1] < 7 * 8 * 8 and [r.agg(F.sum("_n")).first()[0] for r in read] == [800, 4000]
    bins = np.stack(np.unravel_index(np.arange(np.prod([len(e) + 2 for e in once.edges])), [len(e) + 2 for e in once.edges]), axis=1)
    assert np.allclose(once.predict(bins), more.predict(bins), atol=1e-9) and (once.predictor()(bins) == once.predict(bins)).all()
    monkeypatch.setattr(boosting, "LOOKED_UP", 0)
    assert (once.predictor()(bins) == once.predict(bins)).all()
