"""Boosting on rows of equal features as one, against the library's on all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import learn


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(5)
    rows = [(bool(a), float(b), float(c), int(y), float(a + 0.3 * b - 0.2 * c * a + rng.normal())) for a, b, c, y in zip(rng.integers(0, 2, 3000), rng.integers(0, 6, 3000), rng.integers(0, 4, 3000), rng.integers(0, 7, 3000), strict=True)]
    df = spark.createDataFrame(rows, "signed boolean, size double, share double, year int, y double").persist()
    features, want, fitted = ["signed", "size", "share"], {}, []
    for out in ("", *features):
        both = VectorAssembler(inputCols=[f for f in features if f != out], outputCol="x").transform(df)
        e = F.abs(F.col("prediction") - F.col("y"))
        found = GBTRegressor(featuresCol="x", labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(both.where("year < 5")).transform(both.where("year >= 5"))
        want[out] = found.agg(F.avg(e), F.avg((e <= math.log(2)).cast("double"))).first()
    own = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: fitted.append(rows.count()) or own(self, rows))
    got = {r.left_out: (r.mae, r.within_double) for r in learn.boosted(df, features, "y", F.col("year") < 5, 3).collect()}
    assert len(fitted) == 4 and max(fitted) <= 2 * 6 * 4
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(want[k]), abs=1e-3) for k in want)
    assert got[""][0] == pytest.approx(want[""][0], abs=1e-6)


def test_no_rows_left_to_predict(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 2), float(i)) for i in range(20)], "a double, b double, y double")
    assert [(r.mae, r.within_double) for r in learn.boosted(df, ["a", "b"], "y", F.col("y") >= 0, 2).collect()] == [(None, None)] * 3
