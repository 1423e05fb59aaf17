"""Pairs within a group reduced in cells, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import cells


@pytest.mark.parametrize(("block", "buckets"), [(None, 4096), (7, 16), (1, 2)])
def test_quantiles_of_pairs_by_all_pairs(spark, monkeypatch, block, buckets):
    monkeypatch.setattr(cells, "BUCKETS", buckets)
    rng = np.random.default_rng(7)
    rows = [(i, "abc"[i % 3], v) for i, v in enumerate(rng.normal(size=(45, 4)))] + [(100 + i, "same", np.array([1.0, 0, 0, 0])) for i in range(9)] + [(200, "few", np.ones(4)), (201, "few", -np.ones(4)), (300, "one", np.ones(4))]
    rows = [(i, g, [float(x) for x in v / np.linalg.norm(v)]) for i, g, v in rows]
    got = {r.g: (r.pairs, r["values"]) for r in cells.group_quantiles(spark.createDataFrame(rows, "id long, g string, e array<double>"), "g", "id", "e", [0.0, 0.5, 0.95, 1.0], 30, block).collect()}
    assert set(got) == {"a", "b", "c", "same"}
    for g, (pairs, values) in got.items():
        x = np.array([e for _, h, e in rows if h == g])
        s = (x @ x.T)[np.triu_indices(len(x), 1)]
        assert pairs == len(s) and np.allclose(values, np.quantile(s, [0.0, 0.5, 0.95, 1.0]), atol=1e-11)


def test_quantiles_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, g int, e array<double>")
    assert cells.group_quantiles(none, "g", "id", "e", [0.5], 1).count() == 0


def test_means_of_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 5))
    rows = [(i % 4, [float(v) for v in e]) for i, e in enumerate(x)] + [(1, None), (None, [1.0] * 5), (2, [0.0] * 5)]
    got = {r.g: r for r in cells.class_means(spark.createDataFrame(rows, "g int, e array<double>").repartition(3), "g", "e").collect()}
    for g in range(4):
        unit = np.array([np.array(e) / max(np.linalg.norm(e), 1e-300) for h, e in rows if h == g and e is not None])
        assert got[g].n == len(unit) and np.allclose(got[g].m, unit.mean(axis=0))
    best = cells.nearest_class(spark.createDataFrame(rows, "g int, e array<double>").withColumn("id", F.monotonically_increasing_id()).where("e IS NOT NULL"), "id", "e", [(r.g, r.m) for r in got.values()])
    assert best.count() == 52
