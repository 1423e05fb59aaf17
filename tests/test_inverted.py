"""The inverted-file index against plain products of matrices."""

import numpy as np
import pytest

from lotwise.operators import inverted
from lotwise.operators.inverted import InvertedFile, fused, recall


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, e array<float>, rank int, key string")


def plain(rows, asked, k):
    kept = {i: np.array(e, np.float32).astype(float) for i, e, *_ in rows if i is not None and e is not None and len(e) == 6 and None not in e and np.isfinite(np.array(e, float)).all() and any(e)}
    kept = {i: v / np.linalg.norm(v) for i, v in kept.items()}
    out = set()
    for q in asked:
        if q in kept:
            best = sorted((-round(float(kept[q] @ v), 9), i) for i, v in kept.items() if i != q)[:k]
            out |= {(q, i, rank) for rank, (_, i) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(9, 6))
    near = [(i, [float(x) for x in middles[i % 9] + rng.normal(size=6) * 0.2]) for i in range(300)]
    same = [(300 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.5]) for i in range(60)]  # a hot ring of equal vectors
    odd = [(400, None), (401, [0.0] * 6), (402, [1.0] * 5), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    return [(*r, 1, "x") for r in near + same + odd]


def test_exact_search_by_brute_force(spark, rows):
    data = table(spark, rows)
    index = InvertedFile.fit(data, "id", "e", 6, lists=12, cell=20)
    assert index.sizes[:, 2].max() >= 3 and index.cells.count() == 360
    asked = [i for i in range(0, 410, 20)] + [300, 301]
    for k, probes in ((5, 2), (7, 1)):
        got = {(r.query, r.key, r["rank"]) for r in index.search(data.where(data.id.isin(asked)), "id", "e", k, probes).collect()}
        assert got == plain(rows, asked, k)
    few = index.search(data.where("id = 20"), "id", "e", 1000, 1)  # more than there are
    assert few.count() == 359


def test_many_queries_of_one_cell_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(inverted, "BATCH", 16)
    data = table(spark, rows)
    got = InvertedFile.fit(data, "id", "e", 6, lists=4).search(data, "id", "e", 3, 2)
    assert {(r.query, r.key, r["rank"]) for r in got.collect()} == plain(rows, [r[0] for r in rows if r[0] is not None], 3)


def test_fast_search_recalls_most(spark):
    halves = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = InvertedFile.fit(halves, "vec_id", "embedding", 64)
    asked = halves.where("vec_id % 20 = 0")
    exact = index.search(asked, "vec_id", "embedding", 10)
    probes = index.probes_for(asked, "vec_id", "embedding", 10, 0.95)
    fast = index.search(asked, "vec_id", "embedding", 10, probes, exact=False)
    assert probes < len(index.centroids) and recall(exact, exact).first().recall == 1 and 0.9 <= recall(fast, exact).first().recall < 1


def test_empty_tables(spark, rows):
    data = table(spark, rows)
    none = InvertedFile.fit(data.limit(0), "id", "e", 6)
    assert none.search(data, "id", "e", 3).count() == 0
    assert InvertedFile.fit(data, "id", "e", 6).search(data.limit(0), "id", "e", 3).count() == 0


def test_fused_rankings(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query long, key long, s double, rank int")
    b = spark.createDataFrame([(1, 11, 0.4, 1), (1, 12, 0.95, 2), (1, 9, 0.9, 3)], "query long, key long, s double, rank int")
    assert [(r.key, r["rank"]) for r in fused(a, b, 3).orderBy("rank").collect()] == [(11, 1), (12, 2), (9, 3)]


def test_queries_are_sent_to_units_not_rings(spark):
    """Vectors without order ask nearly all rings; what is handed out grows with units of thousands of vectors."""
    rng = np.random.default_rng(5)
    data = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id long, e array<double>")
    index = InvertedFile.fit(data, "id", "e", 8)
    asked = inverted.whole(data.where("id % 20 = 0"), "id", "e", 8).selectExpr("key AS query", "v", "4.0D AS most", "-2.0D AS least")
    assert len(index.sizes) > 30 and index._asked(asked, 2, True).count() == 30 and index.cells.select("unit").distinct().count() == 1
