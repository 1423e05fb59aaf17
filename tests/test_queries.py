"""Every query with SQL gives DuckDB's rows on the small fixture; the others keep what they promise."""

import duckdb
import pandas as pd
import pytest

from lotwise.plans import registries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: f for r in registries() for n, f in r.queries.items()}
SQL = {n: q for r in registries() for n, q in r.sql.items()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(v) if isinstance(v, str | bool) or hasattr(v, "isoformat") else f"{float(v):.3f}" if hasattr(v, "__float__") else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not off, off[:3]


def test_index_is_that_of_dummy_regression(spark):
    import numpy as np

    from lotwise.plans.pricing import logs

    lots = logs(spark, SF).selectExpr("work", "year(sale_date) AS year", "y").toPandas()
    works, years = sorted(lots.work.unique()), sorted(lots.year.unique())
    x = np.zeros((len(lots), len(works) + len(years) - 1))
    x[np.arange(len(lots)), lots.work.map({w: i for i, w in enumerate(works)})] = 1
    for i, y in enumerate(years[1:]):
        x[:, len(works) + i] = lots.year == y
    want = np.linalg.lstsq(x, lots.y.to_numpy(), rcond=None)[0][len(works) :]
    got = QUERIES["repeat_sales_index"](spark, SF).toPandas().sort_values("year")
    assert got.effect.iloc[0] == 0
    assert np.allclose(got.effect.iloc[1:], want, atol=1e-5)


def test_components_of_likeness_are_closed(spark):
    from itertools import combinations

    from lotwise.plans.identity import NEAR, embedded

    label = {r.node: r.component for r in QUERIES["likeness_components"](spark, SF).collect()}
    rows = sorted((r.vec_id, r.label, r.e) for r in embedded(spark, SF).collect())
    pairs = [(a, b) for (a, g, x), (b, h, y) in combinations(rows, 2) if g == h and sum(map(float.__mul__, x, y)) >= NEAR + 1e-9]
    assert pairs and all(label[a] == label[b] <= a for a, b in pairs)


def test_blend_lies_within_its_range(spark):
    got = QUERIES["blended_prices"](spark, SF).toPandas()
    assert ((got.p10 < got["median"]) & (got["median"] < got.p90)).all()


def test_typo_variants_are_close(spark):
    assert QUERIES["typo_variants"](spark, SF).where("edits > 3 or a >= b").count() == 0


def test_artists_of_all_lots_by_brute_force(spark):
    lots = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").toPandas()
    part = spark.read.parquet(f"{SF}/part.parquet").toPandas()
    label = {a: a for a in lots.l_suppkey}
    groups = [set(g) for _, g in lots.groupby("l_partkey").l_suppkey]
    changed = True
    while changed:
        changed = False
        for g in groups:
            low = min(label[a] for a in g)
            changed = changed or any(label[a] != low for a in g)
            label.update(dict.fromkeys(g, low))
    joined = {a for g in groups if len(g) > 1 for a in g}
    assert {r.node: r.component for r in QUERIES["artist_components"](spark, SF).collect()} == {a: label[a] for a in joined}
    kind = dict(zip(part.p_partkey, part.p_brand + part.p_type + (part.p_size // 10).astype(str), strict=True))
    has = {a: {kind[w] for w in g if w in kind} for a, g in lots.groupby("l_suppkey").l_partkey}
    has = {a: k for a, k in has.items() if len(k) >= 5}
    want = []
    for a in has:
        near = sorted((-len(has[a] & has[b]) / len(has[a] | has[b]), b) for b in has if b != a and has[a] & has[b])[:5]
        want += [(a, b, i, round(-s, 5)) for i, (s, b) in enumerate(near, 1)]
    assert want and sorted((r.a, r.b, r["rank"], round(r.similarity, 5)) for r in QUERIES["similar_artists"](spark, SF).collect()) == sorted(want)


def test_large_blocks_of_documents_stay(spark, tmp_path):
    rows = [(i, f"one two three {i}") for i in range(40)] + [(i, f"four five six {i}") for i in range(40, 43)] + [(50, "alone with none"), (51, None), (52, "too short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["document_blocks"](spark, str(tmp_path)).collect()))
    assert got == [(i, 0, 40, 780) for i in range(40)] + [(i, 40, 3, 3) for i in range(40, 43)]
