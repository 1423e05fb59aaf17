"""Pairs of records that columns tell apart are made where they are compared and kept nowhere."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import QUERIES, SF, SQL

COPIES = 6


@pytest.fixture(scope="module")
def priced_apart(spark, tmp_path_factory):
    """The small fixture's works ``COPIES`` over, of which no two have one price."""
    folder = tmp_path_factory.mktemp("apart")
    rows = spark.read.parquet(f"{SF}/part.parquet").crossJoin(spark.range(COPIES).select(F.col("id").alias("_i")))
    rows.withColumns({"p_partkey": F.col("p_partkey") + F.col("_i") * 20_000, "p_retailprice": F.col("p_retailprice") + F.col("_i") * 0.01}).drop("_i").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def kept_rows(spark, monkeypatch) -> list[int]:
    """Gets the number of rows of each table that is kept from now on."""
    kind, kept = type(spark.range(1)), []
    own = kind.checkpoint

    def counted(self, *more, **named):
        found = own(self, *more, **named)
        kept.append(found.count())
        return found

    monkeypatch.setattr(kind, "checkpoint", counted)
    return kept


def rows_of(df, decimals=5):
    return sorted(str([round(v, decimals) if isinstance(v, float) else v for v in r]) for r in df)


@pytest.mark.parametrize("name", ["held_clusters", "linkage_weights", "pair_verdicts"])
def test_no_table_of_pairs_is_kept(spark, priced_apart, monkeypatch, name):
    kept = kept_rows(spark, monkeypatch)
    found = QUERIES[name](spark, priced_apart)
    rows = found.collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{priced_apart}/part.parquet/*.parquet'")
    works, pairs = db.execute("SELECT count(*) FROM part").fetchone()[0], db.execute(f"SELECT count(*) FROM ({SQL['pair_verdicts']})").fetchone()[0]
    assert kept and max(kept) <= 2 * works < pairs
    assert rows_of(rows) == rows_of(db.execute(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall())


@pytest.mark.parametrize("known", [False, True])
def test_links_of_chunks_in_small_cells(spark, monkeypatch, known):
    """Classes of more members than a chunk, blocks of more than a cell, few pairs at once."""
    from test_clusters import plain as held_plain
    from test_linkage import CHANCES, COMPARED, RULES, plain

    from lotwise.operators import clusters, joins, linkage

    for name, value in {"CELL": 4, "STOOD": 6, "STRIP": 5}.items():
        monkeypatch.setattr(linkage, name, value)
    monkeypatch.setattr(joins, "CHUNK", 3)
    rows = [(i, [None, "ann", "bob"][i % 3], ["york", None, "bath", "hull"][i % 4 * (i % 7 > 4)], 1900 + i % 11 // 4, "x", 3) for i in range(60)]
    numbers = {i: sorted({("Baer", f"{i % 5}{'Bd' if i % 4 == 0 else ''}"), ("Bloch", str(i % 2))}) if i % 6 else [] for i in range(60)}
    records = spark.createDataFrame([(*r, [{"prefix": p, "number": n} for p, n in numbers[r[0]]]) for r in rows], "id long, name string, town string, year int, a string, _n int, known array<struct<prefix string, number string>>")
    want = plain(rows, 0.05)
    found = linkage.links(records, "id", COMPARED, RULES, CHANCES, 0.05, *(["known", clusters.verdict_table] if known else [])).collect()
    assert want and len(found) == len(want) and {(r.a, r.b): (r.rule, round(r.weight, 6), round(r.probability, 6)) for r in found} == want
    head = lambda n: n.rstrip("Bd")

    def verdict(a, b):
        x, y = (dict(numbers[n]) for n in (a, b))
        shared = x.keys() & y.keys()
        return 1 if any(x[p] == y[p] for p in shared) else 0 if not shared or any(head(x[p]) == head(y[p]) for p in shared) else 2

    if known:
        assert {(r.a, r.b): r.told for r in found} == {p: verdict(*p) for p in want} and {r.told for r in found} == {0, 1, 2}
        node, sure, broken = linkage.chained(records, "id", COMPARED, RULES, CHANCES, 0.05, "known", clusters.verdict_table, 2)
        years = spark.createDataFrame([(i, 1900 + i) for i in range(0, 60, 7)], "node long, year int")
        got = clusters.clusters_of(node, sure, broken, years, 30).collect()
        plainly = held_plain([(*p, w[2]) for p, w in want.items() if verdict(*p) != 2], [p for p in want if verdict(*p) == 2], [(i, 1900 + i) for i in range(0, 60, 7)], 30)
        assert len(got) == len(plainly) and {(r.node, r.cluster, r["size"], round(r.confidence, 6), r.reason) for r in got} == {(*r[:3], round(r[3], 6), r[4]) for r in plainly}


@pytest.mark.parametrize("beside", [4_096, 2])
def test_works_within_tolerances_are_kept_in_no_table_of_pairs(spark, priced_apart, monkeypatch, beside):
    from lotwise.plans import market

    monkeypatch.setattr(market, "BESIDE", beside)
    kept = kept_rows(spark, monkeypatch)
    rows = QUERIES["tolerance_join"](spark, priced_apart).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{priced_apart}/part.parquet/*.parquet'")
    assert kept and max(kept) <= db.execute("SELECT count(*) FROM part").fetchone()[0]
    assert rows and sorted(map(tuple, rows)) == sorted(db.execute(SQL["tolerance_join"]).fetchall())
