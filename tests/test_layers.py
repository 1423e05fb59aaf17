"""Paging, chunks, snapshots, guards, one-edit joins and learning helpers on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import parse, strings
from lotwise.operators import changes, graph, joins, layers, learn, paging


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


def test_pages_cover_the_table_once(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a int, b int")
    seen, after = [], None
    while rows := paging.page(df, ["a", "b"], 8, after).collect():
        seen += [tuple(r) for r in rows]
        after = seen[-1]
    assert seen == sorted((i % 7, i) for i in range(50))
    assert paging.page(df.limit(0), ["a", "b"], 8).count() == 0


def test_chunks_are_tried_again(spark):
    df = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "k long")
    got, failures = [], {1: 2, 2: 9}

    def write(part, k):
        if failures.get(k, 0):
            failures[k] -= 1
            raise OSError("later")
        got.extend(r.k for r in part.collect())

    assert paging.in_chunks(df, "k", 4, write) == [2]
    failures.clear()
    before = len(got)
    assert paging.in_chunks(df, "k", 4, write) == [] and len(got) == before + 41


def test_a_change_that_breaks_a_rule_is_not_in_force(spark, tmp_path):
    table = layers.Snapshots(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([(1, 10.0), (2, None)], "k long, v double"))
    rules = {"negative": F.col("v") < 0}
    assert table.apply(lambda df: df.withColumn("v", F.col("v") - 20), rules) == {"negative": 1}
    assert table.read().agg(F.sum("v")).first()[0] == 10
    assert table.apply(lambda df: df.withColumn("v", F.col("v") * 2), rules) == {}
    assert table.read().agg(F.sum("v")).first()[0] == 20
    table.roll_back()
    assert table.read().agg(F.sum("v")).first()[0] == 10
    with pytest.raises(ValueError):
        table.roll_back()
    for times in (3, 5):
        assert table.apply(lambda df, t=times: df.withColumn("v", F.col("v") * t), rules) == {}
    seen = [table.read().agg(F.sum("v")).first()[0]]
    for _ in range(2):
        table.roll_back()
        seen.append(table.read().agg(F.sum("v")).first()[0])
    assert seen == [150, 30, 10]
    with pytest.raises(FileExistsError):
        table.apply(lambda df: table.write(df.limit(0)) and df, rules)


def test_runs_and_guards(spark):
    rows = spark.createDataFrame([(1, "x")], "k long, v string")
    layer = layers.tagged(rows, "r1").unionByName(layers.tagged(rows.withColumn("v", F.lit("y")), "r2"))
    assert [r.v for r in layers.current(layer, ["k"]).collect()] == ["y"]
    assert [r.v for r in layers.current(layers.without_run(layer, "r2"), ["k"]).collect()] == ["x"]
    with pytest.raises(ValueError):
        layers.constrained({"artist": None, "since": 1}, {"artist"})


def test_texts_within_one_edit_by_brute_force(spark):
    words = ["blue ring", "bleu ring", "blu ring", "blue rings", "red ring", "", "b", "a", None, "blue ring"]
    df = spark.createDataFrame([(i % 2, w) for i, w in enumerate(words * 2)], "g int, w string")
    got = {(r.g, r.x, r.y) for r in joins.within_one_edit(df.selectExpr("g", "w AS x").distinct(), "x", df.selectExpr("g", "w AS y").distinct(), "y", ["g"]).collect()}
    own = [(i % 2, w) for i, w in enumerate(words * 2) if w is not None]
    assert got == {(g, x, y) for g, x in own for h, y in own if g == h and strings.typo_distance(x, y) <= 1}


def test_asof_by_stretches_is_asof(spark):
    rng = np.random.default_rng(3)
    left = spark.createDataFrame([(int(k) if k else None, int(t)) for k, t in rng.integers(0, [3, 100], (80, 2))], "k long, t long")
    right = spark.createDataFrame([(k, s, f"{k}/{s}") for k, s in {(int(k), int(s)) for k, s in rng.integers(0, [3, 100], (30, 2))}], "k long, s long, v string")
    seen = lambda df: sorted(map(str, df.collect()))
    for strict in (False, True):
        assert seen(joins.asof(left, right, ["k"], "t", "s", ["v"], strict, every=7)) == seen(joins.asof(left, right, ["k"], "t", "s", ["v"], strict))


def test_steps_as_an_array_and_as_a_window(spark, monkeypatch):
    steps = spark.createDataFrame([(1990, 1.0), (2000, 2.0), (2010, 3.0)], "s int, v double")
    years = spark.createDataFrame([(y,) for y in (1980, 1990, 1999, 2005, 2030)], "y int")
    want = {1980: 1.0, 1990: 1.0, 1999: 1.0, 2005: 2.0, 2030: 3.0}
    assert {r.y: r.v for r in joins.step_lookup(years, steps, "y", "s", "v").collect()} == want
    monkeypatch.setattr(joins, "STEPS", 1)
    assert {r.y: r.v for r in joins.step_lookup(years, steps, "y", "s", "v").collect()} == want


def test_long_chains_and_cycles(spark):
    ids = np.random.default_rng(1).permutation(300).tolist()
    got = graph.least_reachable(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")).collect()
    assert {r.component for r in got} == {0} and len(got) == 300
    assert graph.least_reachable(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(ValueError):
        changes.final_survivor(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "old long, survivor long"), 6)


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.standard_normal((120, 2)), rng.standard_normal((5, 2)) * 30])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "k long, a double, b double")
    got = {}
    for r in learn.nearest(df, "k", {"a": 2.0, "b": 1.0}, 4).collect():
        got.setdefault(r.k, {})[r.rank] = r.donor
    for i in range(len(points)):
        d = np.sqrt(2 * (points[:, 0] - points[i, 0]) ** 2 + (points[:, 1] - points[i, 1]) ** 2)
        want = [j for j in sorted(range(len(points)), key=lambda j: (round(d[j], 9), j)) if j != i][:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == want


def test_running_sums_by_ranges(spark):
    df = spark.createDataFrame([(i * i, i) for i in range(100)], "s long, n long")
    got = {r.s: (r.sum_n, r.all_n) for r in learn.running_sums(df, "s", ["n"], 7).collect()}
    assert got == {i * i: (sum(range(i, 100)), 4950) for i in range(100)}


def test_groups_spread_over_folds(spark):
    counts = spark.createDataFrame([(g, "rare" if g % 10 == 0 else "common", 1 + g % 3) for g in range(60)], "g long, label string, n long")
    got = learn.stratified_groups(counts, "g", "label", "n", 3).join(counts, "g").groupBy("label", "fold").count().collect()
    assert all(r["count"] == (2 if r.label == "rare" else 18) for r in got) and len(got) == 6


@pytest.mark.parametrize(("given", "want"), [("12 3/8", 12.375), ("3/8", 0.375), ("4.5", 4.5), ("1/0", None), ("x", None), (None, None)])
def test_mixed_fractions(spark, given, want):
    assert one(spark, given, parse.mixed_fraction) == want


@pytest.mark.parametrize(("given", "want"), [("XIV", 14), ("MCMXC", 1990), ("", None), ("ABC", None), (None, None)])
def test_roman_numerals(spark, given, want):
    assert one(spark, given, parse.roman) == want


@pytest.mark.parametrize(("given", "want"), [('a {"x": {"y": "}"}} b', '{"x": {"y": "}"}}'), ("{ open", None), ('{"a\\"}": 1}', '{"a\\"}": 1}'), ("none", None), (None, None)])
def test_first_object(spark, given, want):
    assert one(spark, given, parse.first_object) == want


def test_weights_can_not_be_bettered_one_at_a_time(spark):
    from lotwise.plans import valuation

    sf = "/root/testdata/sf0.001"
    got = {r.source: r for r in valuation.witness_weights(spark, sf).collect()}
    truth = valuation.latest(valuation.priced(spark, sf)).select("work", "y").toPandas().set_index("work").y
    wide = valuation.witnesses(spark, sf).toPandas().pivot(index="work", columns="source", values="mu").reindex(columns=valuation.SOURCES)

    def error(weights):
        w = np.where(wide.notna(), weights, 0.0)
        ok = w.sum(1) > 0
        return (np.abs(truth.loc[wide.index] - np.nansum(wide.to_numpy() * w, 1) / np.where(ok, w.sum(1), 1))[ok]).mean(), ok.sum()

    best = np.array([got[s].weight for s in valuation.SOURCES])
    own, priced = error(best)
    assert own == pytest.approx(got["artist"].mae, abs=1e-6)
    for i in range(len(best)):
        for c in (0.0, 0.25, 0.5, 1.0, 2.0):
            other, n = error(np.where(np.arange(len(best)) == i, c, best))
            assert n < priced or other >= own - 1e-8


def test_cells_of_a_group_by_brute_force(spark):
    from lotwise.operators import cells

    rng = np.random.default_rng(7)
    x = rng.standard_normal((70, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3] = x[50]
    df = spark.createDataFrame([(i % 2, i, [float(v) for v in x[i]]) for i in range(70)], "g int, k long, e array<double>")
    s, same = x @ x.T, np.equal.outer(np.arange(70) % 2, np.arange(70) % 2)
    got = {}
    for r in cells.within_groups(df, "g", "k", "e", cells.best_below(3, 0.9), "a long, b long, s double", block=8).collect():
        got.setdefault(r.a, []).append((-round(r.s, 9), r.b))
    for i in range(70):
        want = sorted((-round(s[i, j], 9), j) for j in range(70) if j != i and same[i, j] and s[i, j] < 0.9)[:3]
        assert sorted(got[i])[:3] == want
    links = cells.within_groups(df, "g", "k", "e", cells.links_from(0.6), "a long, b long", block=8)
    label = {r.node: r.component for r in graph.least_reachable(links).collect()}
    want = list(range(70))
    for _ in range(70):
        want = [min([want[i], *(want[j] for j in range(70) if same[i, j] and s[i, j] >= 0.6)]) for i in range(70)]
    assert [label.get(i, i) for i in range(70)] == want
    assert cells.within_groups(df.limit(0), "g", "k", "e", cells.links_from(0.6), "a long, b long").count() == 0
