"""Linkage against a plain pass over all pairs, and chances learnt from planted matches."""

import math

import numpy as np
import pytest

from lotwise.operators import linkage
from lotwise.operators.linkage import Chances, Comparison

COMPARED = [Comparison("name", by_frequency=True), Comparison("town"), Comparison("year", near=1)]
RULES = [["name"], ["town", "year"]]
CHANCES = Chances(0.01, {"name": [0.1, 0.9], "town": [0.2, 0.8], "year": [0.1, 0.3, 0.6]}, {"name": [0.9, 0.1], "town": [0.8, 0.2], "year": [0.7, 0.2, 0.1]})


def people(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, town string, year int, a string, _n int")


def plain(rows, least):
    named = [r[1] for r in rows if r[1] is not None]
    out = {}
    for x in rows:
        for y in rows:
            if x[0] >= y[0]:
                continue
            same = [x[k] is not None and x[k] == y[k] for k in (1, 2, 3)]
            rule = 1 if same[0] else 2 if same[1] and same[2] else None
            if rule is None:
                continue
            weight = 0.0
            for k, c in enumerate(("name", "town", "year"), 1):
                if x[k] is None or y[k] is None:
                    continue
                level = (2 if x[k] == y[k] else 1 if abs(x[k] - y[k]) <= 1 else 0) if c == "year" else int(x[k] == y[k])
                u = named.count(x[k]) / len(named) if c == "name" and level == 1 else CHANCES.u[c][level]
                weight += math.log2(CHANCES.m[c][level] / u)
            chance = 1 / (1 + 2**-weight * 0.99 / 0.01)
            if chance >= least:
                out[x[0], y[0]] = (rule, round(weight, 6), round(chance, 6))
    return out


@pytest.mark.parametrize("cell", [1024, 4])
def test_links_by_a_plain_pass(spark, monkeypatch, cell):
    monkeypatch.setattr(linkage, "CELL", cell)
    rng = np.random.default_rng(1)
    rows = [(i, [None, "ann", "bob", "cy", "dee", "eve"][rng.integers(6)], [None, "york", "bath", "hull"][rng.integers(4)], [None, 1900, 1901, 1903][rng.integers(4)], "x", 3) for i in range(70)]
    got = {(r.a, r.b): (r.rule, round(r.weight, 6), round(r.probability, 6)) for r in linkage.links(people(spark, rows), "id", COMPARED, RULES, CHANCES, 0.0).collect()}
    assert got == plain(rows, 0.0)
    some = linkage.links(people(spark, rows), "id", COMPARED, RULES, CHANCES, 0.05)
    assert {(r.a, r.b) for r in some.collect()} == set(plain(rows, 0.05)) and some.count() == len(plain(rows, 0.05))


def test_no_records_and_single_ones(spark):
    one = people(spark, [(1, "a", "b", 1, "x", 1)])
    for df in (one, one.limit(0)):
        assert linkage.links(df, "id", COMPARED, RULES, CHANCES, 0.0).count() == 0
        assert set(linkage.fit(df, "id", COMPARED, RULES, rounds=3).m) == {"name", "town", "year"}


def test_chances_of_planted_matches(spark):
    """2,000 records of 1,000 people: of each second record name, town and year agree with known chances."""
    rng = np.random.default_rng(4)
    names, towns = [f"n{i}" for i in range(300)], [f"t{i}" for i in range(20)]
    rows = []
    for i in range(1000):
        name, town, year = names[rng.integers(300)], towns[rng.integers(20)], int(rng.integers(1800, 1900))
        rows.append((2 * i, name, town, year, "x", 1))
        name = name if rng.random() < 0.9 else names[rng.integers(300)]
        town = town if rng.random() < 0.8 else towns[rng.integers(20)]
        year = year + int(rng.choice([0, 1, 17], p=[0.7, 0.2, 0.1]))
        rows.append((2 * i + 1, name, town, year, "x", 1))
    records = people(spark, rows).persist()
    found = linkage.fit(records, "id", COMPARED, [["name"], ["town"], ["year"]])
    assert found.m["name"][1] == pytest.approx(0.9, abs=0.05) and found.m["town"][1] == pytest.approx(0.81, abs=0.05)
    assert np.allclose(found.m["year"], [0.1, 0.2, 0.7], atol=0.05)
    assert found.u["name"][1] == pytest.approx(1 / 300, rel=0.3) and found.u["town"][1] == pytest.approx(1 / 20, rel=0.15)
    assert found.match == pytest.approx(1000 / (2000 * 1999 / 2), rel=0.1)
    sure = {(r.a, r.b) for r in linkage.links(records, "id", COMPARED, [["name"], ["town"], ["year"]], found, 0.9).collect()}
    true = {(a, b) for a, b in sure if a // 2 == b // 2}
    assert len(true) / len(sure) > 0.9 and len(true) > 600
