"""Vetoes and held clusters against plain passes over planted conflicts."""

import numpy as np
import pytest

from lotwise.operators import clusters

ENTRIES = [(1, "Baer", "618"), (2, "Baer", "618Bd"), (3, "Baer", "619"), (4, "Bloch", "1"), (5, "Baer", "618"), (5, "Bloch", "2"), (6, "Baer", None), (7, None, "3"), (8, "Baer", "Bd")]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "node long, prefix string, number string")


@pytest.mark.parametrize(("a", "b", "want"), [(1, 5, "agree"), (1, 2, "silent"), (1, 3, "conflict"), (2, 3, "conflict"), (1, 4, "silent"), (4, 5, "conflict"), (1, 6, "silent"), (1, 7, "silent"), (6, 99, "silent"), (2, 8, "conflict"), (3, 5, "conflict")])
def test_pairs_by_digits(spark, a, b, want):
    assert clusters.pair_verdicts(spark.createDataFrame([(a, b, 1)], "a long, b long, verdictless int"), entries(spark)).first().verdict == want


def test_clusters_by_whole_numbers(spark):
    members = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 5), ("z", 4), ("z", 6)], "cluster string, node long")
    assert [(r.cluster, r.prefix, r.numbers) for r in clusters.entry_conflicts(members, entries(spark)).collect()] == [("x", "Baer", ["618", "618Bd"])]
    held = spark.createDataFrame([(1, "Tate", "P1 ", True), (2, "Tate", "P1", True), (5, "Tate", "P2", True), (4, "House", "a", False), (6, "House", "b", False), (6, "Met", None, True)], "node long, institution string, accession string, institutional boolean")
    assert [(r.cluster, r.institution, r.accessions) for r in clusters.holding_conflicts(members, held).collect()] == [("y", "Tate", ["P1", "P2"])]


def plain(pairs, rejected, years, spread):
    no = {tuple(sorted(p)) for p in rejected if None not in p}
    kept = [(min(a, b), max(a, b), c) for a, b, c in pairs if a is not None and b is not None and a != b and (min(a, b), max(a, b)) not in no]
    label = {n: n for a, b, _ in kept for n in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b, _ in kept:
            low = min(label[a], label[b])
            changed = changed or label[a] != low or label[b] != low
            label[a] = label[b] = low
    out = set()
    for n, c in label.items():
        own = [m for m in label if label[m] == c]
        broken = sum(label.get(a) == c and label.get(b) == c for a, b in no)
        dates = [y for m, y in years if m in own and y]
        reason = f"{broken} rejected within" if broken else f"years {min(dates)} to {max(dates)}" if dates and max(dates) - min(dates) > spread else None
        out.add((n, c, len(own), min(s for a, _, s in kept if label[a] == c), reason))
    return out


def test_held_clusters_by_a_plain_pass(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 60, 70), rng.integers(0, 60, 70), rng.random(70), strict=True)] + [(100, 101, 0.5), (101, 100, 0.4), (101, 102, 0.9), (200, 201, 0.7), (None, 3, 0.1), (300, 301, 0.2)]
    rejected = [(100, 102), (int(pairs[0][0]), int(pairs[0][1])), (201, 400), (301, 300), (None, 1)]
    years = [(n, 1900 + n % 13) for n in range(0, 60, 2)] + [(200, 1900), (201, 1950), (100, 0)]
    got = clusters.held(spark.createDataFrame(pairs, "a long, b long, confidence double"), spark.createDataFrame(rejected, "a long, b long"), spark.createDataFrame(years, "node long, year int"), 10)
    want = plain(pairs, rejected, years, 10)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {r[4] for r in want if r[0] in (100, 200)} == {"1 rejected within", "years 1900 to 1950"} and not any(r[0] == 300 for r in want)


def test_keys_with_nulls_and_many_members(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", None), (4, "b", 2), (5, None, 2)], "id long, t string, y int")
    got = clusters.generated(rows, "id", {"t": [F.col("t")], "ty": [F.col("t"), F.col("y")]}, most=2)
    assert sorted(map(tuple, got.collect())) == [("ty", "a|1", 1, 2), ("ty", "a|1", 2, 2)]
