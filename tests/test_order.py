"""Ranks, tiles and quantiles by ranges against windows and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.operators import ranges

ROWS = [(g, v, i) for i, (g, v) in enumerate([("a", x) for x in (3, 1, 2, 2, 2, 9, 1)] + [("b", x) for x in (5, 5)] + [(None, x) for x in (4, 1)] + [("c", None), ("d", 7), ("d", None)] + [("e", i * 7 % 50) for i in range(120)])]


@pytest.fixture
def rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(ROWS, "g string, v int, id int")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_over_several_ranges(rows):
    got = {r.id: (r.before, r.whole) for r in ranges.summed_before(rows, ["g"], ["v", "id"]).collect()}
    want = {}
    for g in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (k, len(own)) for k, r in enumerate(own)}
    assert got == want


def test_average_ranks_are_pandas_ranks(rows):
    got = {r.id: r.rank for r in ranges.average_ranks(rows.where("g IS NOT NULL"), ["g"], "v", "rank").select("id", "rank").collect()}
    frame = pd.DataFrame(ROWS, columns=["g", "v", "id"]).dropna()
    assert got == dict(zip(frame.id, frame.groupby("g").v.rank(), strict=True))


@pytest.mark.parametrize("n", [1, 4, 50])
def test_tiles_are_those_of_a_window(rows, n):
    from pyspark.sql import Window

    want = rows.withColumn("t", F.ntile(n).over(Window.partitionBy("g").orderBy("v", "id")))
    assert {r.id: r.t for r in ranges.tiles(rows, ["g"], ["v", "id"], n, "t").collect()} == {r.id: r.t for r in want.collect()}


def test_quantiles_are_numpys(rows):
    shares = [0.0, 0.3, 0.5, 1.0]
    got = {r.g: (r.n, [r.q0, r.q1, r.q2, r.q3]) for r in ranges.quantiles(rows, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "d", "e"}
    for g, (n, values) in got.items():
        own = [r[1] for r in ROWS if r[0] == g and r[1] is not None]
        assert n == len(own) and np.allclose(values, np.quantile(own, shares))
    assert ranges.quantiles(rows.limit(0), ["g"], "v", shares).count() == 0
