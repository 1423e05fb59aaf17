"""What is written comes back: CSV with odd texts and nested columns, matrices, calibrations."""

import numpy as np
import pytest

from lotwise.sources import sinks

SCHEMA = "id long, t string, tags array<string>, s struct<a: int, b: string>, m map<string, double>, d date"
ODD = [(1, 'say "hi", you\nthere', ["a;b", 'q"', None], (1, "x,y"), {"k": 1.5}, None), (2, None, None, None, None, None), (3, "", [], (None, None), {}, None), (4, "\\ back \\\" slash", ["\\"], (2, ""), {"": 0.0}, None), (5, " lead and trail ", ["é😀"], (3, "null"), {"n": -1.0}, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ODD, SCHEMA)
    sinks.write_csv(df, str(tmp_path / "c"))
    back = sinks.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.drop("m").collect())) == sorted(map(str, df.drop("m").collect()))
    assert {r.id: r.m for r in back.collect()} == {r.id: r.m for r in df.collect()}
    sinks.write_csv(df.limit(0), str(tmp_path / "none"))
    assert sinks.read_csv(spark, str(tmp_path / "none"), df.schema).count() == 0


@pytest.mark.parametrize("rows", [2, 1000])
def test_matrices(spark, tmp_path, rows):
    data = [(i, f"n{i}" if i % 3 else None, [float(i), 0.5, -1.0]) for i in range(11)] + [(99, "none", None)]
    df = spark.createDataFrame(data, "id long, name string, v array<double>").repartition(3)
    path = str(tmp_path / "z")
    assert sinks.write_npz(df, "v", path, rows) == 11
    (tmp_path / "z" / "part-lost.npz").write_bytes(b"of a task that was run again")
    got = {r.id: (r.name, r.v) for r in sinks.read_npz(spark, path, "v", "id long, name string, v array<double>").collect()}
    assert got == {i: (n or "", v) for i, n, v in data if v is not None}
    first = next(p for p in (tmp_path / "z").glob("part-*.npz") if p.name != "part-lost.npz")
    with np.load(first) as z:
        assert z["X"].dtype == np.float32 and z["X"].shape[1] == 3 and len(z["id"]) == len(z["X"])
    assert sinks.write_npz(df.limit(0), "v", str(tmp_path / "no"), rows) == 0
    assert sinks.read_npz(spark, str(tmp_path / "no"), "v", "id long, v array<double>").count() == 0


def test_calibrations(spark, tmp_path):
    rows = [("same_work", "all", 0.1, 0.5, 9), ("same_work", "3+", -0.1, 0.25, 4), ("artist", "all", 0.0, 1.0, 2)]
    sinks.write_calibration(spark.createDataFrame(rows, "source string, key string, bias double, sigma double, n long"), str(tmp_path / "c"), "v7")
    assert sorted(map(tuple, sinks.read_calibration(spark, str(tmp_path / "c")).collect())) == sorted(("v7", *r) for r in rows)
    (tmp_path / "d.json").write_text('{\n "version": "v8",\n "witnesses": {"artist": {"all": {"bias": 1, "sigma": 2.5, "n": 3}}}\n}\n')
    assert [tuple(r) for r in sinks.read_calibration(spark, str(tmp_path / "d.json")).collect()] == [("v8", "artist", "all", 1.0, 2.5, 3)]
    (tmp_path / "bad.json").write_text('{"version": ')
    assert sinks.read_calibration(spark, str(tmp_path / "bad.json")).count() == 0


def test_rates_of_exchange_over_several_lines(spark, tmp_path):
    from lotwise.sources import tables

    (tmp_path / "fx.json").write_text('{\n "2024-01-02": {"EUR": 0.86, "USD": 0.79},\n "2024-01-05": {"EUR": 0.85}\n}\n')
    assert sorted((str(r.day), r.currency, r.rate) for r in tables.rates(spark, str(tmp_path / "fx.json")).collect()) == [("2024-01-02", "EUR", 0.86), ("2024-01-02", "USD", 0.79), ("2024-01-05", "EUR", 0.85)]
