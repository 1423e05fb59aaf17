"""What leaves the engine: CSV with nested columns as JSON, matrices as NPZ, and calibrations as one JSON document."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.sources.zipped import COMMITTED, opened


def write_csv(df: DataFrame, path: str) -> None:
    """One row a line under a header; lists, structs and maps as JSON, quotes doubled, nulls as nothing and empty texts quoted."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`write_csv` wrote of a table of this schema."""
    nested = lambda f: isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)
    flat = T.StructType([T.StructField(f.name, T.StringType() if nested(f) else f.dataType) for f in schema.fields])
    rows = spark.read.schema(flat).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", None).csv(path)
    return rows.select(*(F.from_json(f.name, f.dataType).alias(f.name) if nested(f) else F.col(f.name) for f in schema.fields))


def write_npz(df: DataFrame, vector: str, path: str, rows: int = 100_000) -> int:
    """Files of up to ``rows`` rows, each with ``X`` (32-bit floats) from the lists of ``vector`` and an array for every other column; how many rows.

    Numbers stay numbers, all else is text.  Rows without a vector are left out; vectors are of one length.  Tasks write
    files of their own and the list of those that count is written last, so a task that is run again does no harm.
    """
    names = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(path)
        system.create_dir(inner, recursive=True)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                column = b.column(vector)
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
                arrays = {c: b.column(c).to_numpy(zero_copy_only=False) if pa.types.is_integer(b.column(c).type) or pa.types.is_floating(b.column(c).type) else np.array(["" if v is None else str(v) for v in b.column(c).to_pylist()]) for c in names}
                held, name = io.BytesIO(), f"part-{uuid.uuid4().hex}.npz"
                np.savez(held, X=x, **arrays)
                with system.open_output_stream(f"{inner.rstrip('/')}/{name}") as out:
                    out.write(held.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b.num_rows], pa.int64())], ["name", "rows"])

    files = df.where(F.col(vector).isNotNull()).select(vector, *names).mapInArrow(run, "name string, rows long").collect()  # a row a file
    system, inner = opened(path)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner.rstrip('/')}/{COMMITTED}") as out:
        out.write(json.dumps(sorted(r.name for r in files)).encode())
    return sum(r["rows"] for r in files)


def read_npz(spark: SparkSession, path: str, vector: str, schema: str) -> DataFrame:
    """The columns of ``schema`` (``vector`` among them, an array<double>) of what :func:`write_npz` wrote."""
    system, inner = opened(path)
    names = json.loads(system.open_input_file(f"{inner.rstrip('/')}/{COMMITTED}").read())
    fields = T.StructType.fromDDL(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = opened(path)
        for b in batches:
            for name in b.column("name").to_pylist():
                with np.load(io.BytesIO(files.open_input_file(f"{folder.rstrip('/')}/{name}").read()), allow_pickle=False) as z:
                    x = z["X"].astype(float)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([lists if f.name == vector else pa.array(z[f.name].tolist() if z[f.name].dtype.kind == "U" else z[f.name]) for f in fields], [f.name for f in fields])

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return (files.repartition(max(1, min(len(names), 200))) if names else files).mapInArrow(run, schema)


CALIBRATED = "map<string, map<string, struct<bias: double, sigma: double, n: bigint>>>"


def write_calibration(calibration: DataFrame, path: str, version: str) -> None:
    """One JSON document of (source, key, bias, sigma, n): biases and spreads by source, then by key; few rows."""
    by_key = calibration.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("bias", "sigma", "n")))).alias("keys"))
    whole = by_key.agg(F.map_from_arrays(F.collect_list("source"), F.collect_list("keys")).alias("witnesses"))
    whole.select(F.to_json(F.struct(F.lit(version).alias("version"), "witnesses")).alias("value")).coalesce(1).write.text(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(version, source, key, bias, sigma, n) of a calibration document, however its lines are broken; a damaged one gives no rows."""
    text = spark.read.text(path, wholetext=True)
    read = text.select(F.from_json("value", f"version string, witnesses {CALIBRATED}").alias("c")).select("c.version", F.explode("c.witnesses").alias("source", "keys"))
    return read.select("version", "source", F.explode("keys").alias("key", "v")).select("version", "source", "key", "v.*")
