"""Cutting lineage so that a lost executor costs no earlier work."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of this machine's is set only where there is none and all runs on this machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    own = "file://" + tempfile.mkdtemp(prefix="lotwise-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the checkpoint folder."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
