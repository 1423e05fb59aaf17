"""Event feeds: windows, sessions, duplicates, state and incremental loads.

Every transformation takes a streaming or a batch DataFrame of (event_id, ts, user_id, event_type, value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def feed(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive at ``path``, so many a batch."""
    schema = spark.read.parquet(path).schema
    return timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Count and sum by window and type; late rows count up to a day."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's runs of events that are less than ``gap`` apart."""
    s = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame) -> DataFrame:
    """Each event id once, within the time that late rows are waited for."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Events with columns of a static table."""
    return events.join(static, key, "left")


def last_status(events: DataFrame) -> DataFrame:
    """A user's latest event type by time, then id, and number of events, updated with every batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, event_id, kind, n = state.get if state.exists else (None, None, None, 0)
        for f in frames:
            n += len(f)
            row = f.sort_values(["ts", "event_id"]).iloc[-1]
            if at is None or (row.ts, row.event_id) > (pd.Timestamp(at), event_id):
                at, event_id, kind = row.ts.isoformat(), int(row.event_id), row.event_type
        state.update((at, event_id, kind, n))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_type string, n long", "at string, event_id long, kind string, n long", "update", GroupStateTimeout.NoTimeout)


def incremental(stream: DataFrame, checkpoint: str, load: Callable[[DataFrame, int], None]) -> None:
    """Feed what has arrived since the last call to ``load`` and return; ``checkpoint`` remembers how far it came."""
    stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
