"""Status by key as a stream: state with timers, a sink that upserts by key, and late rows counted."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lotwise.streaming.events import timed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "user_id long, event_type string, event_id long, at timestamp, n long, quiet boolean"
#: Groups of users that Python is called for; a call costs some milliseconds, whether for one user or for thousands.
BUCKETS = 1_024
#: What is kept of a bucket's users.
KEPT = pa.schema({"known": pa.bool_(), "user_id": pa.int64(), "us": pa.int64(), "event_id": pa.int64(), "event_type": pa.string(), "n": pa.int64(), "quiet": pa.bool_()})


def _packed(users: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, KEPT) as w:
        w.write_table(users)
    return out.getvalue().to_pybytes()


def last_status(quiet: timedelta) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Users' latest events by time, then id, with the numbers of events, for a bucket of users; a row more of a user once the watermark is ``quiet`` past it.

    Which event is the latest doesn't depend on the order in which they come.  A bucket's timer is that of its next user.
    """
    wait = int(quiet.total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, mark = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else KEPT.empty_table(), state.getCurrentWatermarkMs()
        old = users.num_rows
        if not state.hasTimedOut:
            new = [pa.Table.from_pandas(f.assign(n=1, quiet=False)[KEPT.names], KEPT, preserve_index=False).replace_schema_metadata() for f in frames]
            users = pa.concat_tables([users, *new])
        known, ids, us, event_ids, n, silent = (users.column(c).to_numpy() for c in ("known", "user_id", "us", "event_id", "n", "quiet"))
        order = np.lexsort((event_ids, us, ids, known))
        known, ids, fresh = known[order], ids[order], order >= old
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])])
        latest = order[np.r_[first[1:], len(order)] - 1]
        n, silent, fresh = np.add.reduceat(n[order], first), np.logical_and.reduceat(silent[order], first), np.logical_or.reduceat(fresh, first)
        over = ~silent & (us[latest] // 1000 + wait <= mark)
        silent |= over
        users = users.take(pa.array(latest)).set_column(5, "n", pa.array(n)).set_column(6, "quiet", pa.array(silent))
        state.update((_packed(users),))
        if not silent.all():
            state.setTimeoutTimestamp(max(mark, int((us[latest] // 1000)[~silent].min()) + wait - 1))  # what lies before the watermark has passed, not what equals it
        told = fresh | over
        if told.any():
            user = pd.arrays.IntegerArray(ids[first][told], ~known[first][told])
            kinds, at = users.column("event_type").filter(pa.array(told)).to_pylist(), us[latest][told]
            yield pd.DataFrame({"user_id": user, "event_type": kinds, "event_id": event_ids[latest][told], "at": pd.to_datetime(at, unit="us"), "n": n[told], "quiet": silent[told]})

    return update


def statuses(events: DataFrame, late: str, quiet: timedelta, buckets: int = BUCKETS) -> DataFrame:
    """Changes of users' status; rows older than ``late`` before the newest of earlier batches are left out and counted by Spark.

    A null user is a user; rows without a time are left out.  States are kept by bucket of users; a stream keeps the
    number of ``buckets`` that it began with.
    """
    user = {"known": F.col("user_id").isNotNull(), "user_id": F.coalesce("user_id", F.lit(0)).cast("long")}
    rows = events.where("ts IS NOT NULL").withWatermark("ts", late).select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), *(c.alias(k) for k, c in user.items()), "event_id", "event_type", F.unix_micros("ts").alias("us"), "ts")
    return rows.groupBy("bucket").applyInPandasWithState(last_status(quiet), STATUS, "users binary", "update", GroupStateTimeout.EventTimeTimeout)


class KeyedSink:
    """A table of one row a key in buckets by key; a batch rewrites the buckets that it changes, and a manifest names each bucket's newest.

    A batch that is run again writes the same folder again, so a failed or repeated batch changes nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, below: int | None = None) -> dict[str, int]:
        """The batch that wrote each bucket last, of batches before ``below``."""
        top = self._path(f"{self.path}/manifests")
        made = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(top) if s.getPath().getName().isdigit()) if self._fs.exists(top) else []
        made = [b for b in made if below is None or b < below]
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{made[-1]}").first()[0]) if made else {}

    def _rows(self, manifest: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={b}/_b={k}" for k, b in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._manifest())

    def write(self, batch: DataFrame, number: int) -> None:
        """Upsert a batch that has a key once or more: of equal keys that with more rows seen, then the quiet one, is kept."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*batch.columns), F.struct("n", "quiet")).alias("r")).select("r.*").withColumn("_b", bucket).persist()
        try:
            changed = sorted(r[0] for r in newest.select("_b").distinct().collect())
            if not changed:
                return
            held = self._manifest(number)
            stored = self._rows({k: b for k, b in held.items() if int(k) in changed}).withColumn("_b", bucket)
            same = [stored[k].eqNullSafe(newest[k]) for k in self.keys]
            on = same[0]
            for c in same[1:]:
                on = on & c
            kept = stored.join(newest, on, "left_anti")
            kept.unionByName(newest).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/data/batch={number}")
            out = self._fs.create(self._path(f"{self.path}/manifests/{number}"), True)
            out.writeBytes(json.dumps(held | {str(k): number for k in changed}) + "\n")
            out.close()
        finally:
            newest.unpersist()


def drain(spark: SparkSession, feed: str, checkpoint: str, sink: KeyedSink, late: str = "1 day", quiet: timedelta = timedelta(days=30)) -> list[tuple[int, int]]:
    """Take in all files that have arrived at ``feed`` since the last call; (rows, late rows) of each batch that had any."""
    conf, name = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STORE)  # so that states needn't fit memory; the stream takes the setting over when it starts
    try:
        files = timed(spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed))
        changes = statuses(files, late, quiet)
        run = changes.writeStream.outputMode("update").foreachBatch(sink.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)
    run.awaitTermination()
    return [(p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)) for p in run.recentProgress if p.numInputRows]
