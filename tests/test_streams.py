"""The stream of statuses: ties, late rows, timers and a sink that can be written again."""

from datetime import datetime, timedelta
from functools import partial

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.plans import stream
from lotwise.streaming import events as feeds
from lotwise.streaming import status

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY = datetime(2024, 3, 1)


def arrive(spark, path, rows):
    spark.createDataFrame([(i, t, u, k, 0.0) for i, t, u, k in rows], EVENT).coalesce(1).write.mode("append").parquet(path)


def days(n):
    return DAY + timedelta(days=n)


@pytest.fixture
def fed(spark, tmp_path):
    sink = status.KeyedSink(spark, str(tmp_path / "table"), ["user_id"], status.STATUS, buckets=3)

    def put(rows):
        arrive(spark, str(tmp_path / "feed"), rows)
        return status.drain(spark, str(tmp_path / "feed"), str(tmp_path / "mark"), sink, late="1 day", quiet=timedelta(days=10))

    return sink, put


def held(sink):
    return {r.user_id: (r.event_type, r.event_id, r.n, r.quiet) for r in sink.read().collect()}


def test_ties_late_rows_and_timers(fed):
    sink, put = fed
    assert put([(5, days(0), 1, "b"), (1, days(0), 2, "a"), (9, days(0), None, "none")]) == [(3, 0)]
    assert held(sink) == {1: ("b", 5, 1, False), 2: ("a", 1, 1, False), None: ("none", 9, 1, False)}
    # an equal time with a smaller id, in a later batch, isn't the latest; one with a larger id is
    assert put([(4, days(0), 1, "c"), (2, days(0), 2, "d"), (3, days(3), 3, "e")]) == [(3, 0)]
    assert held(sink)[1] == ("b", 5, 2, False) and held(sink)[2] == ("d", 2, 2, False)
    # two days before the newest is too late; the day itself isn't
    assert put([(20, days(1), 2, "late"), (21, days(2) + timedelta(hours=1), 2, "f")]) == [(2, 1)]
    assert held(sink)[2] == ("f", 21, 3, False)
    # eleven days on users 1 and None are quiet; user 2 isn't yet, and 3 has a new event
    put([(30, days(12), 3, "g")])
    assert held(sink) == {1: ("b", 5, 2, True), None: ("none", 9, 1, True), 2: ("f", 21, 3, False), 3: ("g", 30, 2, False)}
    put([(31, days(12), 1, "back")])
    assert held(sink)[1] == ("back", 31, 3, False)
    put([])
    assert held(sink)[1] == ("back", 31, 3, False)


def test_users_of_a_bucket_are_told_together(fed, monkeypatch):
    """One call of Python for all users of a bucket, each with its own timer, null users and large ids among them."""
    monkeypatch.setattr(status, "statuses", partial(status.statuses, buckets=1))
    test_ties_late_rows_and_timers(fed)


def test_one_call_tells_many_users():
    class State:
        exists, hasTimedOut, get, timer, mark = False, False, None, None, 0
        getCurrentWatermarkMs = lambda self: self.mark

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            self.timer = at

    state, large = State(), 2**60 + 1
    rows = [(True, large + u % 1_000, u, "ab"[u % 2], u * 1_000_000) for u in range(3_000)] + [(False, 0, 7, "null", 5)]
    tell = status.last_status(timedelta(hours=1))
    frame = pd.DataFrame(rows, columns=["known", "user_id", "event_id", "event_type", "us"])
    (found,) = tell((0,), iter([frame[:1_500], frame[1_500:]]), state)
    assert len(found) == 1_001 and found.user_id.isna().sum() == 1 and not found.quiet.any()
    assert {tuple(r) for r in found.dropna()[["user_id", "event_id", "n"]].itertuples(index=False)} == {(large + u, 2_000 + u, 3) for u in range(1_000)}
    assert state.timer == 3_600_000 - 1
    state.hasTimedOut, state.mark = True, 3_600_000 + 2_000_000  # the null user's hour is over, and that of the first known one
    (found,) = tell((0,), iter(()), state)
    assert sorted(found.event_id) == [7, 2_000] and found.quiet.all()
    assert state.timer == 3_600_000 + 2_001_000 - 1


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    sink = status.KeyedSink(spark, str(tmp_path), ["user_id"], status.STATUS, buckets=2)
    row = lambda u, k, n: (u, k, n, DAY, n, False)
    first = spark.createDataFrame([row(u, "a", 1) for u in range(9)], status.STATUS)
    second = spark.createDataFrame([row(3, "b", 2), row(3, "c", 3), row(20, "d", 1)], status.STATUS)
    sink.write(first, 0)
    sink.write(second, 1)
    once = held(sink)
    assert once[3] == ("c", 3, 3, False) and len(once) == 10
    sink.write(second, 1)
    assert held(sink) == once
    sink.write(second.limit(0), 2)
    assert held(sink) == once


def test_equal_times_over_batches_in_the_older_operator(spark, tmp_path):
    path = str(tmp_path / "feed")
    arrive(spark, path, [(5, days(0), 1, "b")])
    arrive(spark, path, [(4, days(0), 1, "c")])
    run = feeds.last_status(feeds.feed(spark, path)).writeStream.outputMode("update").format("memory").queryName("ties").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("ties").agg(F.max_by("event_type", "n")).first()[0] == "b"


def test_registered_stream_has_late_rows_and_quiet_users():
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    late = con.execute(stream.REGISTRY.sql["streamed_arrivals"]).df()
    quiet = con.execute(stream.REGISTRY.sql["streamed_status"]).df().quiet
    assert late.late.sum() > 0 and late.rows.sum() == 10_000 and 0 < quiet.sum() < len(quiet)
