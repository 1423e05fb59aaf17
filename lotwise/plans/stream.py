"""Event feeds; streams run over the fixture to their end and give what their batch forms give."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.durable import checkpoint_dir
from lotwise.plans import Registry
from lotwise.sources.tables import table
from lotwise.streaming import events as feeds
from lotwise.streaming import status

REGISTRY = Registry()
query = REGISTRY


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.timed(table(spark, sf_dir, "events"))


def named(df: DataFrame, *columns: str) -> DataFrame:
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")}
    return df.select(*(times.get(c, F.col(c)) for c in columns))


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2, 3""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type."""
    return named(feeds.windows(batch(spark, sf_dir), "1 day").withColumn("total", F.col("total").cast("double")), "start", "end", "event_type", "n", "total")


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by half-day windows that start every six hours."""
    return named(feeds.windows(batch(spark, sf_dir), "12 hours", "6 hours"), "start", "end", "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions: events less than four hours apart."""
    return named(feeds.sessions(batch(spark, sf_dir), "4 hours"), "user_id", "start", "end", "n")


@query("""SELECT event_id, e.user_id, event_type, c_mktsegment AS house FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) e LEFT JOIN customer ON e.user_id = c_custkey""")
def stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, each once, with a column of a static table."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("house"))
    return feeds.enriched(feeds.unique(batch(spark, sf_dir)), known, "user_id").select("event_id", "user_id", "event_type", "house")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1""")
def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event type and number of events."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_type, max(ts) AS latest FROM events GROUP BY 1) SELECT event_type, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest, latest < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS stale FROM m""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each type, and whether it lags an hour behind the feed."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("ts").alias("top"))
    by = e.groupBy("event_type").agg(F.max("ts").alias("t"))
    return by.crossJoin(F.broadcast(top)).select("event_type", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("latest"), (F.col("t") < F.col("top") - F.expr("INTERVAL 1 HOUR")).alias("stale"))


#: Arrivals that events come in, and after how long without an event a user counts as quiet.
ARRIVALS, QUIET = 4, timedelta(hours=6)
#: Events arrive in the order of their days but for every seventeenth, which comes an arrival later.
ARRIVAL = "least({0} - 1, CAST(floor(({1} - lo) * {0} / (hi - lo + 1)) AS INT) + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)"
STREAMED = f"""WITH span AS (SELECT min(epoch_us(ts)) // 86400000000 AS lo, max(epoch_us(ts)) // 86400000000 AS hi FROM events), a AS (SELECT event_id, user_id, event_type, ts, {ARRIVAL.format(ARRIVALS, "epoch_us(ts) // 86400000000")} AS arrival FROM events, span),
marks AS (SELECT k AS arrival, (SELECT max(ts) FROM a WHERE a.arrival < k) - INTERVAL 1 DAY AS mark FROM range({ARRIVALS}) r(k)), told AS (SELECT a.*, coalesce(date_trunc('millisecond', ts) <= mark, FALSE) AS late FROM a JOIN marks USING (arrival))"""


def streamed(spark: SparkSession, sf_dir: str) -> tuple[status.KeyedSink, list[tuple[int, int, int]]]:
    """The sink after all arrivals have gone through the stream, and (arrival, rows, late rows)."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    events = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    span = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    rows = events.crossJoin(F.broadcast(span)).withColumn("day", day)
    rows = rows.withColumn("arrival", F.expr(ARRIVAL.format(ARRIVALS, "day"))).select(*events.columns, "arrival")
    sink, seen = status.KeyedSink(spark, f"{folder}/table", ["user_id"], status.STATUS), []
    for k in range(ARRIVALS):
        rows.where(F.col("arrival") == k).write.mode("append").parquet(f"{folder}/feed")
        done = status.drain(spark, f"{folder}/feed", f"{folder}/checkpoint", sink, quiet=QUIET)
        seen.append((k, sum(n for n, _ in done), sum(late for _, late in done)))
    return sink, seen


@query(f"""{STREAMED}, s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS latest, count(*) AS n FROM told WHERE NOT late GROUP BY 1)
SELECT user_id, event_type, event_id, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest, n, latest + INTERVAL {QUIET.seconds} SECOND <= (SELECT max(ts) FROM a) - INTERVAL 1 DAY AS quiet FROM s""")
def streamed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event and number of events, kept by a stream that takes in the events in four arrivals; late rows don't count."""
    sink, _ = streamed(spark, sf_dir)
    return sink.read().select("user_id", "event_type", "event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("latest"), "n", "quiet")


@query(f"""{STREAMED} SELECT CAST(arrival AS INTEGER) AS arrival, count(*) AS rows, count(*) FILTER (late) AS late FROM told GROUP BY 1""")
def streamed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each arrival of the stream had, and how many of them came too late."""
    return spark.createDataFrame(streamed(spark, sf_dir)[1], "arrival int, rows long, late long")
