"""Queries for streaming operators; each runs the stream over all that is there and reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.plans.apply import fit
from colsmith.session import scratch_path
from colsmith.streaming import windows as W

_D = "(SELECT *, least(1.0, value / 100) AS confidence FROM events)"


def _copy(df, name, parts=4):
    """The table as several parquet files in a folder of its own, to be read as a stream."""
    path = scratch_path(df.sparkSession, name)
    df.repartition(parts).write.parquet(path)
    return path


def _events(load):
    return load("events").withColumns({"confidence": F.least(F.lit(1.0), F.col("value") / 100), "ts": F.col("ts").cast("timestamp")})


def _stream(df, name, last=None):
    """The table as a stream, with the row ``last`` at its end."""
    path = _copy(df, name)
    if last is not None:
        last.write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _run(df, mode="append", keys=()):
    spark = df.sparkSession
    sink = scratch_path(spark, "sink")
    W.run_available(df, sink, scratch_path(spark, "state"), mode)
    return W.latest(spark, sink, list(keys)) if mode == "update" else spark.read.parquet(sink)


_HOURLY = f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS decisions, round(avg(confidence), 10) AS mean_confidence FROM {_D} d GROUP BY ALL"""


@query("r1_windowed_metrics", _HOURLY)
def _(load):
    found = W.windowed_metrics(_events(load), "ts", "event_type")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "decisions", r("mean_confidence", 10).alias("mean_confidence"))


@query("r1_windowed_metrics_stream", _HOURLY)
def _(load):
    found = _run(W.windowed_metrics(_stream(_events(load), "events"), "ts", "event_type", late="1 hour"), "update", ["window_start", "event_type"])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "decisions", r("mean_confidence", 10).alias("mean_confidence"))


@query("r1_sliding_metrics", f"""SELECT w AS window_start, event_type, count(*) AS decisions FROM (
  SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w, event_type FROM {_D} d) x GROUP BY ALL""")
def _(load):
    found = W.windowed_metrics(_events(load), "ts", "event_type", "1 hour", "30 minutes")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "decisions")


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS decisions, count(*) FILTER (event_type = 'error') AS overrides, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds FROM s GROUP BY user_id, nth"""


@query("r2_sessions", _SESSIONS)
def _(load):
    found = W.user_sessions(_events(load), "ts", "user_id", F.col("event_type") == "error")
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "decisions", "overrides", r("duration_seconds", 6).alias("duration_seconds"))


@query("r2_sessions_stream", _SESSIONS)
def _(load):
    """All sessions, in append mode: the watermark closes them, and the end of the stream those that are still open."""
    events = _events(load)
    found = _run(W.user_sessions(_stream(events, "events", W.closing_row(events, "ts")), "ts", "user_id", F.col("event_type") == "error"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "decisions", "overrides", r("duration_seconds", 6).alias("duration_seconds"))


@query("r3_fitted_stream", """
WITH p AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events) d)
SELECT event_id, round((value - m) / s, 6) AS value, code AS event_type FROM events JOIN c USING (event_type), p""")
def _(load):
    events = load("events").select("event_id", "value", "event_type")
    fitted = fit(events, {"value": "standard_scale", "event_type": "label_encode"})
    found = _run(W.transformed(_stream(events, "events"), fitted))
    return found.select("event_id", r("value").alias("value"), "event_type")


@query("r4_rule_counters", "SELECT event_type AS rule_name, count(*) AS decisions, count(*) FILTER (user_id % 3 <> 0) AS correct FROM events GROUP BY event_type")
def _(load):
    log = load("events").select(F.col("event_type").alias("rule_name"), (F.col("user_id") % 3 != 0).alias("correct"))
    return _run(W.rule_counters(_stream(log, "log")), "update", ["rule_name"])


@query("r5_csv_stream", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(orders.sparkSession, "csv")
    orders.repartition(4).write.option("header", True).option("sep", ";").csv(path)
    return _run(W.csv_stream(orders.sparkSession, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double", ";", 2))
