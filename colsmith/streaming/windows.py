"""Decision metrics, sessions and rule counters over event time.

The same aggregations run on batch frames. On streams, counts are pre-aggregated before the shuffle, so
a user or source with a third of all rows adds no more state than any other key. The watermark
bounds the state in append and update mode; complete mode keeps all groups for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colsmith.plans.apply import Fitted


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """Event time as a timestamp with zone, and a watermark on streams."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late) if late and df.isStreaming else timed


def windowed_metrics(decisions: DataFrame, ts: str, key: str, width: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Number and mean confidence per window and key; tumbling, or sliding when ``slide`` is given."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _timed(decisions, ts, late).groupBy(window.alias("w"), key).agg(
        F.count(F.lit(1)).alias("decisions"), F.avg("confidence").alias("mean_confidence")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "decisions", "mean_confidence")


def user_sessions(decisions: DataFrame, ts: str, user: str, overridden: Column, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without a decision: decisions, overrides and duration.

    On a stream, run it in append mode: a session is written once, when the watermark (the latest event less ``late``) has passed its end, and then leaves the state; rows that
    come later than that are dropped. Only sessions that are still open are held. On a batch frame all sessions are there.
    """
    return _timed(decisions, ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(
        F.count(F.lit(1)).alias("decisions"), F.sum(overridden.cast("int")).alias("overrides"), F.max(ts).alias("last")).select(
        user, F.col("s.start").alias("session_start"), "decisions", "overrides",
        ((F.unix_micros("last") - F.unix_micros("s.start")) / 1e6).alias("duration_seconds"))


def closing_row(decisions: DataFrame, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row, null but for its event time, to be sent after the last decision of a stream that has ended.

    It takes the watermark past the end of every session of ``user_sessions``, so that all are written. Its own session stays open and is not.
    """
    ahead = F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 SECOND")  # watermarks are whole milliseconds
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in decisions.schema.fields if f.name != ts]
    return decisions.agg((F.max(ts) + ahead).alias(ts)).select(*[F.col(ts), *nulls]).select(*decisions.columns)


def transformed(stream: DataFrame, fitted: Fitted) -> DataFrame:
    """A fitted transform on a stream: projections and stream-static lookups only."""
    return fitted.transform(stream)


def rule_counters(log: DataFrame) -> DataFrame:
    """Test decisions and hits per rule, one small group per rule; run it in update mode and read it with ``latest``."""
    return log.groupBy("rule_name").agg(F.count(F.lit(1)).alias("decisions"), F.count_if("correct").alias("correct"))


def csv_stream(spark: SparkSession, folder: str, schema: str, separator: str = ",", files_per_trigger: int = 10) -> DataFrame:
    """A folder of delimited files as a stream, a few files at a time."""
    return (spark.readStream.schema(schema).option("sep", separator).option("header", True).option("mode", "DROPMALFORMED")
            .option("maxFilesPerTrigger", files_per_trigger).csv(folder))


def table_stream(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there and stop; results land in parquet at ``sink``.

    In update mode a batch holds only the groups that changed, so batches are kept side by side with their number in
    ``batch``; ``latest`` reads the newest row of every group. A batch that is run again replaces itself. In complete mode
    each batch is the whole result and replaces the sink.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", sink).start()
    elif mode == "update":
        query = writer.outputMode(mode).foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{sink}/batch={k}")).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The newest row of every group of an update-mode sink."""
    rows = spark.read.parquet(sink)
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
    return newest.select(*keys, *[F.col("row")[c].alias(c) for c in others])
