"""Streams over several batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colsmith.streaming import windows as W


def test_update_mode_keeps_every_key(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(f"rule{k}", True), ("all", k > 0)], "rule_name string, correct boolean").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("rule_name string, correct boolean").option("maxFilesPerTrigger", 1).parquet(source)
    W.run_available(W.rule_counters(stream), sink, str(tmp_path / "state"), "update")
    found = {r["rule_name"]: (r["decisions"], r["correct"]) for r in W.latest(spark, sink, ["rule_name"]).collect()}
    assert found == {"rule0": (1, 1), "rule1": (1, 1), "rule2": (1, 1), "all": (3, 2)}
    assert spark.read.parquet(sink).select(F.countDistinct("batch")).first()[0] >= 3


def test_closed_sessions_leave_the_state(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    minute = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [
        [("a", 0, True), ("a", 20, False), ("b", 10, False)],
        [("a", 200, True), ("b", 205, True)],  # the watermark is at 145: both first sessions are over
        [("a", 5, True), ("b", 215, False), ("c", 400, False)],  # a row for a closed session comes too late
        [("c", 410, True)],
    ]
    for rows in batches:
        spark.createDataFrame([(u, minute(m), o) for u, m, o in rows], "user string, ts timestamp, overridden boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user string, ts timestamp, overridden boolean").option("maxFilesPerTrigger", 1).parquet(source)
        query = W.run_available(W.user_sessions(stream, "ts", "user", F.col("overridden")), sink, state)
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress["stateOperators"] else None
    found = sorted((r["user"], int((r["session_start"] - minute(0)).total_seconds() // 60), r["decisions"], r["overrides"], r["duration_seconds"]) for r in spark.read.parquet(sink).collect())
    assert found == [("a", 0, 2, 1, 1200.0), ("a", 200, 1, 1, 0.0), ("b", 10, 1, 0, 0.0), ("b", 205, 2, 1, 600.0)]
    assert held == 1  # only the session of c is open


def test_the_end_of_a_stream_closes_all_sessions(spark, folder):
    from __spark_entry__ import queries

    streamed, batch = (sorted(tuple(r) for r in queries()[q](spark, folder).collect()) for q in ("r2_sessions_stream", "r2_sessions"))
    assert streamed == batch and streamed


def test_closing_row_of_no_decisions(spark):
    empty = spark.createDataFrame([], "user string, ts timestamp")
    assert [tuple(r) for r in W.closing_row(empty, "ts").collect()] == [(None, None)]
