"""Queries for evaluation and monitoring. Decisions, feedback and sessions come from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.recommend import _DECIDED, _profile
from colsmith.catalog.registry import query, r
from colsmith.plans import evaluate as E
from colsmith.plans.recommend import recommend

_TRUTH = "(SELECT CASE WHEN quality = 1 THEN 'keep_as_is' ELSE 'drop_column' END AS truth, CASE WHEN toxic = 0 THEN 'keep_as_is' ELSE 'drop_column' END AS predicted, source AS dataset FROM labels JOIN documents USING (doc_id))"


def _labelled(load):
    return load("labels").join(load("documents").select("doc_id", "source"), "doc_id").select(
        F.when(F.col("quality") == 1, "keep_as_is").otherwise("drop_column").alias("truth"),
        F.when(F.col("toxic") == 0, "keep_as_is").otherwise("drop_column").alias("predicted"), F.col("source").alias("dataset"))


_SOURCE = "CASE event_type WHEN 'click' THEN 'symbolic' WHEN 'view' THEN 'neural' ELSE 'learned' END"
_D = f"d AS (SELECT event_id AS decision_id, user_id, ts, {_SOURCE} AS source, least(1.0, value / 100) AS confidence, value AS latency_ms, value / 10 AS seconds_saved, event_type <> 'error' AS success, event_type AS action, 'u' || (user_id % 7) AS dataset FROM events)"
_F = "b AS (SELECT decision_id, ts AS feedback_ts, user_id % 2 = 0 AS accepted, user_id % 5 AS rating, event_id % 3 = 0 AS helpful FROM (SELECT event_id AS decision_id, * FROM events UNION ALL SELECT event_id - event_id % 4, * FROM events) x)"
_S = "s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n, CAST(sum(event_id) % 5 AS BIGINT) AS satisfaction FROM events GROUP BY user_id, day)"


def _decisions(load):
    return load("events").select(
        F.col("event_id").alias("decision_id"), "user_id", "ts", F.expr(_SOURCE).alias("source"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        F.col("value").alias("latency_ms"), (F.col("value") / 10).alias("seconds_saved"), (F.col("event_type") != "error").alias("success"),
        F.col("event_type").alias("action"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("dataset"))


def _feedback(load):
    """Two feedback rows for every fourth decision, of which the later one counts."""
    e = load("events")
    both = e.withColumn("decision_id", F.col("event_id")).union(e.withColumn("decision_id", F.col("event_id") - F.col("event_id") % 4))
    return both.select("decision_id", F.col("ts").alias("feedback_ts"), (F.col("user_id") % 2 == 0).alias("accepted"), (F.col("user_id") % 5).alias("rating"),
                       (F.col("event_id") % 3 == 0).alias("helpful"))


def _sessions(load):
    return load("events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n"), (F.sum("event_id") % 5).alias("satisfaction"))


@query("e1_confusion_matrix", f"SELECT truth, predicted, count(*) AS n FROM {_TRUTH} t GROUP BY ALL")
def _(load):
    return E.confusion(_labelled(load))


@query("e1_class_metrics", f"""WITH t AS {_TRUTH}, l AS (SELECT DISTINCT truth AS label FROM t UNION SELECT DISTINCT predicted FROM t),
c AS (SELECT label, (SELECT count(*) FROM t WHERE truth = label) AS support, (SELECT count(*) FROM t WHERE predicted = label) AS guesses, (SELECT count(*) FROM t WHERE truth = label AND predicted = label) AS hits FROM l)
SELECT label, round(coalesce(hits / nullif(guesses, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(guesses + support, 0), 0), 6) AS f1, support FROM c""")
def _(load):
    found = E.class_metrics(E.confusion(_labelled(load)))
    return found.select("label", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


@query("e2_accuracy", f"SELECT dataset, round(avg((truth = predicted)::INT), 6) AS accuracy, count(*) AS n FROM {_TRUTH} t GROUP BY ROLLUP (dataset)")
def _(load):
    return E.accuracy_by(_labelled(load), "dataset").withColumn("accuracy", r("accuracy"))


@query("e3_label_mapping", "SELECT event_id, CASE event_type WHEN 'click' THEN 'keep_as_is' WHEN 'error' THEN 'drop_column' ELSE event_type END AS label FROM events")
def _(load):
    text = F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))
    return load("events").select("event_id", E.map_labels(text, {"click": "keep_as_is", "error": "drop_column"}).alias("label"))


_SCORES = "v AS (SELECT event_type AS variant, 'u' || (user_id % 7) AS dataset, avg(value) / 100 AS score FROM events GROUP BY ALL)"


def _scores(load):
    return load("events").groupBy(F.col("event_type").alias("variant"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("dataset")).agg(
        (F.avg("value") / 100).alias("score"))


@query("e4_variant_summary", f"WITH {_SCORES} SELECT variant, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, count(*) AS n FROM v GROUP BY variant")
def _(load):
    return E.variant_summary(_scores(load)).select("variant", *[r(c).alias(c) for c in ("mean", "std", "min", "max")], "n")


@query("e4_variant_comparisons", f"""WITH {_SCORES}, j AS (SELECT a.variant, b.variant AS other, a.score AS x, b.score AS y FROM v a JOIN v b ON a.dataset = b.dataset AND a.variant < b.variant)
SELECT variant, other, count(*) AS n, round(avg(x - y), 6) AS mean_difference, round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 5) AS t_statistic,
  round(avg(x - y) / sqrt((var_pop(x) + var_pop(y)) / 2), 5) AS cohens_d FROM j GROUP BY variant, other""")
def _(load):
    return E.variant_comparisons(_scores(load)).select("variant", "other", "n", r("mean_difference").alias("mean_difference"), r("t_statistic", 5).alias("t_statistic"), r("cohens_d", 5).alias("cohens_d"))


@query("e6_benchmark_summary", f"""WITH {_D} SELECT dataset, count(*) AS columns, round(avg(confidence), 6) AS mean_confidence, round(avg(latency_ms), 5) AS mean_latency, count(*) FILTER (source = 'symbolic') AS symbolic,
  count(*) FILTER (source = 'neural') AS neural, count(DISTINCT action) AS actions FROM d GROUP BY dataset""")
def _(load):
    found = E.benchmark_summary(_decisions(load))
    return found.withColumns({"mean_confidence": r("mean_confidence"), "mean_latency": r("mean_latency", 5)})


@query("e6_action_summary", f"WITH {_D} SELECT dataset, action, count(*) AS n FROM d GROUP BY ALL")
def _(load):
    return E.action_summary(_decisions(load))


_FED = f"{_D}, {_F}, l AS (SELECT decision_id, max_by({{'a': accepted, 'r': rating, 'h': helpful}}, (feedback_ts, accepted, rating, helpful)) AS f FROM b GROUP BY decision_id), j AS (SELECT d.*, f.a AS accepted, f.r AS rating, f.h AS helpful FROM d LEFT JOIN l USING (decision_id))"


@query("e7_decision_metrics", f"""WITH {_FED}, {_S} SELECT count(*) AS total_decisions, round(avg(accepted::INT) * 100, 5) AS acceptance_rate, round(avg(confidence), 6) AS average_confidence, round(avg(latency_ms), 5) AS average_processing_time_ms,
  round(sum(seconds_saved) / 3600, 5) AS total_time_saved_hours, count(*) FILTER (source = 'symbolic') AS symbolic_decisions, round(avg(helpful::INT) * 100, 5) AS helpfulness_rate, (SELECT count(*) FROM s) AS total_sessions,
  (SELECT count(DISTINCT user_id) FROM s) AS total_users, (SELECT round(avg(satisfaction), 6) FROM s) AS average_rating, round((60 - avg(seconds_saved)) / 60 * 100, 5) AS time_vs_manual_percentage FROM j""")
def _(load):
    found = E.decision_metrics(E.attach_feedback(_decisions(load), _feedback(load)), _sessions(load))
    return found.select("total_decisions", r("acceptance_rate", 5).alias("acceptance_rate"), r("average_confidence").alias("average_confidence"), r("average_processing_time_ms", 5).alias("average_processing_time_ms"),
                        r("total_time_saved_hours", 5).alias("total_time_saved_hours"), "symbolic_decisions", r("helpfulness_rate", 5).alias("helpfulness_rate"), "total_sessions", "total_users",
                        r("average_rating").alias("average_rating"), r("time_vs_manual_percentage", 5).alias("time_vs_manual_percentage"))


@query("e8_feedback", f"WITH {_FED} SELECT decision_id, source, accepted, rating, helpful FROM j")
def _(load):
    return E.attach_feedback(_decisions(load), _feedback(load)).select("decision_id", "source", "accepted", "rating", "helpful")


@query("e9_recent_window", f"""WITH {_D}, {_S} SELECT (SELECT count(*) FROM d WHERE ts > TIMESTAMP '2024-01-20') AS decisions_made, (SELECT round(avg(confidence), 6) FROM d WHERE ts > TIMESTAMP '2024-01-20') AS average_confidence,
  (SELECT round(sum(seconds_saved) / 3600, 5) FROM d WHERE ts > TIMESTAMP '2024-01-20') AS time_saved_hours, (SELECT count(*) FROM s WHERE start_time > TIMESTAMP '2024-01-20') AS sessions,
  (SELECT count(DISTINCT user_id) FROM s WHERE start_time > TIMESTAMP '2024-01-20') AS unique_users""")
def _(load):
    found = E.recent_window(_decisions(load), _sessions(load), F.lit("2024-01-22").cast("timestamp"), 48)
    return found.withColumns({"average_confidence": r("average_confidence"), "time_saved_hours": r("time_saved_hours", 5)})


@query("e10_latency_report", f"""WITH {_D}, n AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ts DESC, decision_id DESC) AS k FROM d),
q AS (SELECT action, avg(latency_ms) AS m, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99 FROM n GROUP BY action),
o AS (SELECT action, count(*) AS total_calls, count(*) FILTER (NOT success) / count(*) AS error_rate, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM d GROUP BY action)
SELECT action AS component, round(m, 5) AS avg_latency_ms, round(p50, 5) AS p50, round(p95, 5) AS p95, round(p99, 5) AS p99, round(total_calls / seconds, 8) AS calls_per_second, round(error_rate, 6) AS error_rate, total_calls FROM q JOIN o USING (action)""")
def _(load):
    calls = _decisions(load).select(F.col("action").alias("component"), "ts", F.col("decision_id").alias("call_id"), "latency_ms", "success")
    found = E.latency_report(calls)
    return found.select("component", *[r(c, 5).alias(c) for c in ("avg_latency_ms", "p50", "p95", "p99")], r("calls_per_second", 8).alias("calls_per_second"), r("error_rate").alias("error_rate"), "total_calls")


@query("e11_source_breakdown", f"WITH {_D} SELECT source, count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std FROM d GROUP BY source")
def _(load):
    return E.source_breakdown(_decisions(load)).select("source", "n", r("mean").alias("mean"), r("std").alias("std"))


@query("e11_last_decisions", f"WITH {_D} SELECT decision_id, source FROM d ORDER BY ts DESC, decision_id DESC LIMIT 100")
def _(load):
    return E.last_decisions(_decisions(load), 100).select("decision_id", "source")


@query("e12_batch_summary", f"WITH {_DECIDED} SELECT table_name, count(*) AS columns, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (source = 'symbolic') AS symbolic, count(*) FILTER (source = 'conservative_fallback') AS fallback FROM f GROUP BY table_name")
def _(load):
    return E.batch_summary(recommend(_profile(load))).withColumn("mean_confidence", r("mean_confidence"))
