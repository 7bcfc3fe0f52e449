"""Evaluation of decisions and monitoring of their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANUAL_SECONDS = 60.0

# Label spellings counted as the same action.
LABEL_SYNONYMS = {
    "keep_as_is": "keep_as_is", "retain_column": "keep_as_is", "drop_column": "drop_column",
    "scale": "standard_scale", "scale_or_normalize": "standard_scale", "standard_scale": "standard_scale", "normalize": "standard_scale",
    "log_transform": "log_transform", "log1p_transform": "log_transform",
    "encode_categorical": "encode_categorical", "label_encode": "encode_categorical", "ordinal_encode": "encode_categorical",
    "frequency_encode": "frequency_encode", "onehot_encode": "onehot_encode",
    "parse_datetime": "parse_datetime", "parse_boolean": "parse_boolean",
}


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion matrix."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    by_truth = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    by_guess = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guesses"))
    joined = by_truth.join(by_guess, "label", "full").na.fill(0, ["support", "hits", "guesses"])
    precision = F.when(F.col("guesses") > 0, F.col("hits") / F.col("guesses")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return joined.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def accuracy_by(rows: DataFrame, dataset: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy per dataset and over all of them (dataset null)."""
    right = F.avg((F.col(truth) == F.col(predicted)).cast("double"))
    return rows.rollup(F.col(dataset).alias("dataset")).agg(right.alias("accuracy"), F.count(F.lit(1)).alias("n"))


def map_labels(c: Column, names: dict[str, str] | None = None) -> Column:
    """One spelling per action: given names first, then the known synonyms; others stay."""
    clean = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    known = {**LABEL_SYNONYMS, **(names or {})}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[clean], clean)


def variant_summary(scores: DataFrame) -> DataFrame:
    """Mean, population deviation, range and number of (variant, dataset, score) rows."""
    return scores.groupBy("variant").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.count(F.lit(1)).alias("n"))


def variant_comparisons(scores: DataFrame) -> DataFrame:
    """Paired t statistic and Cohen's d of every two variants over the datasets both have."""
    a, b = scores.alias("a"), scores.alias("b")
    gap = F.col("a.score") - F.col("b.score")
    joined = a.join(b, (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.variant") < F.col("b.variant")))
    grouped = joined.groupBy(F.col("a.variant").alias("variant"), F.col("b.variant").alias("other")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_difference"), F.stddev_samp(gap).alias("sd"),
        F.stddev_pop("a.score").alias("sa"), F.stddev_pop("b.score").alias("sb"))
    pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)
    return grouped.select(
        "variant", "other", "n", "mean_difference",
        F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt("n"))).alias("t_statistic"),
        F.when(pooled > 0, F.col("mean_difference") / pooled).otherwise(0.0).alias("cohens_d"))


def benchmark_summary(decisions: DataFrame) -> DataFrame:
    """Columns, mean confidence and mean latency per dataset, with counts per source."""
    return decisions.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"), F.avg("confidence").alias("mean_confidence"), F.avg("latency_ms").alias("mean_latency"),
        F.count_if(F.col("source") == "symbolic").alias("symbolic"), F.count_if(F.col("source") == "neural").alias("neural"),
        F.countDistinct("action").alias("actions"))


def action_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("dataset", "action").agg(F.count(F.lit(1)).alias("n"))


def attach_feedback(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every decision with its latest feedback; feedback rows are reduced before the join."""
    latest = feedback.groupBy("decision_id").agg(F.max(F.struct("feedback_ts", "accepted", "rating", "helpful")).alias("f"))
    return decisions.join(latest, "decision_id", "left").select(
        *decisions.columns, F.col("f.accepted").alias("accepted"), F.col("f.rating").alias("rating"), F.col("f.helpful").alias("helpful"))


def decision_metrics(decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: volume, acceptance, confidence, time, sources, ratings and helpfulness."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")) * 100, F.lit(0.0))
    left = decisions.agg(
        F.count(F.lit(1)).alias("total_decisions"), rate("accepted").alias("acceptance_rate"), F.avg("confidence").alias("average_confidence"),
        F.avg("latency_ms").alias("average_processing_time_ms"), (F.sum("seconds_saved") / 3600).alias("total_time_saved_hours"),
        F.avg("seconds_saved").alias("average_time_saved"), F.count_if(F.col("source") == "symbolic").alias("symbolic_decisions"),
        F.count_if(F.col("source") == "neural").alias("neural_decisions"), F.count_if(F.col("source") == "learned").alias("learned_decisions"),
        rate("helpful").alias("helpfulness_rate"))
    right = sessions.agg(F.count(F.lit(1)).alias("total_sessions"), F.countDistinct("user_id").alias("total_users"),
                         F.coalesce(F.avg("satisfaction"), F.lit(0.0)).alias("average_rating"))
    return left.crossJoin(right).withColumns({
        "override_rate": 100 - F.col("acceptance_rate"),
        "time_vs_manual_percentage": (MANUAL_SECONDS - F.col("average_time_saved")) / MANUAL_SECONDS * 100})


def recent_window(decisions: DataFrame, sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Volume, users, confidence and hours saved in the last ``hours``."""
    start = now - F.expr(f"INTERVAL {hours} HOURS")
    left = decisions.where(F.col("ts").cast("timestamp") > start).agg(
        F.count(F.lit(1)).alias("decisions_made"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.sum("seconds_saved") / 3600, F.lit(0.0)).alias("time_saved_hours"))
    right = sessions.where(F.col("start_time").cast("timestamp") > start).agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("user_id").alias("unique_users"))
    return left.crossJoin(right)


def latency_report(calls: DataFrame, last: int | None = None) -> DataFrame:
    """Latency percentiles, rate and error share of all calls, per component.

    With ``last`` the latencies are those of the newest calls of each component only; that row limit is
    applied before the shuffle.
    """
    recent = calls
    if last is not None:
        newest = W.partitionBy("component").orderBy(F.desc("ts"), F.desc("call_id"))
        recent = calls.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last)
    recent = recent.groupBy("component").agg(
        F.avg("latency_ms").alias("avg_latency_ms"), F.percentile("latency_ms", [0.5, 0.95, 0.99]).alias("p"))
    seconds = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))
    overall = calls.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if(~F.col("success")).alias("failed_calls"), (seconds / 1e6).alias("seconds"))
    return recent.join(overall, "component").select(
        "component", "avg_latency_ms", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p95", "p99"))],
        F.when(F.col("seconds") > 0, F.col("total_calls") / F.col("seconds")).otherwise(0.0).alias("calls_per_second"),
        (F.col("failed_calls") / F.col("total_calls")).alias("error_rate"), "total_calls")


def source_breakdown(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std"))


def last_decisions(decisions: DataFrame, n: int) -> DataFrame:
    return decisions.orderBy(F.desc("ts"), F.desc("decision_id")).limit(n)


def batch_summary(decisions: DataFrame) -> DataFrame:
    """Columns, mean confidence and sources per table."""
    return decisions.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("source") == "symbolic").alias("symbolic"), F.count_if(F.col("source") == "conservative_fallback").alias("fallback"))
