"""Health of columns and tables: a score of 100 with fixed deductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import scalar as S


def _text(condition: Column, template: str, *values: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.format_string(template, *values) if values else F.lit(template))


def column_health(profile: DataFrame) -> DataFrame:
    """One row per column with type, score, severity and the list of anomalies.

    Text that is mostly numbers counts as numeric, but its moments are not part of the profile;
    parse it first if they matter.
    """
    zero = F.lit(0.0)
    null, ratio, unique = F.col("null_pct"), F.col("unique_ratio"), F.col("unique_count")
    parsed = F.coalesce(F.col("sem_number") * F.col("present") / F.col("row_count"), zero)
    kind = S.first_match([
        (F.col("present") == 0, "empty"), (F.col("is_numeric"), "numeric"), (F.col("is_temporal"), "datetime"),
        (parsed > 0.8, "numeric"), (ratio < 0.5, "categorical")], "text")
    number = (F.col("data_type") == "numeric") & F.col("is_numeric")
    category = F.col("data_type") == "categorical"
    top = F.col("top_share")
    percent = lambda c: c * 100
    rules = [
        (number & (F.col("outlier_pct") > 0.1), 15, "%.1f%% of the values lie outside the fences", percent(F.col("outlier_pct"))),
        (number & (F.abs("skewness") > 2), 10, "skewed distribution (%.2f)", F.col("skewness")),
        (number & (F.col("cv") > 2), 5, "deviation is %.2f times the mean", F.col("cv")),
        (category & (top > 0.9), 10, "one category holds %.1f%%", percent(top)),
        (category & (unique > 100), 15, "%d categories", unique),
        (category & (unique == 1), 30, "a single category", None),
        (null > 0.5, 30, "more than half is missing (%.1f%%)", percent(null)),
        ((null > 0.2) & (null <= 0.5), 15, "a good part is missing (%.1f%%)", percent(null)),
        ((null > 0.05) & (null <= 0.2), 5, "some values are missing (%.1f%%)", percent(null)),
        ((ratio > 0.95) & (F.col("row_count") > 50), 20, "%.1f%% distinct, perhaps an identifier", percent(ratio)),
        (unique == 1, 30, "every value is the same", None),
    ]
    lost = sum((F.when(F.coalesce(c, F.lit(False)), points).otherwise(0) for c, points, *_ in rules), F.lit(0))
    start = F.when(F.col("data_type") == "empty", 0).otherwise(100)
    notes = [_text(F.col("data_type") == "empty", "no value at all")]
    notes += [_text(c, t, *([v] if v is not None else [])) for c, _, t, v in rules]
    typed = profile.withColumn("data_type", kind)
    scored = typed.withColumn("__score", (start - lost).cast("double"))
    score = F.col("__score")
    return scored.select(
        "table_name", "column_name", "data_type", F.greatest(score, zero).alias("health_score"),
        S.first_match([(score >= 80, "healthy"), (score >= 50, "warning")], "critical").alias("severity"),
        F.array_compact(F.array(*notes)).alias("anomalies"),
        "null_count", "null_pct", (F.col("row_count") - unique).alias("duplicate_count"), F.col("duplicate_ratio").alias("duplicate_pct"),
        "unique_count", "unique_ratio", F.when(number, F.col("outlier_count")).alias("outlier_count"), "skewness", "kurtosis", "mean", "std", "cv",
        F.when(category, unique).alias("cardinality"), F.when(category, top > 0.9).alias("is_imbalanced"),
    )


def table_health(health: DataFrame) -> DataFrame:
    return health.groupBy("table_name").agg(
        F.avg("health_score").alias("overall_health_score"),
        F.count_if(F.col("severity") == "healthy").alias("healthy_columns"),
        F.count_if(F.col("severity") == "warning").alias("warning_columns"),
        F.count_if(F.col("severity") == "critical").alias("critical_columns"),
    )
