"""The preprocessing actions: category, requirements and default parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Action names by category.
CATEGORIES = {
    "data_quality": (
        "keep_as_is", "drop_column", "drop_if_mostly_null", "drop_if_constant", "drop_if_all_unique",
        "remove_duplicates", "fill_null_mean", "fill_null_median", "fill_null_mode",
        "fill_null_forward", "fill_null_backward", "fill_null_interpolate", "remove_outliers",
        "clip_outliers", "winsorize", "cap_floor_outliers",
    ),
    "type_conversion": (
        "parse_numeric", "parse_boolean", "parse_datetime", "parse_categorical", "parse_json",
    ),
    "scaling": (
        "standard_scale", "minmax_scale", "robust_scale", "maxabs_scale", "normalize_l1", "normalize_l2",
    ),
    "encoding": (
        "label_encode", "ordinal_encode", "onehot_encode", "binary_encode", "hash_encode",
        "frequency_encode", "target_encode",
    ),
    "transformation": (
        "log_transform", "log1p_transform", "sqrt_transform", "box_cox", "yeo_johnson",
        "power_transform", "quantile_transform",
    ),
    "feature_engineering": (
        "binning_equal_width", "binning_equal_freq", "binning_custom", "polynomial_features",
        "interaction_features", "datetime_extract_year", "cyclic_time_encode", "text_vectorize_tfidf",
        "geo_cluster_kmeans",
    ),
    "domain_specific": (
        "currency_normalize", "percentage_to_decimal", "text_lowercase", "text_uppercase",
        "text_clean", "phone_standardize", "email_validate", "url_parse",
    ),
}

# The action tried when another one fails.
FALLBACKS = {
    "standard_scale": "minmax_scale",
    "box_cox": "log1p_transform",
    "log_transform": "log1p_transform",
    "onehot_encode": "label_encode",
    "target_encode": "frequency_encode",
    "hash_encode": "label_encode",
    "text_vectorize_tfidf": "label_encode",
    "geo_cluster_kmeans": "binning_equal_freq",
}


@dataclass(frozen=True)
class ActionInfo:
    requirements: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    reversible: bool = True
    preserves_nulls: bool = True


# What an action asks of a column.
REGISTRY = {
    "keep_as_is": ActionInfo(),
    "drop_column": ActionInfo(("low_information_content",), {}, False, False),
    "drop_if_mostly_null": ActionInfo(("null_pct",), {"threshold": 0.6}, False, False),
    "drop_if_constant": ActionInfo(("unique_count",), {}, False, False),
    "drop_if_all_unique": ActionInfo(("cardinality",), {}, False, False),
    "standard_scale": ActionInfo(("numeric",)),
    "robust_scale": ActionInfo(("numeric",)),
    "log_transform": ActionInfo(("numeric", "positive")),
    "box_cox": ActionInfo(("numeric", "positive")),
    "onehot_encode": ActionInfo(("categorical", "low_cardinality"), {"max_categories": 10}),
    "target_encode": ActionInfo(("categorical", "high_cardinality", "target_available"), {}, False),
    "datetime_extract_year": ActionInfo(("temporal",), {}, False),
    "cyclic_time_encode": ActionInfo(("temporal",)),
    "text_vectorize_tfidf": ActionInfo(("text",), {"max_features": 100}, False, False),
    "geo_cluster_kmeans": ActionInfo(("numeric", "coordinate"), {"n_clusters": 10}, False),
}

ALL_ACTIONS = tuple(a for names in CATEGORIES.values() for a in names)
CATEGORY_OF = {a: category for category, names in CATEGORIES.items() for a in names}


def category_of(action: str) -> str:
    return CATEGORY_OF[action]


def action_table(spark: SparkSession) -> DataFrame:
    """Registry as a table: (action, category, requirements, reversible, preserves_nulls)."""
    rows = []
    for action in ALL_ACTIONS:
        info = REGISTRY.get(action, ActionInfo())
        rows.append((action, CATEGORY_OF[action], list(info.requirements), info.reversible, info.preserves_nulls))
    return spark.createDataFrame(
        rows, "action string, category string, requirements array<string>, reversible boolean, preserves_nulls boolean"
    )


def actions_by_category(spark: SparkSession) -> DataFrame:
    return action_table(spark).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("action")).alias("actions")
    )
