"""Semantic types and target columns, decided from profile rows and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions import constants as K
from colsmith.functions import scalar as S
from colsmith.operators.features import named, zero

EMPTY_SHARE = 0.9
HIGH_SHARE = 0.8
MEDIUM_SHARE = 0.5
UNIQUE_SHARE = 0.95
MAX_CATEGORIES = 50
LIKELY_TARGET = 0.6


def _pick(*cases: tuple[Column, str, Column | float, str | None]) -> Column:
    """First case whose condition holds, as a struct (type, confidence, action)."""
    def result(kind, confidence, action):
        value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.struct(F.lit(kind).alias("semantic_type"), value.cast("double").alias("confidence"),
                        F.lit(action).cast("string").alias("action"))

    chain = None
    for condition, kind, confidence, action in cases:
        condition = F.coalesce(condition, F.lit(False))
        value = result(kind, confidence, action)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def _pattern_case(kind: str, share: Column, weight: float):
    """Share of matches with a lower bar and a bonus when the name hints at the type."""
    hint = named(*K.NAME_HINTS[kind])
    found = (share >= HIGH_SHARE) | ((share >= MEDIUM_SHARE) & hint)
    confidence = F.least(F.lit(1.0), share * weight + F.when(hint, 1 - weight).otherwise(0.0))
    return found & (confidence >= MEDIUM_SHARE), kind, confidence, None


def semantic_types(profile: DataFrame) -> DataFrame:
    """First detector: ten classes in a fixed order, with a confidence.

    Shares are over non-null values, for whole numbers over their decimal digits.
    """
    present, unique = F.col("present"), F.col("unique_count")
    ratio = S.safe_ratio(unique.cast("double"), present)
    has = present > 0
    hint_id = named(*K.NAME_HINTS["identifier"])
    hash_like = (F.coalesce(F.col("length_std"), F.lit(0.0)) < 1) & (F.col("avg_length") > 10) & (F.col("sem_alnum") > 0.9)
    identifier = S.first_match([
        (zero("sem_uuid") >= 0.8, 0.95), ((ratio >= UNIQUE_SHARE) & hint_id, 0.9),
        ((ratio >= UNIQUE_SHARE) & F.coalesce(hash_like, F.lit(False)), 0.85), (hint_id & (ratio >= 0.8), 0.75)], 0.0)
    zero_one = F.col("is_numeric") & F.col("min_value").isin(0.0, 1.0) & F.col("max_value").isin(0.0, 1.0) & (F.col("decimals") == 0)
    boolean = (unique <= 3) & (F.coalesce(F.col("in_boolean_set"), F.lit(False)) | F.coalesce(zero_one, F.lit(False))
                               | (F.col("type_name") == "boolean"))
    category = (unique <= MAX_CATEGORIES) & (ratio <= 0.5)
    varied = ((ratio > 0.5) | (unique > MAX_CATEGORIES)) & ((zero("sem_blank") > 0.5) | (zero("avg_length") > 10))
    dates = F.greatest(zero("sem_iso"), zero("sem_date"))
    chosen = _pick(
        (F.col("row_count") == 0, "empty", 1.0, None),
        (F.col("null_pct") >= EMPTY_SHARE, "empty", F.least(F.lit(1.0), F.col("null_pct") + 0.05), None),
        _pattern_case("url", zero("sem_url"), 0.9),
        (F.col("is_temporal"), "datetime", 0.98, None),
        _pattern_case("datetime", dates, 0.9),
        _pattern_case("email", zero("sem_email"), 0.9),
        _pattern_case("phone", zero("sem_phone"), 0.85),
        (has & (identifier > 0), "identifier", identifier, None),
        (has & boolean, "boolean", 0.95, None),
        (F.col("is_numeric"), "numeric", 0.95, None),
        (zero("sem_number") >= HIGH_SHARE, "numeric", zero("sem_number"), None),
        (has & category, "categorical", F.greatest(F.lit(0.6), 0.85 - ratio * 0.3), None),
        (has & varied, "text", 0.8, None),
        (has & named(*K.NAME_HINTS["text"]) & (zero("avg_length") > 3), "text", 0.75, None),
        (F.lit(True), "text", 0.5, None),
    )
    return profile.withColumn("__s", chosen).withColumns(
        {"semantic_type": F.col("__s.semantic_type"), "type_confidence": F.col("__s.confidence")}).drop("__s")


def column_classes(profile: DataFrame) -> DataFrame:
    """Second detector: about twenty classes, each with a suggested action."""
    low, high, unique, rows = F.col("min_value"), F.col("max_value"), F.col("unique_count"), F.col("row_count")
    number, text = F.col("is_numeric"), F.col("is_string")
    alt = {n: zero(f"alt_{n}") for n in [*K.SECOND_PATTERNS, "email"]}
    booleans = F.greatest(*[alt[n] for n in ("boolean_tf", "boolean_yn", "boolean_01", "boolean_onoff")])
    dates = F.greatest(*[alt[n] for n in ("iso_datetime", "us_date", "eu_date", "named_date")])
    ratio = unique / rows
    length = zero("trimmed_length")
    chosen = _pick(
        (F.col("present") == 0, "empty", 1.0, "drop_column"),
        (number & low.between(1900, 2100) & high.between(1900, 2100) & (unique <= 200), "year", 0.85, "keep_as_is"),
        (number & (low >= 0) & (high <= 1), "ratio", 0.7, "keep_as_is"),
        (number & (low >= 0) & (high <= 100), "percentage_numeric", 0.6, "keep_as_is"),
        (number & (F.abs(zero("skewness")) > 2) & (low > 0), "skewed_positive_numeric", 0.8, "log_transform"),
        (number, "numeric", 0.9, "standard_scale"),
        (F.col("is_temporal"), "datetime", 1.0, "datetime_extract_year"),
        (alt["currency"] > 0.8, "currency", alt["currency"], "currency_normalize"),
        (alt["percentage"] > 0.8, "percentage", alt["percentage"], "percentage_to_decimal"),
        (alt["numeric_string"] > 0.8, "numeric_string", alt["numeric_string"], "parse_numeric"),
        ((booleans > 0.8) & (unique <= 3), "boolean_like", booleans, "parse_boolean"),
        (dates > 0.7, "datetime_like", dates, "parse_datetime"),
        (alt["email"] > 0.8, "email", alt["email"], "email_validate"),
        (alt["phone"] > 0.8, "phone", alt["phone"], "phone_standardize"),
        (alt["url"] > 0.8, "url", alt["url"], "url_parse"),
        (zero("sem_uuid") > 0.8, "uuid", zero("sem_uuid"), "keep_as_is"),
        (text & (ratio > 0.9) & (length > 10), "high_cardinality_identifier", 0.8, "hash_encode"),
        (text & (unique > 50) & (ratio > 0.3), "high_cardinality_categorical", 0.75, "frequency_encode"),
        (text & (length > 50), "text", 0.8, "text_vectorize_tfidf"),
        (text & (unique < 10), "categorical", 0.85, "onehot_encode"),
        (text & (unique < 50), "categorical", 0.85, "label_encode"),
        (F.lit(True), "unknown", 0.5, "keep_as_is"),
    )
    return profile.withColumn("__s", chosen).withColumns(
        {"column_class": F.col("__s.semantic_type"), "class_confidence": F.col("__s.confidence"), "suggested_action": F.col("__s.action")}
    ).drop("__s")


def _excluded_name() -> Column:
    name = F.lower("column_name")
    edges = [name.startswith(w) | name.endswith(f"_{w}") for w in K.TARGET_EXCLUSIONS]
    return S.any_of(edges) | named(*K.TARGET_EXCLUSIONS_ANYWHERE)


def _exact_name() -> Column:
    bare = [w.replace("_", "") for w in K.EXACT_TARGETS]
    name = F.trim(F.lower("column_name"))
    return name.isin(*K.EXACT_TARGETS) | F.regexp_replace(name, "[_ -]", "").isin(*bare)


def _target_statistics() -> Column:
    """How much the values look like a target; null when they do not."""
    present, unique = F.col("present"), F.col("unique_count")
    ratio = S.safe_ratio(unique.cast("double"), present)
    zero_one = F.col("is_numeric") & (F.col("min_value") == 0) & (F.col("max_value") == 1)
    cv = F.when((F.col("std") > 0) & (F.col("mean") != 0), F.col("std") / F.abs(F.col("mean")))
    return F.when(
        F.coalesce((unique == 2) & (zero_one | (F.col("is_string") & F.col("in_binary_set"))), F.lit(False)), 0.85
    ).when((unique > 2) & (unique <= 20) & (ratio < 0.1), 0.7).when(
        F.col("is_numeric") & (ratio > 0.5) & (cv > 0.1) & (cv < 5), 0.65)


def target_columns(profile: DataFrame, known_target: str | None = None) -> DataFrame:
    """Is each column a likely target: by name, by position and by statistics."""
    stats = _target_statistics()
    last = F.col("position") == F.max("position").over(W.partitionBy("table_name"))
    name_keyword = S.first_match([
        (named(w), 0.85 if w in K.STRONG_TARGET_KEYWORDS else 0.7) for w in K.TARGET_KEYWORDS], None)
    known = F.col("column_name") == known_target if known_target else F.lit(False)

    def outcome(is_target, confidence, method):
        value = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(is_target).alias("is_target"), value.alias("confidence"), F.lit(method).alias("method"))

    found = (
        F.when(known, outcome(True, 1.0, "user_specified"))
        .when(_excluded_name(), outcome(False, 0.95, "exclusion"))
        .when(_exact_name(), outcome(True, 0.95, "exact_name"))
        .when(name_keyword.isNotNull(), outcome(True, name_keyword, "keyword"))
        .when(last & stats.isNotNull(), outcome(True, stats * 0.8, "position_plus_stats"))
        .when(stats >= 0.8, outcome(True, stats * 0.6, "statistical"))
        .otherwise(outcome(False, 0.7, "no_match"))
    )
    return profile.withColumn("__t", found).withColumns({
        "is_target": F.col("__t.is_target"), "target_confidence": F.col("__t.confidence"), "target_method": F.col("__t.method")}).drop("__t")


def likely_targets(targets: DataFrame, floor: float = LIKELY_TARGET) -> DataFrame:
    return targets.where(F.col("is_target") & (F.col("target_confidence") >= floor)).select(
        "table_name", "column_name", "target_confidence", "target_method")


def protected_columns(targets: DataFrame) -> DataFrame:
    """Columns that must keep their values: likely targets and names that say so."""
    detected = F.col("is_target") & (F.col("target_confidence") >= LIKELY_TARGET)
    return targets.withColumn("is_protected", detected | named(*K.PROTECTED_KEYWORDS))
