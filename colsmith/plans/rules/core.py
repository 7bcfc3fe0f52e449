"""Rule families: data quality, type detection, statistics, categories, contact and money formats.

Fixed values: (name, action, priority, confidence, condition). Conditions and confidences are SQL
over the rule statistics; ``n`` tests the column name, ``d`` gives a default for missing numbers.
"""


def data_quality(n, d):
    return [
        ("DROP_IF_MOSTLY_NULL", "drop_column", 150, "CASE WHEN null_pct >= 0.95 THEN 0.95 ELSE least(0.75, null_pct / 0.8 * 0.7) END", "null_pct > 0.8 OR unique_count = 0"),
        ("DROP_IF_CONSTANT", "drop_column", 95, "0.75", "unique_count = 1 AND null_pct < 0.5"),
        ("DROP_IF_ALL_UNIQUE", "drop_column", 90, "0.65", "unique_ratio > 0.995 AND row_count > 1000 AND NOT is_numeric AND avg_length > 20 AND NOT is_primary_key"),
        ("REMOVE_DUPLICATES", "remove_duplicates", 85, "least(0.85, 0.6 + duplicate_ratio * 0.25)", "duplicate_ratio > 0.7 AND unique_ratio < 0.1 AND NOT is_categorical AND row_count > 100"),
        ("CONSERVATIVE_FALLBACK", "keep_as_is", 200, "0.5", "null_pct < 0.3 AND unique_count > 1 AND unique_ratio < 0.99"),
        ("KEEP_IF_PRIMARY_KEY", "keep_as_is", 145, "0.95", "unique_ratio > 0.95 AND null_pct < 0.05 AND unique_count > 10"),
        ("KEEP_IF_ORDINAL_OR_YEAR", "keep_as_is", 140, "0.6", f"is_numeric AND ((min_value >= 1900 AND max_value <= 2100 AND unique_count <= 200) OR (unique_count <= 10 AND {d('max_value', 100)} <= 10)) AND null_pct < 0.1"),
        ("KEEP_IF_ALREADY_NORMALIZED", "keep_as_is", 95, "0.92", f"is_numeric AND null_pct < 0.05 AND {d('mean', 100)} BETWEEN -0.5 AND 0.5 AND std BETWEEN 0.8 AND 1.2 AND abs(skewness) < 0.5"),
        ("KEEP_IF_GOOD_DISTRIBUTION", "keep_as_is", 92, "0.6", f"is_numeric AND null_pct < 0.05 AND abs(skewness) < 1.0 AND NOT has_outliers AND {d('cv', 100)} < 2.0"),
        ("KEEP_IF_CATEGORICAL_CLEAN", "keep_as_is", 90, "0.85", "is_categorical AND null_pct < 0.05 AND unique_count BETWEEN 2 AND 50 AND unique_ratio < 0.8"),
        ("KEEP_IF_NO_QUALITY_ISSUES", "keep_as_is", 88, "0.55", "null_pct = 0 AND unique_ratio > 0.05 AND unique_ratio < 0.95 AND NOT has_outliers"),
        ("FILL_NULL_MEDIAN_NUMERIC", "fill_null_median", 70, "0.85", "is_numeric AND null_pct > 0.05 AND null_pct < 0.3 AND has_outliers"),
        ("FILL_NULL_MEAN_NUMERIC", "fill_null_mean", 75, "0.9", "is_numeric AND null_pct > 0.05 AND null_pct < 0.3 AND NOT has_outliers AND abs(skewness) < 1.0"),
        ("FILL_NULL_MODE_CATEGORICAL", "fill_null_mode", 75, "0.85", "is_categorical AND null_pct > 0.05 AND null_pct < 0.3"),
        ("FILL_NULL_FORWARD_TIMESERIES", "fill_null_forward", 80, "0.88", "is_temporal AND null_pct < 0.2"),
        ("FILL_NULL_INTERPOLATE_SMOOTH", "fill_null_interpolate", 72, "0.82", "is_numeric AND is_smooth AND null_pct < 0.15"),
        ("DROP_IF_HIGH_NULL_NO_PATTERN", "drop_column", 80, "0.75", "null_pct > 0.4 AND null_pct <= 0.6 AND NOT null_has_pattern"),
        ("KEEP_IF_LOW_NULL_GOOD_QUALITY", "keep_as_is", 50, "0.7", "null_pct < 0.05 AND unique_ratio > 0.1 AND unique_ratio < 0.9"),
    ]


def type_detection(n, d):
    return [
        ("PARSE_DATETIME_ISO", "parse_datetime", 95, "least(0.98, matches_iso_datetime)", "is_string AND matches_iso_datetime > 0.8"),
        ("PARSE_DATETIME_COMMON", "parse_datetime", 90, "least(0.95, matches_date_pattern)", "is_string AND matches_date_pattern > 0.85"),
        ("PARSE_BOOLEAN_TF", "parse_boolean", 95, "0.98", "unique_count <= 3 AND matches_boolean_tf > 0.9"),
        ("PARSE_BOOLEAN_YN", "parse_boolean", 95, "0.98", "unique_count <= 3 AND matches_boolean_yn > 0.9"),
        ("PARSE_BOOLEAN_01", "parse_boolean", 85, "0.85", "unique_count <= 3 AND matches_boolean_01 > 0.9 AND NOT looks_like_categorical_code"),
        ("PARSE_NUMERIC_STRING", "parse_numeric", 90, "least(0.95, matches_numeric_pattern)", "is_string AND matches_numeric_pattern > 0.9"),
        ("PARSE_JSON_STRUCTURE", "parse_json", 88, "least(0.92, matches_json)", "is_string AND matches_json > 0.85"),
        ("PARSE_CATEGORICAL_LOW_CARDINALITY", "parse_categorical", 70, "0.88", "is_string AND cardinality < 50 AND unique_ratio < 0.5"),
    ]


def statistical(n, d):
    return [
        ("LOG_TRANSFORM_HIGH_SKEW", "log_transform", 85, "least(0.95, 0.7 + (skewness - 2.0) * 0.05)", "is_numeric AND skewness > 2.0 AND all_positive AND min_value > 0 AND range_size > 100"),
        ("LOG1P_TRANSFORM_WITH_ZEROS", "log1p_transform", 87, "0.92", f"is_numeric AND skewness > 2.0 AND {d('min_value', -1)} >= 0 AND has_zeros AND range_size > 100"),
        ("BOX_COX_MODERATE_SKEW", "box_cox", 80, "0.88", "is_numeric AND skewness > 1.5 AND skewness < 2.0 AND all_positive AND min_value > 0"),
        ("YEO_JOHNSON_NEGATIVE_VALUES", "yeo_johnson", 80, "0.85", "is_numeric AND abs(skewness) > 1.5 AND NOT all_positive"),
        ("CLIP_OUTLIERS_HIGH_PERCENTAGE", "clip_outliers", 75, "least(0.9, 0.6 + outlier_pct * 0.3)", "is_numeric AND outlier_pct > 0.1"),
        ("WINSORIZE_MODERATE_OUTLIERS", "winsorize", 78, "0.85", "is_numeric AND outlier_pct > 0.05 AND outlier_pct <= 0.1"),
        ("STANDARD_SCALE_NORMAL", "standard_scale", 70, "0.9", "is_numeric AND abs(skewness) < 0.5 AND outlier_pct < 0.05 AND NOT is_already_scaled"),
        ("ROBUST_SCALE_WITH_OUTLIERS", "robust_scale", 75, "0.92", "is_numeric AND outlier_pct >= 0.05 AND outlier_pct < 0.1 AND NOT is_already_scaled"),
        ("MINMAX_SCALE_BOUNDED", "minmax_scale", 72, "0.85", "is_numeric AND has_natural_bounds AND outlier_pct < 0.02"),
        ("QUANTILE_TRANSFORM_BIMODAL", "quantile_transform", 70, "0.8", "is_numeric AND is_bimodal"),
    ]


def categorical(n, d):
    return [
        ("ONEHOT_LOW_CARDINALITY", "onehot_encode", 85, "0.95", "is_categorical AND cardinality < 10 AND NOT is_ordinal AND null_pct < 0.8"),
        ("ONEHOT_VERY_LOW_CARDINALITY", "onehot_encode", 90, "0.98", "is_categorical AND cardinality <= 5 AND null_pct < 0.8"),
        ("TARGET_ENCODE_HIGH_CARDINALITY", "target_encode", 80, "0.88", "is_categorical AND cardinality > 50 AND target_available"),
        ("ORDINAL_ENCODE_DETECTED", "ordinal_encode", 92, "0.95", "is_categorical AND is_ordinal"),
        ("FREQUENCY_ENCODE_MEDIUM_CARDINALITY", "frequency_encode", 75, "0.82", "is_categorical AND cardinality BETWEEN 10 AND 50 AND NOT target_available"),
    ]


def formats(n, d):
    return [
        ("CURRENCY_NORMALIZE", "currency_normalize", 95, "least(0.95, matches_currency_pattern)", "has_currency_symbols AND matches_currency_pattern > 0.8"),
        ("PERCENTAGE_TO_DECIMAL", "percentage_to_decimal", 90, "CASE WHEN has_percentage_symbol THEN 0.92 ELSE 0.75 END", f"has_percentage_symbol OR (is_numeric AND {d('min_value', -1)} >= 0 AND {d('max_value', 200)} <= 100 AND looks_like_percentage)"),
        ("PHONE_STANDARDIZE", "phone_standardize", 92, "least(0.95, matches_phone_pattern)", "matches_phone_pattern > 0.85"),
        ("EMAIL_VALIDATE", "email_validate", 92, "least(0.95, matches_email_pattern)", "matches_email_pattern > 0.85"),
        ("URL_PARSE", "url_parse", 90, "least(0.95, matches_url_pattern)", "matches_url_pattern > 0.85"),
        ("TEXT_CLEAN_MESSY", "text_clean", 70, "0.85", "is_text AND (has_extra_whitespace OR has_special_chars)"),
    ]
