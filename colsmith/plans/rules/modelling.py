"""Rule families for feature engineering, leakage, categories, time series and selection.

Fixed values: (name, action, priority, confidence, condition), see ``core``.
"""


def feature_engineering(n, d):
    return [
        ("FE_INTERACTION_HIGH_CORRELATION", "interaction_features", 75, "0.96", "is_numeric AND target_available AND abs(correlation_with_target) > 0.5 AND unique_ratio > 0.05"),
        ("FE_BINNING_BIMODAL", "binning_equal_freq", 78, "0.93", "is_numeric AND is_bimodal AND unique_count > 20"),
        ("FE_BINNING_HIGH_KURTOSIS", "binning_equal_freq", 77, "0.92", "is_numeric AND kurtosis > 5.0 AND skewness > 2.0"),
        ("FE_POLYNOMIAL_STRONG_SIGNAL", "polynomial_features", 76, "0.91", "is_numeric AND target_available AND abs(correlation_with_target) > 0.7"),
        ("FE_CYCLIC_TIME", "cyclic_time_encode", 88, "0.92", "is_temporal OR matches_iso_datetime > 0.9"),
        ("FE_TEXT_TFIDF", "text_vectorize_tfidf", 89, "0.96", "is_text AND avg_length > 20 AND avg_length < 500 AND unique_ratio > 0.5"),
        ("FE_GEO_CLUSTER", "geo_cluster_kmeans", 90, "0.95", f"is_numeric AND ((min_value >= -90 AND max_value <= 90 AND {n('lat')}) OR (min_value >= -180 AND max_value <= 180 AND {n('lon')}))"),
    ]


def leakage(n, d):
    return [
        ("LEAKAGE_PERFECT_CORRELATION", "drop_column", 99, "0.98", "target_available AND abs(correlation_with_target) > 0.99"),
        ("LEAKAGE_CONSTANT_COLUMN", "drop_column", 99, "0.99", "unique_count = 1"),
        ("LEAKAGE_NEAR_CONSTANT", "drop_column", 98, "0.95", "unique_count > 1 AND unique_ratio < 0.01"),
        ("LEAKAGE_UNIQUE_ID", "drop_column", 97, "0.96", f"unique_ratio > 0.98 AND row_count > 100 AND (is_primary_key OR {n('id', 'key', 'uuid', 'guid')})"),
        ("LEAKAGE_DUPLICATE_COLUMN", "drop_column", 96, "0.92", "duplicate_ratio > 0.95 AND row_count > 50"),
    ]


def category_choices(n, d):
    return [
        ("CAT_RARE_CONSOLIDATION", "frequency_encode", 82, "0.88", "is_categorical AND cardinality > 10 AND cardinality < 100 AND entropy > 0.7"),
        ("CAT_VERY_HIGH_CARDINALITY", "hash_encode", 90, "0.94", "is_categorical AND cardinality > 1000"),
        ("CAT_BINARY", "label_encode", 92, "0.95", "is_categorical AND cardinality = 2"),
        ("CAT_TARGET_ENCODE", "target_encode", 85, "0.89", "is_categorical AND target_available AND cardinality BETWEEN 3 AND 50"),
        ("CAT_ONEHOT_MEDIUM", "onehot_encode", 88, "0.91", "is_categorical AND NOT target_available AND cardinality BETWEEN 3 AND 10"),
        ("CAT_ORDINAL_DETECTED", "label_encode", 91, "0.93", "is_categorical AND is_ordinal"),
        ("CAT_IMBALANCED", "frequency_encode", 83, "0.86", "is_categorical AND entropy < 0.5 AND cardinality > 2"),
        ("CAT_TEXT_LIKE", "hash_encode", 84, "0.87", "is_categorical AND avg_length > 20 AND cardinality > 50"),
        ("CAT_SPECIAL_CHARS", "hash_encode", 81, "0.85", "is_categorical AND has_special_chars AND cardinality > 20"),
        ("CAT_VERY_LOW_CARDINALITY", "onehot_encode", 89, "0.94", "is_categorical AND cardinality < 3"),
    ]


def time_series(n, d):
    return [
        ("TS_HIGH_AUTOCORRELATION", "cyclic_time_encode", 87, "0.93", "is_temporal AND unique_ratio > 0.5"),
        ("TS_DATE_PATTERN", "cyclic_time_encode", 86, "0.91", "matches_date_pattern > date_share_floor AND NOT is_temporal"),
        ("TS_UNIX_TIMESTAMP", "cyclic_time_encode", 85, "0.89", "is_numeric AND min_value > 1000000000 AND max_value < 2000000000"),
        ("TS_ISO_DATETIME", "cyclic_time_encode", 88, "0.95", "matches_iso_datetime > date_share_floor"),
        ("TS_SEQUENTIAL_INDEX", "keep_as_is", 80, "0.84", "is_numeric AND is_smooth AND unique_ratio > 0.95"),
        ("TS_CYCLIC_COMPONENT", "cyclic_time_encode", 89, "0.92", f"is_numeric AND {n('month', 'day', 'hour', 'minute', 'weekday')} AND min_value >= 0 AND {d('max_value', 100)} <= 60"),
        ("TS_YEAR_COLUMN", "standard_scale", 84, "0.9", f"is_numeric AND {n('year')} AND min_value > 1900 AND {d('max_value', 3000)} < 2100"),
        ("TS_DURATION", "log_transform", 82, "0.87", f"is_numeric AND {n('duration', 'elapsed', 'time_diff')} AND skewness > 2.0"),
    ]


def imbalance(n, d):
    return [
        ("IMBALANCE_SEVERE", "keep_as_is", 93, "0.88", "is_categorical AND entropy < 0.3 AND cardinality = 2"),
        ("IMBALANCE_MODERATE", "keep_as_is", 91, "0.85", "is_categorical AND entropy >= 0.3 AND entropy < 0.6 AND cardinality <= 5"),
        ("IMBALANCE_RARE_CLASS", "frequency_encode", 84, "0.86", "is_categorical AND unique_ratio < 0.01 AND cardinality > 10"),
        ("IMBALANCE_MULTICLASS", "frequency_encode", 82, "0.83", "is_categorical AND cardinality > 5 AND entropy < 0.7"),
        ("IMBALANCE_BINARY_EXTREME", "keep_as_is", 94, "0.9", "is_categorical AND cardinality = 2 AND entropy < 0.2"),
    ]


def missing_data(n, d):
    return [
        ("MISSING_HIGH", "drop_column", 95, "0.92", "null_pct > 0.5"),
        ("MISSING_PATTERN", "fill_null_mode", 88, "0.87", "null_pct > 0.1 AND null_pct <= 0.5 AND null_has_pattern"),
        ("MISSING_LOW_NUMERIC", "fill_null_mean", 86, "0.89", "is_numeric AND null_pct > 0 AND null_pct <= 0.1 AND abs(skewness) < 1.0"),
        ("MISSING_LOW_SKEWED", "fill_null_median", 87, "0.9", "is_numeric AND null_pct > 0 AND null_pct <= 0.1 AND abs(skewness) >= 1.0"),
        ("MISSING_LOW_CATEGORICAL", "fill_null_mode", 88, "0.91", "is_categorical AND null_pct > 0 AND null_pct <= 0.1"),
        ("MISSING_INDICATOR", "keep_as_is", 83, "0.84", "null_pct > 0.1 AND null_pct <= 0.3 AND target_available"),
    ]


def collinearity(n, d):
    return [
        ("MULTICOL_PERFECT", "drop_column", 97, "0.96", "duplicate_ratio > 0.99"),
        ("MULTICOL_VERY_HIGH", "keep_as_is", 90, "0.88", "is_numeric AND duplicate_ratio > 0.95"),
        ("MULTICOL_LOW_VARIANCE", "drop_column", 92, "0.91", f"is_numeric AND {d('cv', 1.0)} < 0.01 AND unique_ratio < 0.1"),
        ("MULTICOL_CONSTANT_GROUPBY", "drop_column", 91, "0.89", "unique_count < 5 AND duplicate_ratio > 0.8"),
    ]


def anomalies(n, d):
    return [
        ("STAT_EXTREME_OUTLIERS", "clip_outliers", 81, "0.87", "is_numeric AND outlier_pct > 0.1 AND has_outliers"),
        ("STAT_HEAVY_TAILS", "yeo_johnson", 83, "0.88", "is_numeric AND kurtosis > 10.0"),
        ("STAT_EXTREME_SKEW", "log_transform", 85, "0.9", "is_numeric AND abs(skewness) > 5.0 AND all_positive"),
        ("STAT_BIMODAL_CLEAR", "binning_equal_freq", 84, "0.89", "is_numeric AND is_bimodal AND unique_count > 50"),
        ("STAT_ZERO_INFLATED", "yeo_johnson", 82, "0.86", "is_numeric AND has_zeros AND null_pct < 0.1"),
        ("STAT_UNIFORM", "keep_as_is", 80, "0.85", "is_numeric AND abs(skewness) < 0.1 AND abs(kurtosis) < 0.1"),
        ("STAT_HIGH_CV", "robust_scale", 81, "0.87", "is_numeric AND cv > 2.0"),
        ("STAT_LOW_ENTROPY", "label_encode", 79, "0.84", "is_categorical AND entropy < 0.4 AND cardinality > 2"),
        ("STAT_HIGH_ENTROPY", "hash_encode", 80, "0.86", "is_categorical AND entropy > 0.9 AND cardinality > 50"),
        ("STAT_SMOOTH_CONTINUOUS", "standard_scale", 83, "0.88", "is_numeric AND is_smooth AND unique_ratio > 0.8"),
    ]


def selection(n, d):
    return [
        ("FEATSEL_TOO_MANY_FEATURES", "keep_as_is", 89, "0.87", "row_count < 100 AND is_numeric"),
        ("FEATSEL_LOW_VARIANCE", "drop_column", 94, "0.93", f"is_numeric AND {d('std', 1.0)} < 0.001 AND unique_count < 3"),
        ("FEATSEL_ZERO_CORRELATION", "keep_as_is", 78, "0.84", "target_available AND abs(correlation_with_target) < 0.01"),
        ("FEATSEL_REDUNDANT", "keep_as_is", 85, "0.86", "is_numeric AND duplicate_ratio > 0.9"),
        ("FEATSEL_SPARSE", "keep_as_is", 80, "0.83", "is_numeric AND has_zeros AND null_pct < 0.1"),
        ("FEATSEL_HIGH_CARD_LOW_FREQ", "hash_encode", 83, "0.88", "is_categorical AND cardinality > 100 AND entropy > 0.8"),
        ("FEATSEL_CONSTANT_GROUPS", "drop_column", 91, "0.9", "unique_count < 3 AND row_count > 100"),
        ("FEATSEL_SUBSET_MISSING", "drop_column", 95, "0.94", "null_pct > 0.8"),
        ("FEATSEL_SINGLE_VALUE_ENCODED", "drop_column", 99, "0.98", "unique_count = 1 AND null_pct = 0"),
        ("FEATSEL_NULL_AND_ONE", "drop_column", 93, "0.92", "unique_count <= 2 AND null_pct > 0.3"),
    ]


def dimensions(n, d):
    return [
        ("DIMRED_MANY_CORRELATED", "standard_scale", 77, "0.82", "is_numeric AND duplicate_ratio > 0.7"),
        ("DIMRED_WIDE_DATASET", "standard_scale", 84, "0.85", "is_numeric AND row_count < 50"),
        ("DIMRED_HIGH_DIM_CAT", "hash_encode", 86, "0.89", "is_categorical AND cardinality > 500"),
        ("DIMRED_TEXT_HIGH_VOCAB", "text_vectorize_tfidf", 82, "0.87", "is_text AND unique_ratio > 0.8 AND avg_length > 50"),
        ("DIMRED_SPARSE_FEATURES", "keep_as_is", 76, "0.81", "is_numeric AND has_zeros AND unique_ratio < 0.3"),
        ("DIMRED_MULTICOLLINEAR", "standard_scale", 81, "0.84", "is_numeric AND duplicate_ratio > 0.85"),
        ("DIMRED_IMAGE_LIKE", "keep_as_is", 75, "0.78", f"is_numeric AND {d('min_value', -1)} >= 0 AND {d('max_value', 300)} <= 255 AND unique_count > 50"),
        ("DIMRED_MANY_LAGS", "standard_scale", 77, "0.8", f"is_numeric AND is_smooth AND {n('lag', 'rolling', 'window')}"),
        ("DIMRED_ONEHOT_EXPLOSION", "hash_encode", 83, "0.86", "is_categorical AND cardinality > 50 AND cardinality < 500"),
        ("DIMRED_READY_FOR_PCA", "standard_scale", 79, "0.88", f"is_numeric AND is_already_scaled AND abs({d('mean', 100)}) < 1.0 AND abs(std - 1.0) < 0.2"),
    ]
