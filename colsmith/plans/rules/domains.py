"""Rule families for special types, business metrics, composites and domains.

Fixed values: (name, action, priority, confidence, condition), see ``core``.
"""


def coordinate(low, high):
    """Values that fill more than a tenth of a coordinate range."""
    return f"(min_value >= {low} AND max_value <= {high} AND max_value - min_value > {0.1 * (high - low)})"


ID_NAME = ("(name = 'id' OR right(name, 3) = '_id' OR right(name, 4) = '_key' OR left(name, 3) = 'pk_' OR left(name, 4) = 'uuid' "
           "OR left(name, 4) = 'guid' OR contains(name, 'identifier') OR name = 'key')")
TARGET_NAME = "name IN ('y', 'class', 'label', 'target')"


def special_types(n, d):
    return [
        ("DETECT_UUID_DROP", "drop_column", 93, "0.93", f"is_string AND unique_ratio > 0.95 AND {n('uuid', 'guid', 'unique_id', 'identifier')}"),
        ("DETECT_IP_ADDRESS", "hash_encode", 91, "0.91", f"is_string AND {n('ip', 'ip_address', 'ipv4', 'ipv6', 'ip_addr')}"),
        ("DETECT_LATITUDE", "keep_as_is", 92, f"CASE WHEN {n('lat', 'latitude')} THEN 0.94 ELSE 0.82 END", f"is_numeric AND {d('min_value', -1000)} >= -90 AND {d('max_value', 1000)} <= 90 AND ({n('lat', 'latitude')} OR {coordinate(-90, 90)})"),
        ("DETECT_LONGITUDE", "keep_as_is", 92, f"CASE WHEN {n('lon', 'lng', 'longitude')} THEN 0.94 ELSE 0.82 END", f"is_numeric AND {d('min_value', -1000)} >= -180 AND {d('max_value', 1000)} <= 180 AND ({n('lon', 'lng', 'longitude')} OR {coordinate(-180, 180)})"),
        ("DETECT_HASH_DROP", "drop_column", 91, "0.91", f"is_string AND unique_ratio > 0.95 AND {n('hash', 'md5', 'sha', 'checksum', 'digest')}"),
        ("DETECT_HEXADECIMAL", "parse_numeric", 87, "0.87", f"is_string AND {n('hex', 'hexadecimal', '0x')}"),
        ("DETECT_SCIENTIFIC_NOTATION", "parse_numeric", 94, "0.94", f"is_string AND {n('scientific', 'exp')}"),
        ("DETECT_EPOCH_TIMESTAMP", "parse_datetime", 89, "0.89", "is_numeric AND min_value > 1000000000 AND min_value < 2000000000 AND max_value > 1000000000 AND max_value < 2000000000"),
        ("DETECT_BASE64_DROP", "drop_column", 85, "0.85", f"is_string AND {n('base64', 'encoded', 'b64')}"),
        ("DETECT_FILE_PATH_DROP", "drop_column", 86, "0.86", f"is_string AND {n('path', 'file_path', 'filepath', 'directory', 'folder')}"),
        ("DETECT_SEMANTIC_VERSION", "ordinal_encode", 88, "0.88", f"is_string AND {n('version', 'ver', 'release', 'build')}"),
        ("DETECT_COUNTRY_CODE", "onehot_encode", 90, "0.9", f"is_categorical AND cardinality <= 250 AND {n('country', 'country_code', 'iso_country', 'nation')}"),
        ("DETECT_CURRENCY_CODE", "onehot_encode", 89, "0.89", f"is_categorical AND cardinality <= 200 AND {n('currency', 'currency_code', 'iso_currency')}"),
        ("DETECT_MAC_ADDRESS_HASH", "hash_encode", 92, "0.92", f"is_string AND {n('mac', 'mac_address', 'hardware_addr')}"),
        ("DETECT_COLOR_CODE", "hash_encode", 84, "0.84", f"is_string AND {n('color', 'colour', 'rgb', 'hex_color')}"),
        ("DETECT_CREDIT_CARD_DROP", "drop_column", 98, "0.98", f"(is_string OR is_numeric) AND ({n('card', 'credit_card', 'cc_number', 'card_num', 'pan')} OR (is_numeric AND min_value >= 1000000000000 AND max_value < 10000000000000000000))"),
        ("DETECT_PHONE_HASH", "hash_encode", 90, "0.9", f"is_string AND matches_phone_pattern > 0.7 AND {n('phone', 'mobile', 'tel', 'cell')}"),
        ("DETECT_ERROR_CODE_CATEGORICAL", "onehot_encode", 86, "0.86", f"is_categorical AND cardinality < 100 AND {n('error', 'status', 'code', 'return_code', 'http_status')}"),
        ("DETECT_BITMAP", "keep_as_is", 81, "0.81", f"is_numeric AND {n('flag', 'flags', 'bitmap', 'bit_', 'mask')}"),
        ("DETECT_ICD10_CODE", "hash_encode", 87, "0.87", f"is_string AND {n('icd', 'icd10', 'diagnosis_code', 'condition_code')}"),
    ]


def business_metrics(n, d):
    return [
        ("DOMAIN_RATE_RATIO_KEEP", "keep_as_is", 91, "0.91", f"is_numeric AND has_range AND min_value >= 0 AND max_value <= 100 AND {n('rate', 'ratio', 'percentage', 'pct', 'percent', '_pct', 'bounce_rate', 'conversion')}"),
        ("DOMAIN_COUNT_LOG_TRANSFORM", "log1p_transform", 89, "0.89", f"is_numeric AND has_range AND min_value >= 0 AND skewness > 1.5 AND {n('count', 'frequency', 'num_', 'total_', '_count', 'quantity', 'reviews', 'likes', 'views', 'clicks', 'impressions')}"),
        ("DOMAIN_REVENUE_ROBUST_SCALE", "robust_scale", 88, "0.88", f"is_numeric AND cv > 1.0 AND {n('revenue', 'amount', 'sales', 'price', 'cost', 'value', 'spend')}"),
        ("DOMAIN_DURATION_LOG_TRANSFORM", "log1p_transform", 90, "0.9", f"is_numeric AND has_range AND min_value >= 0 AND skewness > 2.0 AND {n('duration', 'time', '_ms', '_seconds', 'latency', 'elapsed', 'session_time')}"),
        ("DOMAIN_SCORE_KEEP", "keep_as_is", 87, "0.87", f"is_numeric AND abs(skewness) < 0.8 AND NOT has_outliers AND {n('score', 'rating', 'grade', 'rank')}"),
        ("DOMAIN_ID_COLUMN_DROP", "drop_column", 94, "0.94", f"unique_ratio > 0.95 AND {ID_NAME}"),
        ("DOMAIN_KEY_HASH_ENCODE", "hash_encode", 86, "0.86", f"cardinality > 50 AND unique_ratio < 0.95 AND {n('_key', 'fk_', 'foreign_key', 'ref_id')}"),
        ("DOMAIN_UTM_HASH_ENCODE", "hash_encode", 89, "0.89", f"is_categorical AND {n('utm_', 'campaign', 'source', 'medium', 'referrer')}"),
        ("DOMAIN_USER_AGENT_DROP", "drop_column", 83, "0.83", f"is_string AND unique_ratio > 0.5 AND {n('user_agent', 'useragent', 'browser_string')}"),
        ("DOMAIN_SESSION_ID_DROP", "drop_column", 92, "0.92", f"unique_ratio > 0.9 AND {n('session_id', 'sessionid', 'visit_id')}"),
        ("DOMAIN_TEMPERATURE_KEEP", "keep_as_is", 85, "0.85", f"is_numeric AND has_range AND min_value > -100 AND min_value < max_value AND max_value < 200 AND {n('temp', 'temperature', '_celsius', '_fahrenheit', '_kelvin')}"),
        ("DOMAIN_SENSOR_SMOOTH", "robust_scale", 84, "0.84", f"is_numeric AND has_outliers AND {n('sensor', 'reading', 'measurement', 'vibration', 'pressure', 'voltage')}"),
        ("DOMAIN_MEDICAL_MEASUREMENT_KEEP", "keep_as_is", 88, "0.88", f"is_numeric AND has_natural_bounds AND {n('blood_pressure', 'glucose', 'heart_rate', 'bmi', 'cholesterol', 'hba1c')}"),
        ("DOMAIN_AGE_KEEP", "keep_as_is", 91, "0.91", f"is_numeric AND has_range AND min_value >= 0 AND max_value <= 120 AND abs(skewness) < 2.0 AND {n('age', 'patient_age', 'age_years')}"),
        ("DOMAIN_CODED_NULL_REPLACE", "fill_null_median", 87, "0.87", "is_numeric AND has_range AND (min_value IN (-999, -99, -9, -1) OR max_value IN (999, 9999, 99999))"),
        ("DOMAIN_FREE_TEXT_DROP", "drop_column", 80, "0.8", f"is_text AND unique_ratio > 0.7 AND {n('description', 'comment', 'notes', 'remarks', 'text', 'content', 'message')}"),
        ("DOMAIN_SIZE_ORDINAL", "ordinal_encode", 93, "0.93", f"is_categorical AND {n('size', 'sizes', 'shirt_size', 'clothing_size')}"),
        ("DOMAIN_PRIORITY_ORDINAL", "ordinal_encode", 92, "0.92", f"is_categorical AND {n('priority', 'severity', 'urgency', 'level', 'tier')}"),
    ]


def composites(n, d):
    return [
        ("PRESERVE_TARGET_COLUMN", "keep_as_is", 98, "0.99", f"({TARGET_NAME} OR {n('target', 'label', 'outcome', 'response', 'class_label', 'y_train', 'y_test')}) AND (entropy < 0.5 OR unique_ratio < 0.1)"),
        ("PRESERVE_IMBALANCED_BINARY_FLAGS", "keep_as_is", 97, "0.95", f"unique_count <= 3 AND entropy < 0.3 AND {n('flag', 'indicator', 'is_', 'has_', 'bool', 'binary')}"),
        ("HANDLE_IMBALANCED_CATEGORICAL", "frequency_encode", 96, "0.88", f"is_categorical AND entropy < 0.3 AND unique_ratio < 0.05 AND cardinality >= 5 AND NOT {n('target', 'label', 'class', 'y')}"),
        ("PRESERVE_IMBALANCED_NUMERIC", "keep_as_is", 96, "0.85", f"is_numeric AND entropy < 0.25 AND unique_ratio < 0.05 AND unique_count >= 5 AND NOT {n('target', 'label', 'class')}"),
        ("COMPOSITE_BIMODAL_MIXED_TYPE", "parse_categorical", 84, "0.84", "is_numeric AND kurtosis < -1.2 AND cardinality < 20 AND unique_ratio < 0.1"),
        ("COMPOSITE_NEAR_CONSTANT_RARE_EVENTS", "drop_column", 86, "0.86", f"unique_ratio < 0.02 AND row_count > 100 AND NOT {n('flag', 'indicator', 'is_', 'has_')}"),
        ("COMPOSITE_HIGH_CV_SMALL_RANGE", "standard_scale", 79, "0.79", f"is_numeric AND cv > 2.0 AND {d('range_size', 1000)} < 10 AND mean <> 0"),
        ("COMPOSITE_POSITIVE_ZEROS_SKEWED", "log1p_transform", 91, "0.91", "is_numeric AND has_range AND min_value >= 0 AND has_zeros AND skewness > 2.5 AND NOT is_already_scaled"),
        ("COMPOSITE_LOW_ENTROPY_DROP", "drop_column", 85, "0.85", "entropy < 0.2 AND unique_ratio < 0.05 AND row_count > 50"),
        ("COMPOSITE_NUMERIC_FEW_UNIQUE", "ordinal_encode", 83, "0.83", "is_numeric AND unique_count BETWEEN 2 AND 3 AND row_count > 50"),
        ("COMPOSITE_EXTREME_OUTLIERS", "winsorize", 87, "0.87", "is_numeric AND outlier_pct > 0.15 AND outlier_pct < 0.4"),
        ("COMPOSITE_SYMMETRIC_WITH_OUTLIERS", "robust_scale", 90, "0.9", "is_numeric AND abs(skewness) < 0.5 AND has_outliers AND outlier_pct > 0.05"),
        ("COMPOSITE_HIGH_CARD_NO_TARGET", "frequency_encode", 84, "0.84", "is_categorical AND cardinality > 50 AND cardinality <= 1000 AND NOT target_available"),
        ("COMPOSITE_VERY_HIGH_CARDINALITY", "hash_encode", 86, "0.86", "is_categorical AND cardinality > 1000 AND unique_ratio < 0.95"),
        ("COMPOSITE_MIXED_SIGN_SKEWED", "yeo_johnson", 88, "0.88", "is_numeric AND NOT all_positive AND abs(skewness) > 1.8 AND has_range AND min_value < 0"),
        ("COMPOSITE_PROBABILITY_RANGE", "keep_as_is", 90, "0.9", "is_numeric AND has_range AND min_value >= 0 AND max_value <= 1.0 AND max_value - min_value > 0.5"),
        ("COMPOSITE_STANDARDIZED_ORDINAL", "keep_as_is", 87, "0.87", "is_numeric AND has_range AND min_value >= -1 AND max_value <= 1 AND unique_count <= 5"),
        ("COMPOSITE_BORDERLINE_NULL", "fill_null_median", 72, "0.72", "is_numeric AND null_pct > 0.3 AND null_pct <= 0.4 AND null_has_pattern"),
        ("COMPOSITE_IMBALANCED_CATEGORICAL", "frequency_encode", 81, "0.81", "is_categorical AND entropy < 0.5 AND cardinality > 5 AND cardinality < 50"),
        ("COMPOSITE_ALREADY_Z_SCORED", "keep_as_is", 94, "0.94", f"is_numeric AND has_range AND min_value >= -3 AND max_value <= 3 AND abs({d('mean', 100)}) < 0.3 AND std BETWEEN 0.7 AND 1.3"),
        ("COMPOSITE_SPARSE_BINARY", "keep_as_is", 88, "0.88", "unique_count = 2 AND entropy < 0.3 AND has_range AND min_value >= 0"),
        ("COMPOSITE_TIMESTAMP_MS", "parse_datetime", 91, "0.91", f"is_numeric AND has_range AND min_value > 1000000000000 AND max_value < 2000000000000 AND {n('time', 'timestamp', 'created', 'updated', 'date')}"),
        ("COMPOSITE_NEGATIVE_ONLY", "robust_scale", 83, "0.83", f"is_numeric AND {d('max_value', 1)} < 0 AND row_count > 10"),
        ("COMPOSITE_PERFECT_CORRELATION", "drop_column", 96, "0.96", "target_available AND abs(target_correlation) > 0.99"),
    ]


def industry(n, d):
    return [
        ("FINANCE_CURRENCY_DETECTION", "text_clean", 50, "0.95", "is_string AND dpm_currency > 0.8"),
        ("FINANCE_ACCOUNT_NUMBER", "keep_as_is", 45, "0.9", f"is_string AND {n('account', 'acct_no', 'iban')} AND unique_ratio > 0.8"),
        ("FINANCE_STOCK_TICKER", "label_encode", 45, "0.85", f"is_string AND dpm_stock_ticker > 0.9 AND avg_length < 6 AND {n('ticker', 'symbol', 'stock')}"),
        ("FINANCE_CREDIT_CARD", "drop_column", 90, "0.98", "is_string AND dpm_credit_card > 0.5"),
        ("FINANCE_TAX_ID", "drop_column", 90, "0.98", "is_string AND (dpm_ssn > 0.5 OR dpm_ein > 0.5)"),
        ("FINANCE_IBAN", "keep_as_is", 45, "0.95", "is_string AND dpm_iban > 0.5"),
        ("FINANCE_SWIFT_CODE", "label_encode", 45, "0.9", "is_string AND dpm_swift > 0.5"),
        ("FINANCE_PERCENTAGE_RATE", "text_clean", 50, "0.95", "is_string AND dpm_percentage > 0.8"),
        ("FINANCE_AMOUNT_COLUMN", "log_transform", 40, "0.85", f"is_numeric AND {n('amount', 'balance', 'price', 'cost', 'revenue')} AND skewness > 3.0"),
        ("FINANCE_RATIO_DETECTION", "keep_as_is", 40, "0.85", f"is_numeric AND {n('ratio', 'margin', 'yield', 'roi', 'roe')} AND min_value >= -1 AND max_value <= 1"),
        ("HEALTH_ICD_CODE", "label_encode", 45, "0.9", "is_string AND dpm_icd_code > 0.5"),
        ("HEALTH_CPT_CODE", "label_encode", 45, "0.9", "is_string AND dpm_cpt_code > 0.5"),
        ("HEALTH_PATIENT_ID", "keep_as_is", 45, "0.95", f"is_string AND {n('patient', 'mrn', 'subject_id')} AND unique_ratio > 0.9"),
        ("HEALTH_MRN", "keep_as_is", 45, "0.95", f"is_string AND dpm_mrn > 0.8 AND {n('mrn')}"),
        ("HEALTH_DOB_VALIDATION", "datetime_extract_year", 45, "0.9", f"{n('date')} AND {n('dob', 'birth')}"),
        ("HEALTH_AGE_DETECTION", "binning_equal_freq", 40, "0.85", "is_numeric AND name = 'age' AND min_value >= 0 AND max_value <= 120"),
        ("HEALTH_VITAL_SIGNS", "standard_scale", 40, "0.85", f"is_numeric AND {n('bp', 'systolic', 'diastolic', 'heart_rate', 'pulse', 'bmi')}"),
        ("HEALTH_LAB_VALUES", "robust_scale", 40, "0.85", f"is_numeric AND {n('lab', 'test', 'result', 'glucose', 'cholesterol')} AND lab_outliers > 0"),
        ("ECOMMERCE_SKU_FORMAT", "keep_as_is", 45, "0.9", f"is_string AND {n('sku')} AND unique_ratio > 0.5"),
        ("ECOMMERCE_ORDER_ID", "keep_as_is", 45, "0.95", f"is_string AND {n('order')} AND {n('id')} AND unique_ratio > 0.9"),
        ("ECOMMERCE_PRICE_FORMAT", "standard_scale", 40, "0.85", f"is_numeric AND {n('price', 'cost', 'msrp')}"),
        ("ECOMMERCE_DISCOUNT_CODE", "onehot_encode", 40, "0.85", f"is_string AND {n('discount', 'promo', 'coupon')}"),
        ("ECOMMERCE_QUANTITY", "keep_as_is", 40, "0.8", f"is_numeric AND {n('qty', 'quantity', 'units')} AND min_value >= 0"),
        ("ECOMMERCE_TRACKING_NUMBER", "drop_column", 45, "0.9", f"is_string AND {n('tracking', 'shipment')} AND dpm_tracking > 0.5"),
        ("ECOMMERCE_PRODUCT_CODE", "keep_as_is", 45, "0.9", f"is_string AND {n('product_code', 'item_code', 'upc', 'ean')}"),
        ("ECOMMERCE_RATING_SCORE", "minmax_scale", 40, "0.85", f"is_numeric AND {n('rating', 'stars', 'score')} AND min_value >= 0 AND max_value <= 5"),
    ]


def everyday(n, d):
    return [
        ("UNIVERSAL_RATING_SCORE_STANDARD_SCALE", "standard_scale", 96, "0.96", f"is_numeric AND {n('rating', 'score', 'stars', 'grade', 'review', 'user_rating')} AND has_range AND min_value >= 0 AND max_value <= 100"),
        ("UNIVERSAL_YEAR_STANDARD_SCALE", "standard_scale", 97, "0.97", f"is_numeric AND {n('year', 'yr', 'model_year', 'year_built', 'birth_year', 'release_year', 'publish_year')} AND has_range AND min_value BETWEEN 1900 AND 2100 AND max_value BETWEEN 1900 AND 2100"),
        ("UNIVERSAL_AGE_STANDARD_SCALE", "standard_scale", 95, "0.95", f"is_numeric AND {n('age', 'patient_age', 'age_years', 'customer_age')} AND has_range AND min_value >= 0 AND max_value <= 120"),
        ("UNIVERSAL_PERCENTAGE_MINMAX_SCALE", "minmax_scale", 95, "0.95", f"is_numeric AND {n('percent', 'pct', 'percentage', '_pct', 'rate')} AND has_range AND min_value >= 0 AND max_value <= 100"),
        ("UNIVERSAL_ID_DROP", "drop_column", 98, "0.98", f"unique_ratio > 0.9 AND {n('_id', 'id', 'uuid', 'guid', 'index', 'row_id', 'record_id', 'key')}"),
        ("UNIVERSAL_NAME_LABEL_ENCODE", "label_encode", 95, "0.92", f"is_string AND {n('name', 'title', 'author', 'artist', 'brand', 'company', 'customer_name', 'product_name')} AND unique_ratio < 0.95"),
    ]


def optional_everyday(n, d):
    """Four more rules that are off unless asked for."""
    return [
        ("OPTIONAL_SQRT_MODERATE_SKEW", "sqrt_transform", 160, "0.9", "is_numeric AND skewness > 1.0 AND skewness <= 2.2 AND min_value >= 0"),
        ("OPTIONAL_CYCLIC_PARTS", "cyclic_time_encode", 150, "0.92", f"is_numeric AND min_value >= 1 AND max_value <= 24 AND {n('hour', 'month', 'day', 'minute')}"),
        ("OPTIONAL_ZIP_LABEL", "label_encode", 140, "0.88", f"is_string AND avg_length BETWEEN 5 AND 7 AND {n('zip', 'postcode')}"),
        ("OPTIONAL_MONTH_NAMES", "ordinal_encode", 130, "0.93", f"is_string AND {n('month')}"),
    ]
