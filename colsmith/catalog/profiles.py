"""Queries for column profiles, feature vectors, semantic types and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import frames, messy, profile_sql, quoted
from colsmith.functions import constants as K
from colsmith.operators import features, health, semantic, states
from colsmith.operators.profile import WITH_SEMANTICS, profile

KEYS = ["table_name", "column_name"]
ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FEW = ("orders", "events", "messy")


def _rounded(df, exact=(), real=(), digits=6):
    return df.select(*KEYS, *exact, *[r(c, digits).alias(c) for c in real])


def _sql(relation, exact=(), real=(), digits=6, where=""):
    columns = [*KEYS, *exact, *[f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in real]]
    return f"SELECT {', '.join(columns)} FROM {relation} p {where}"


def _profile_query(name, tables, parts, exact, real, numeric_only=False, text_only=False, text=True, digits=6):
    where = "WHERE is_numeric" if numeric_only else "WHERE is_string" if text_only else ""

    @query(name, _sql(profile_sql(*tables, text=text), exact, real, digits, where))
    def run(load):
        found = profile(frames(load, *tables), parts)
        if numeric_only:
            found = found.where("is_numeric")
        if text_only:
            found = found.where("is_string")
        return _rounded(found, exact, real, digits)


_profile_query("p1_counts", (*ALL, "messy"), {"values"}, ("row_count", "null_count", "unique_count"),
               ("null_pct", "unique_ratio", "duplicate_ratio"), text=False)
_profile_query("p2_type_flags", (*ALL, "messy"), {"values"}, ("is_numeric", "is_string", "is_temporal", "is_categorical"), (), text=False)
_profile_query("p3_moments", ALL, {"numbers", "values", "quartiles"}, (), ("min_value", "max_value", "mean", "median", "std", "range_size"), True, text=False, digits=4)
_profile_query("p4_skewness_kurtosis", ALL, {"numbers"}, (), ("skewness", "kurtosis"), True, text=False)
_profile_query("p5_variation", (*ALL, "messy"), {"numbers"}, (), ("cv",), True, text=False)
_profile_query("p6_outliers", (*ALL, "messy"), {"numbers", "values", "quartiles"}, ("outlier_count", "far_outlier_count"),
               ("iqr", "outlier_pct", "far_outlier_pct"), True, text=False)
_profile_query("p8_value_patterns", FEW, {"values", "text"}, tuple(K.CONTENT_PATTERNS), ("avg_length", *K.VALUE_PATTERNS), False, True)
_profile_query("p9_json_share", FEW, {"values", "text"}, (), ("matches_json",), False, True)
_profile_query("p11_encoded_nulls", FEW, {"numbers", "values", "text"}, (), ("encoded_null_ratio",))
_profile_query("p12_entropy", (*ALL, "messy"), {"values"}, (), ("entropy", "entropy_bits"), text=False)


@query("p7_flags", f"""
SELECT table_name, column_name, min_value > 0 AS all_positive, zeros > 0 AS has_zeros, abs(mean) < 0.1 AND std > 0.8 AND std < 1.2 AS is_already_scaled,
  min_value >= 0 AND max_value <= 100 AS has_natural_bounds, kurtosis < -1 AS is_bimodal FROM {profile_sql(*ALL, text=False)} p WHERE is_numeric""")
def _(load):
    found = profile(frames(load, *ALL), {"numbers"}).where("is_numeric")
    return found.select(*KEYS, "all_positive", "has_zeros", "is_already_scaled", "has_natural_bounds", "is_bimodal")


@query("p10_domain_patterns", "SELECT table_name, column_name, "
       + ", ".join(f"round(dpm_{n}, 6) AS {n}" for n in K.DOMAIN_PATTERNS) + f" FROM {profile_sql(*FEW)} p WHERE is_string")
def _(load):
    found = profile(frames(load, *FEW), {"values", "text"}).where("is_string")
    return found.select(*KEYS, *[r(F.col("domain_pattern_matches")[n]).alias(n) for n in K.DOMAIN_PATTERNS])


@query("p13_ordinal", f"SELECT table_name, column_name, is_categorical AND all_ordinal AS is_ordinal FROM {profile_sql(*FEW)} p WHERE is_string")
def _(load):
    return profile(frames(load, *FEW), {"values"}).where("is_string").select(*KEYS, "is_ordinal")


_HEALTH = f"""
t AS (SELECT *, CASE WHEN present = 0 THEN 'empty' WHEN is_numeric THEN 'numeric' WHEN is_temporal THEN 'datetime'
  WHEN sem_number * present / row_count > 0.8 THEN 'numeric' WHEN unique_ratio < 0.5 THEN 'categorical' ELSE 'text' END AS data_type
  FROM {profile_sql("customer", "orders", "part", "messy", semantics=True)} p),
s AS (SELECT *, 100
  - CASE WHEN is_numeric AND outlier_pct > 0.1 THEN 15 ELSE 0 END - CASE WHEN is_numeric AND abs(skewness) > 2 THEN 10 ELSE 0 END
  - CASE WHEN is_numeric AND cv > 2 THEN 5 ELSE 0 END - CASE WHEN data_type = 'categorical' AND top_share > 0.9 THEN 10 ELSE 0 END
  - CASE WHEN data_type = 'categorical' AND unique_count > 100 THEN 15 WHEN data_type = 'categorical' AND unique_count = 1 THEN 30 ELSE 0 END
  - CASE WHEN null_pct > 0.5 THEN 30 WHEN null_pct > 0.2 THEN 15 WHEN null_pct > 0.05 THEN 5 ELSE 0 END
  - CASE WHEN unique_ratio > 0.95 AND row_count > 50 THEN 20 ELSE 0 END - CASE WHEN unique_count = 1 THEN 30 ELSE 0 END AS score FROM t),
h AS (SELECT *, greatest(score, 0)::DOUBLE AS health_score, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS severity FROM s)"""


def _health(load):
    return health.column_health(profile(frames(load, "customer", "orders", "part", "messy"), WITH_SEMANTICS))


@query("p14_column_health", f"WITH {_HEALTH} SELECT table_name, column_name, data_type, health_score, severity, null_count, unique_count FROM h")
def _(load):
    return _health(load).select(*KEYS, "data_type", "health_score", "severity", "null_count", "unique_count")


_NOTES = (
    ("data_type = 'empty'", "'no value at all'"), ("is_numeric AND outlier_pct > 0.1", "printf('%.1f%% of the values lie outside the fences', outlier_pct * 100)"),
    ("is_numeric AND abs(skewness) > 2", "printf('skewed distribution (%.2f)', skewness)"), ("is_numeric AND cv > 2", "printf('deviation is %.2f times the mean', cv)"),
    ("data_type = 'categorical' AND top_share > 0.9", "printf('one category holds %.1f%%', top_share * 100)"),
    ("data_type = 'categorical' AND unique_count > 100", "printf('%d categories', unique_count)"), ("data_type = 'categorical' AND unique_count = 1", "'a single category'"),
    ("null_pct > 0.5", "printf('more than half is missing (%.1f%%)', null_pct * 100)"), ("null_pct > 0.2 AND null_pct <= 0.5", "printf('a good part is missing (%.1f%%)', null_pct * 100)"),
    ("null_pct > 0.05 AND null_pct <= 0.2", "printf('some values are missing (%.1f%%)', null_pct * 100)"),
    ("unique_ratio > 0.95 AND row_count > 50", "printf('%.1f%% distinct, perhaps an identifier', unique_ratio * 100)"), ("unique_count = 1", "'every value is the same'"),
)


_MERGED = ("lineitem", "customer")
_MERGED_EXACT = ("row_count", "present", "min_value", "max_value", "zeros", "positives", "negatives", "decimals", "min_length", "max_length")
_MERGED_REAL = ("mean", "std", "skewness", "kurtosis", "avg_length", "length_std", "matches_iso_datetime", "matches_numeric_pattern", "matches_email_pattern")
_FEW = f"unique_count <= {states.EXACT_VALUES}"


@query("p1_merged_states", f"""
SELECT table_name, column_name, {", ".join(_MERGED_EXACT)}, {", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in _MERGED_REAL)}, CASE WHEN {_FEW} THEN unique_count END AS unique_count,
  CASE WHEN {_FEW} THEN top_count END AS top_count, CASE WHEN {_FEW} THEN round(entropy, 6) + 0.0::DOUBLE END AS entropy FROM {profile_sql(*_MERGED)} p""")
def _(load):
    """Each table as four loads whose states are merged; what value counts give is compared where a column has few values."""
    def part(name, i):
        df = load(name)
        return df.where(F.pmod(F.col(df.columns[0]), F.lit(4)) == i)

    loads = [states.state({name: part(name, i) for name in _MERGED}) for i in range(4)]
    found = states.profile(states.merge(loads))
    few = F.col("unique_count") <= states.EXACT_VALUES
    return found.select(*KEYS, *_MERGED_EXACT, *[r(c).alias(c) for c in _MERGED_REAL], F.when(few, F.col("unique_count")).alias("unique_count"),
                        F.when(few, F.col("top_count")).alias("top_count"), F.when(few, r("entropy")).alias("entropy"))


@query("p14_anomalies", f"WITH {_HEALTH} SELECT table_name, column_name, concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in _NOTES) + ") AS anomalies FROM h")
def _(load):
    return _health(load).select(*KEYS, F.concat_ws("; ", "anomalies").alias("anomalies"))


@query("p15_table_health", f"""WITH {_HEALTH} SELECT table_name, round(avg(health_score), 6) AS overall_health_score,
  count(*) FILTER (severity = 'healthy') AS healthy_columns, count(*) FILTER (severity = 'warning') AS warning_columns,
  count(*) FILTER (severity = 'critical') AS critical_columns FROM h GROUP BY table_name""")
def _(load):
    found = health.table_health(_health(load))
    return found.withColumn("overall_health_score", r("overall_health_score"))


@query("p16_column_quality", f"""
SELECT table_name, column_name, round(null_pct, 6) AS null_ratio, round(unique_ratio, 6) AS unique_ratio, round(duplicate_ratio, 6) AS duplicate_ratio,
  round(coalesce(CASE WHEN is_string THEN null_indicators ELSE encoded_nulls END, 0) / row_count, 6) AS encoded_null_ratio
FROM {profile_sql("messy", "customer", semantics=True)} p""")
def _(load):
    found = profile(frames(load, "messy", "customer"), WITH_SEMANTICS)
    encoded = F.coalesce(F.when(F.col("is_string"), F.col("null_indicators")).otherwise(F.col("encoded_nulls")), F.lit(0))
    return found.select(*KEYS, r("null_pct").alias("null_ratio"), r("unique_ratio").alias("unique_ratio"),
                        r("duplicate_ratio").alias("duplicate_ratio"), r(encoded / F.col("row_count")).alias("encoded_null_ratio"))


_SIGNAL = "CASE " + " ".join(f"WHEN contains(lower(column_name), '{w}') THEN {v}::DOUBLE" for w, v in K.NAME_SIGNALS) + " ELSE 0.0::DOUBLE END"
_SKEW_POP = "(skewness * (present - 2) / sqrt(present * (present - 1.0::DOUBLE)))"
_DTYPE = "CASE WHEN is_numeric THEN 0 WHEN is_categorical THEN 1 WHEN is_temporal THEN 3 WHEN is_string THEN 2 ELSE 4 END"
_BIMODAL = f"CASE WHEN is_numeric AND std_pop > 0 THEN ({_SKEW_POP} * {_SKEW_POP} + 1) / (kurt_pop + 3 * (present - 1.0::DOUBLE) * (present - 1) / ((present - 2.0::DOUBLE) * (present - 3))) ELSE 0 END"
_TEN = ("null_percentage", "unique_ratio", "skewness", "outlier_percentage", "entropy", "pattern_complexity", "multimodality_score", "column_name_signal")
_TEN_SQL = f"""round(null_pct, 6) AS null_percentage, round(unique_ratio, 6) AS unique_ratio, round(coalesce({_SKEW_POP}, 0), 6) + 0.0::DOUBLE AS skewness,
  round(coalesce(CASE WHEN iqr > 0 THEN outlier_pct END, 0), 6) AS outlier_percentage, round(entropy_bits, 6) AS entropy,
  round(coalesce(complexity_hits, 0) / 7, 6) AS pattern_complexity, round({_BIMODAL}, 6) AS multimodality_score, {_SIGNAL} AS column_name_signal,
  CASE WHEN unique_ratio > 0.95 THEN 3 WHEN unique_count > 50 THEN 2 WHEN unique_count > 10 THEN 1 ELSE 0 END AS cardinality_bucket, {_DTYPE} AS detected_dtype"""


@query("p17_twenty_features", f"""
SELECT table_name, column_name, {_TEN_SQL}, round(coalesce(kurt_pop, 0), 6) AS kurtosis, round(coalesce(std_pop / abs(mean), 0), 6) AS coefficient_of_variation,
  round(coalesce(zeros / present, 0), 6) AS zero_ratio, coalesce((negatives > 0)::INT, 0)::DOUBLE AS has_negative, coalesce((decimals > 0)::INT, 0)::DOUBLE AS has_decimal,
  round(coalesce(range_size / nullif(median, 0), 0), 6) AS range_ratio, round(coalesce(iqr / nullif(median, 0), 0), 6) AS iqr_ratio
FROM {profile_sql("orders", "events", "customer")} p""")
def _(load):
    found = features.minimal_features(profile(frames(load, "orders", "events", "customer")))
    return _rounded(found, ("cardinality_bucket", "detected_dtype"),
                    (*_TEN, "kurtosis", "coefficient_of_variation", "zero_ratio", "has_negative", "has_decimal", "range_ratio", "iqr_ratio"))


def _feature_inputs(load):
    df = load("events")
    found = profile({"events": df}, WITH_SEMANTICS)
    return found, features.diversity(df, "events"), features.sequence_features(df, "events", ["ts", "event_id"])


def _any(words):
    return "(" + " OR ".join(f"contains(lower(column_name), '{w}')" for w in words) + ")::INT::DOUBLE"


def _sequence_sql():
    parts = []
    for c in ("event_id", "user_id", "value"):
        lags = ", ".join(f"lag(x, {k}) OVER (ORDER BY ts, event_id) AS l{k}" for k in features.LAGS)
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (x >= l1) AS up, count(*) FILTER (x <= l1) AS down, "
                     f"round(corr(p, x), 6) AS trend, {', '.join(f'round(corr(x, l{k}), 6) AS corr_{k}' for k in features.LAGS)} FROM "
                     f"(SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY ts, event_id) AS p, {lags} FROM (SELECT *, CAST({c} AS DOUBLE) AS x FROM events) e) s")
    return " UNION ALL ".join(parts)


def _words(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BARE_JSON = r"""regexp_replace(regexp_replace(regexp_replace(to_json(x::JSON)::VARCHAR, '"(?:[^"\\]|\\.)*"', 's', 'g'), '\{\}|\[\]', 's', 'g'), '[^\{\}\[\]]', '', 'g')"""


def _looks_sql(table, texts):
    """Measures of text columns beyond the profile: looks, words, JSON depth, distinct characters, hosts and mail domains."""
    parts = []
    for c in texts:
        looks = ", ".join(f"avg(regexp_matches(x, {quoted(p)})::INT) AS looks_{k}" for k, p in K.LOOKS_PATTERNS.items())
        hits = " + ".join(f"regexp_matches(x, {quoted('(?i)' + p)})::INT" for p in K.EMBEDDED_NULL_PATTERNS)
        parts.append(f"""SELECT '{c}' AS column_name, {looks}, least(1.0, avg({hits})) AS embedded_nulls, avg((regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]'))::INT) AS mixed_case,
          avg(len(regexp_extract_all(x, '\\S+'))) AS word_count, coalesce(avg(depth), 0) AS json_depth, count(DISTINCT lower(x)) AS unique_lower,
          bool_and(lower(x) IN {_words(K.BOOLEAN_WORDS)}) AS boolean_words, bool_or(lower(x) IN {_words(K.ORDINAL_WORDS)}) AS ordinal_words,
          (SELECT count(DISTINCT ch) FROM (SELECT unnest(string_split({c}, '')) AS ch FROM {table}) u WHERE ch <> '') AS chars,
          count(DISTINCT host) FILTER (host <> '') AS hosts, count(*) FILTER (host <> '') AS host_rows, count(DISTINCT mail) FILTER (mail <> '') AS domains, count(*) FILTER (mail <> '') AS domain_rows
          FROM (SELECT *, CASE WHEN regexp_matches(trim(x), '^[\\{{\\[]') AND json_valid(x) THEN
                  coalesce(list_max(list_transform(generate_series(1, length(bare)), lambda i: length(replace(replace(bare[1:i], '}}', ''), ']', '')) * 2 - i)), 0) END AS depth
                FROM (SELECT {c} AS x, regexp_extract({c}, 'https?://([^/]+)', 1) AS host, regexp_extract({c}, '@([a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', 1) AS mail,
                  CASE WHEN json_valid({c}) THEN {_BARE_JSON.replace("x::JSON", f"{c}::JSON")} END AS bare FROM {table}) a WHERE x IS NOT NULL) b""")
    return " UNION ALL ".join(parts)


def _position(groups):
    return "CASE " + " ".join(f"WHEN {_any(words)} > 0 THEN {i}" for i, words in enumerate(groups)) + " ELSE 5 END"


def _vector_source():
    """One row per column of events with the profile, the looks of texts and the measures of sequences."""
    return f"""(SELECT p.* EXCLUDE (unique_ratio, entropy, skewness), skewness AS p_skew, l.* EXCLUDE (column_name), s.n AS n_seq, s.* EXCLUDE (column_name, n), column_name IN ('event_id', 'user_id') AS is_integer,
      coalesce(CASE WHEN is_string THEN chars / nullif(avg_length * present, 0) END, 0) AS variety, {_TEN_SQL}
      FROM {profile_sql("events", semantics=True)} p LEFT JOIN ({_looks_sql("events", ("event_type", "props"))}) l USING (column_name) LEFT JOIN ({_sequence_sql()}) s USING (column_name))"""


_THIRTY_REAL = {
    "quantile_25": "coalesce(q25, 0)", "quantile_75": "coalesce(q75, 0)", "mode_frequency_": "CASE WHEN is_numeric THEN top_share ELSE mode_frequency END",
    "has_value_gaps": "CASE WHEN is_integer AND unique_count > 1 THEN 1 - unique_count / (max_value - min_value + 1) ELSE 0 END",
    "coefficient_dispersion": "coalesce(abs(iqr / nullif(median, 0)), 0)", "avg_string_length": "CASE WHEN is_string THEN avg_length ELSE 0 END",
    "char_diversity": "variety", "numeric_string_ratio": "CASE WHEN is_string THEN matches_numeric_pattern ELSE 0 END",
    "semantic_type": _position(K.SEMANTIC_KEYWORDS), "domain_category": _position(K.BUSINESS_KEYWORDS),
    "naming_quality_score": "CASE WHEN contains(column_name, '_') OR regexp_matches(column_name, '^[a-z]') THEN 0.3 ELSE 0 END + CASE WHEN length(column_name) > 3 THEN 0.2 ELSE 0 END"
                            " + CASE WHEN regexp_matches(column_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 0.3 ELSE 0 END + CASE WHEN length(column_name) < 30 THEN 0.2 ELSE 0 END",
    "is_foreign_key_candidate": f"CASE WHEN unique_count / row_count > 0.1 AND unique_count / row_count < 0.95 AND {_any(('_id', 'fk_', 'ref_'))} > 0 THEN 0.8 ELSE 0 END",
    "is_primary_key_candidate": f"CASE WHEN unique_count / row_count > 0.95 AND null_pct < 0.01 THEN CASE WHEN {_any(('id', 'key', 'pk'))} > 0 THEN 1 ELSE 0.5 END ELSE 0 END",
    "autocorrelation_lag1": "CASE WHEN n_seq > 10 THEN corr_1 ELSE 0 END", "is_monotonic_score": "CASE WHEN n_seq > 10 THEN greatest(up, down) / n_seq ELSE 0 END",
    "has_embedded_nulls": "coalesce(embedded_nulls, 0)", "url_host_diversity": "coalesce(hosts / nullif(host_rows, 0), 0)", "email_domain_diversity": "coalesce(domains / nullif(domain_rows, 0), 0)",
    "json_complexity": "coalesce(json_depth, 0)", "delimited_pattern_score": "coalesce(looks_delimited, 0)",
}
_WHOLE = ("cardinality_bucket", "detected_dtype")


def _vector_sql(real, whole=""):
    made = ", ".join(f"round(({e})::DOUBLE, 6) + 0.0::DOUBLE AS {c.rstrip('_')}" for c, e in real.items())
    return f"SELECT table_name, column_name, {', '.join(_WHOLE)}, {', '.join(_TEN)}, {made}{whole} FROM {_vector_source()} v"


def _vector(found, real):
    return _rounded(found, _WHOLE, (*_TEN, *[c.rstrip("_") for c in real]))


@query("p18_thirty_features", _vector_sql(_THIRTY_REAL))
def _(load):
    return _vector(features.enhanced_features(*_feature_inputs(load)), _THIRTY_REAL)


@query("p18_sequence_measures", _sequence_sql())
def _(load):
    found = features.sequence_features(load("events"), "events", ["ts", "event_id"])
    return found.select("column_name", "n", "up", "down", r("trend").alias("trend"), *[r(f"corr_{k}").alias(f"corr_{k}") for k in features.LAGS])


def _diversity_sql(table, texts):
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, (SELECT count(DISTINCT ch) FROM (SELECT unnest(list_distinct(string_split({c}, ''))) AS ch FROM {table}) x WHERE ch <> '') AS chars,
      count(DISTINCT h) FILTER (h <> '') AS hosts, count(*) FILTER (h <> '') AS host_rows, count(DISTINCT m) FILTER (m <> '') AS domains, count(*) FILTER (m <> '') AS domain_rows
      FROM (SELECT regexp_extract({c}, 'https?://([^/]+)', 1) AS h, regexp_extract({c}, '@([a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', 1) AS m FROM {table}) p""" for c in texts)


@query("p18_diversity", _diversity_sql("pages", ("url", "html")))
def _(load):
    return features.diversity(load("pages"), "pages").drop("table_name")


_NUM = "is_numeric AND present > 0"
_TXT = "detected_dtype IN (1, 2) AND present > 0"
_MANY = "is_numeric AND present >= 10"
_ORD = "is_numeric AND n_seq >= 20"
_REL = f"coalesce(CASE WHEN {_MANY} THEN range_size / nullif(abs(mean), 0) END, 0)"
_DISP = f"coalesce(CASE WHEN {_MANY} THEN abs(iqr / nullif(mean, 0)) END, 0)"


def _is(condition):
    return f"coalesce(({condition})::INT, 0)"


_SIXTY_REAL = {
    **{f"name_contains_{g}": _any(w) for g, w in K.NAME_GROUPS.items()}, "name_is_short": "(length(column_name) <= 3)::INT", "name_is_long": "(length(column_name) >= 20)::INT",
    "looks_like_year": _is(f"{_NUM} AND min_value >= 1900 AND max_value <= 2100 AND mean > 1950"),
    "looks_like_age": f"CASE WHEN {_NUM} AND min_value >= 0 AND max_value <= 120 AND mean > 0 THEN CASE WHEN max_value < 100 THEN 0.8 ELSE 0.5 END ELSE 0 END",
    "looks_like_rating": f"CASE WHEN {_NUM} AND min_value >= 0 AND max_value <= 10 THEN CASE WHEN max_value <= 5 THEN 1 ELSE 0.8 END ELSE 0 END",
    "looks_like_percentage": f"CASE WHEN {_NUM} AND min_value >= 0 AND max_value <= 100 THEN 0.7 ELSE 0 END",
    **{f"looks_like_{k}": _is(f"{_TXT} AND {c} > {b}") for k, c, b in (("currency", "looks_money", 0.3), ("zipcode", "looks_zip", 0.5), ("phone", "looks_call", 0.5), ("email", "sem_email", 0.5),
                                                                     ("url", "looks_web", 0.5), ("code", "looks_code", 0.5))},
    "looks_like_boolean": _is(f"{_TXT} AND unique_lower <= 3 AND boolean_words"),
    "looks_like_categorical": f"CASE WHEN {_TXT} THEN CASE WHEN unique_count / row_count < 0.1 AND cardinality_bucket <= 1 THEN 1 WHEN unique_count / row_count < 0.3 THEN 0.5 ELSE 0 END ELSE 0 END",
    "looks_like_ordinal": _is(f"{_TXT} AND unique_lower <= 5 AND ordinal_words"),
    "looks_like_freetext": f"CASE WHEN {_TXT} THEN CASE WHEN avg_length > 50 AND length_std > 20 THEN 1 WHEN avg_length > 20 THEN 0.5 ELSE 0 END ELSE 0 END",
    "has_special_characters": _is(f"{_TXT} AND looks_special > 0.1"),
    "distribution_type": f"CASE WHEN {_MANY} AND std > 0 AND present >= 30 THEN CASE WHEN {_REL} > 0 AND {_DISP} < 0.3 THEN 2 WHEN multimodality_score > 0.555 THEN 4 "
                         f"WHEN {_SKEW_POP.replace('skewness', 'p_skew')} BETWEEN -0.5 AND 0.5 THEN 1 WHEN {_SKEW_POP.replace('skewness', 'p_skew')} > 1.5 THEN 3 ELSE 0 END ELSE 0 END",
    "mode_spike_ratio": f"CASE WHEN {_MANY} THEN top_share ELSE 0 END", "has_outlying_values": _is(f"{_MANY} AND outlier_count > 0"),
    "quantile_25": f"CASE WHEN {_MANY} THEN q25 ELSE 0 END", "quantile_75": f"CASE WHEN {_MANY} THEN q75 ELSE 0 END", "coefficient_dispersion": _DISP, "range_normalized": _REL,
    "contains_zeros": _is(f"{_MANY} AND zeros > 0"), "avg_string_length": _THIRTY_REAL["avg_string_length"], "char_diversity": "variety",
    "numeric_string_ratio": _THIRTY_REAL["numeric_string_ratio"], "has_mixed_case": "coalesce(mixed_case, 0)", "word_count_avg": "coalesce(word_count, 0)",
    "autocorrelation_lag1": f"CASE WHEN {_ORD} THEN corr_1 ELSE 0 END", "is_monotonic_score": f"CASE WHEN {_ORD} THEN greatest(up, down) / (n_seq - 1) ELSE 0 END",
    "seasonality_score": f"CASE WHEN {_ORD} AND n_seq >= 50 THEN greatest({', '.join(f'CASE WHEN n_seq / 2 > {k} AND abs(corr_{k}) > 0.3 THEN abs(corr_{k}) ELSE 0 END' for k in features.LAGS if k > 1)}) ELSE 0 END",
    "trend_strength": f"CASE WHEN {_ORD} THEN abs(trend) ELSE 0 END",
}


@query("p19_sixty_two_features", _vector_sql(_SIXTY_REAL))
def _(load):
    return _vector(features.meta_learning_features(*_feature_inputs(load)), _SIXTY_REAL)


@query("p19_name_features", "SELECT table_name, column_name, " + ", ".join(f"{_any(w)} AS name_contains_{g}" for g, w in K.NAME_GROUPS.items())
       + f", (length(column_name) <= 3)::INT::DOUBLE AS name_is_short, (length(column_name) >= 20)::INT::DOUBLE AS name_is_long FROM {profile_sql('events', text=False)} p")
def _(load):
    found = features.meta_learning_features(*_feature_inputs(load))
    return found.select(*KEYS, *[c for c in found.columns if c.startswith("name_contains_")], "name_is_short", "name_is_long")


_FORTY_REAL = ("missing_ratio", "unique_ratio", "unique_count_norm", "row_count_norm", "mean", "std", "min", "max", "median", "skewness", "kurtosis",
               "outlier_ratio", "positive_ratio", "negative_ratio", "zero_ratio", "avg_length", "max_length", "min_length", "length_std", "entropy", "mode_frequency")


@query("p20_forty_features", f"""
SELECT table_name, column_name, round(null_pct, 6) AS missing_ratio, round(unique_ratio, 6) AS unique_ratio, round(ln(1 + unique_count) / 10, 6) AS unique_count_norm,
  round(ln(1 + row_count) / 15, 6) AS row_count_norm, round(coalesce(mean, 0), 6) AS mean, round(coalesce(std_pop, 0), 6) AS std, round(coalesce(min_value, 0), 6) AS min,
  round(coalesce(max_value, 0), 6) AS max, round(coalesce(median, 0), 6) AS median, round(coalesce({_SKEW_POP}, 0), 6) + 0.0::DOUBLE AS skewness,
  round(coalesce(kurt_pop, 0), 6) AS kurtosis, round(coalesce(CASE WHEN iqr > 0 THEN outlier_pct END, 0), 6) AS outlier_ratio,
  round(coalesce(positives / present, 0), 6) AS positive_ratio, round(coalesce(negatives / present, 0), 6) AS negative_ratio, round(coalesce(zeros / present, 0), 6) AS zero_ratio,
  round(CASE WHEN is_string THEN avg_length ELSE 0 END, 6) AS avg_length, CASE WHEN is_string THEN max_length ELSE 0 END::DOUBLE AS max_length,
  CASE WHEN is_string THEN min_length ELSE 0 END::DOUBLE AS min_length, round(CASE WHEN is_string THEN length_std ELSE 0 END, 6) AS length_std,
  round(entropy_bits, 6) AS entropy, round(mode_frequency, 6) AS mode_frequency, (unique_ratio < 0.01)::INT::DOUBLE AS cardinality_low,
  (unique_ratio >= 0.95)::INT::DOUBLE AS cardinality_unique, coalesce((min_value > 0)::INT, 0)::DOUBLE AS can_log, {", ".join(f"{_any(w)} AS {g}" for g, w in K.SHORT_NAME_GROUPS.items())}
FROM {profile_sql("orders", "customer", "part", text=False)} p""")
def _(load):
    found = features.meta_features(profile(frames(load, "orders", "customer", "part"), {"numbers", "values", "quartiles"}))
    return _rounded(found, ("cardinality_low", "cardinality_unique", "can_log", *K.SHORT_NAME_GROUPS), _FORTY_REAL)


_HINT = {k: _any(w).replace("::INT::DOUBLE", "") for k, w in K.NAME_HINTS.items()}


def _found(kind, share, weight):
    conf = f"least(1.0, {share} * {weight} + CASE WHEN {_HINT[kind]} THEN {round(1 - weight, 2)} ELSE 0 END)"
    return f"WHEN ({share} >= 0.8 OR ({share} >= 0.5 AND {_HINT[kind]})) AND {conf} >= 0.5 THEN ", conf


def _semantic_sql(names=("messy", "customer", "events")):
    url, mail, phone = _found("url", "sem_url", 0.9), _found("email", "sem_email", 0.9), _found("phone", "sem_phone", 0.85)
    date = _found("datetime", "greatest(sem_iso, sem_date)", 0.9)
    zero_one = "is_numeric AND min_value IN (0, 1) AND max_value IN (0, 1) AND decimals = 0"
    ident = (f"CASE WHEN sem_uuid >= 0.8 THEN 0.95 WHEN ratio >= 0.95 AND {_HINT['identifier']} THEN 0.9 WHEN ratio >= 0.95 AND length_std < 1 AND avg_length > 10 "
             f"AND sem_alnum > 0.9 THEN 0.85 WHEN {_HINT['identifier']} AND ratio >= 0.8 THEN 0.75 ELSE 0 END")
    cases = [
        ("WHEN null_pct >= 0.9 THEN ", "'empty'", "least(1.0, null_pct + 0.05)"), (url[0], "'url'", url[1]),
        ("WHEN is_temporal THEN ", "'datetime'", "0.98"), (date[0], "'datetime'", date[1]), (mail[0], "'email'", mail[1]), (phone[0], "'phone'", phone[1]),
        (f"WHEN {ident} > 0 THEN ", "'identifier'", ident), (f"WHEN unique_count <= 3 AND (in_boolean_set OR ({zero_one})) THEN ", "'boolean'", "0.95"),
        ("WHEN is_numeric THEN ", "'numeric'", "0.95"), ("WHEN sem_number >= 0.8 THEN ", "'numeric'", "sem_number"),
        ("WHEN unique_count <= 50 AND ratio <= 0.5 THEN ", "'categorical'", "greatest(0.6, 0.85 - ratio * 0.3)"),
        ("WHEN (ratio > 0.5 OR unique_count > 50) AND (sem_blank > 0.5 OR avg_length > 10) THEN ", "'text'", "0.8"),
        (f"WHEN {_HINT['text']} AND avg_length > 3 THEN ", "'text'", "0.75"),
    ]
    kind = "CASE " + " ".join(c + k for c, k, _ in cases) + " ELSE 'text' END"
    conf = "CASE " + " ".join(c + f"({v})::DOUBLE" for c, _, v in cases) + " ELSE 0.5::DOUBLE END"
    clean = profile_sql(*names, semantics=True)
    shares = [*[f"sem_{n}" for n in K.SEMANTIC_PATTERNS], "sem_email", "sem_number", "in_boolean_set"]
    lets = ", ".join(f"coalesce({s}, {'FALSE' if s.startswith('in_') else '0'}) AS {s}" for s in shares)
    return f"SELECT table_name, column_name, {kind} AS semantic_type, round({conf}, 6) AS type_confidence FROM (SELECT * REPLACE ({lets}), unique_count / present AS ratio FROM {clean} p) s"


@query("p21_semantic_types", _semantic_sql())
def _(load):
    found = semantic.semantic_types(profile(frames(load, "messy", "customer", "events"), WITH_SEMANTICS))
    return found.select(*KEYS, "semantic_type", r("type_confidence").alias("type_confidence"))


_CLASS = """CASE WHEN present = 0 THEN 'empty' WHEN is_numeric AND min_value BETWEEN 1900 AND 2100 AND max_value BETWEEN 1900 AND 2100 AND unique_count <= 200 THEN 'year'
  WHEN is_numeric AND min_value >= 0 AND max_value <= 1 THEN 'ratio' WHEN is_numeric AND min_value >= 0 AND max_value <= 100 THEN 'percentage_numeric'
  WHEN is_numeric AND abs(skewness) > 2 AND min_value > 0 THEN 'skewed_positive_numeric' WHEN is_numeric THEN 'numeric' WHEN is_temporal THEN 'datetime'
  WHEN alt_currency > 0.8 THEN 'currency' WHEN alt_percentage > 0.8 THEN 'percentage' WHEN alt_numeric_string > 0.8 THEN 'numeric_string'
  WHEN greatest(alt_boolean_tf, alt_boolean_yn, alt_boolean_01, alt_boolean_onoff) > 0.8 AND unique_count <= 3 THEN 'boolean_like'
  WHEN greatest(alt_iso_datetime, alt_us_date, alt_eu_date, alt_named_date) > 0.7 THEN 'datetime_like' WHEN alt_email > 0.8 THEN 'email' WHEN alt_phone > 0.8 THEN 'phone'
  WHEN alt_url > 0.8 THEN 'url' WHEN sem_uuid > 0.8 THEN 'uuid' WHEN is_string AND unique_ratio > 0.9 AND trimmed_length > 10 THEN 'high_cardinality_identifier'
  WHEN is_string AND unique_count > 50 AND unique_ratio > 0.3 THEN 'high_cardinality_categorical' WHEN is_string AND trimmed_length > 50 THEN 'text'
  WHEN is_string AND unique_count < 50 THEN 'categorical' ELSE 'unknown' END"""


@query("p22_column_classes", f"""
SELECT table_name, column_name, column_class, CASE WHEN column_class = 'categorical' THEN CASE WHEN unique_count < 10 THEN 'onehot_encode' ELSE 'label_encode' END ELSE
  map {{'empty': 'drop_column', 'year': 'keep_as_is', 'ratio': 'keep_as_is', 'percentage_numeric': 'keep_as_is', 'skewed_positive_numeric': 'log_transform', 'numeric': 'standard_scale',
  'datetime': 'datetime_extract_year', 'currency': 'currency_normalize', 'percentage': 'percentage_to_decimal', 'numeric_string': 'parse_numeric', 'boolean_like': 'parse_boolean',
  'datetime_like': 'parse_datetime', 'email': 'email_validate', 'phone': 'phone_standardize', 'url': 'url_parse', 'uuid': 'keep_as_is', 'high_cardinality_identifier': 'hash_encode',
  'high_cardinality_categorical': 'frequency_encode', 'text': 'text_vectorize_tfidf', 'unknown': 'keep_as_is'}}[column_class] END AS suggested_action
FROM (SELECT *, {_CLASS} AS column_class FROM {profile_sql("messy", "customer", "events", semantics=True)} p) c""")
def _(load):
    found = semantic.column_classes(profile(frames(load, "messy", "customer", "events"), WITH_SEMANTICS))
    return found.select(*KEYS, "column_class", "suggested_action")


_EDGE = " OR ".join(f"starts_with(n, '{w}') OR ends_with(n, '_{w}')" for w in K.TARGET_EXCLUSIONS)
_ANYWHERE = " OR ".join(f"contains(n, '{w}')" for w in K.TARGET_EXCLUSIONS_ANYWHERE)
_EXACT = ", ".join(f"'{w}'" for w in {w.replace("_", "") for w in K.EXACT_TARGETS})
_WORDS = "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN {0.85 if w in K.STRONG_TARGET_KEYWORDS else 0.7}::DOUBLE" for w in K.TARGET_KEYWORDS) + " END"
_TARGETS = f"""
b AS (SELECT *, lower(column_name) AS n, position = max(position) OVER (PARTITION BY table_name) AS last,
  CASE WHEN unique_count = 2 AND ((is_numeric AND min_value = 0 AND max_value = 1) OR in_binary_set) THEN 0.85::DOUBLE
  WHEN unique_count > 2 AND unique_count <= 20 AND unique_count / present < 0.1 THEN 0.7::DOUBLE
  WHEN is_numeric AND unique_count / present > 0.5 AND std / abs(mean) > 0.1 AND std / abs(mean) < 5 THEN 0.65::DOUBLE END AS stats
  FROM {profile_sql("orders", "customer", "lineitem", "messy", semantics=True)} p),
m AS (SELECT *, CASE WHEN {_EDGE} OR {_ANYWHERE} THEN 'exclusion' WHEN regexp_replace(n, '[_ -]', '', 'g') IN ({_EXACT}) THEN 'exact_name' WHEN {_WORDS} IS NOT NULL THEN 'keyword'
  WHEN last AND stats IS NOT NULL THEN 'position_plus_stats' WHEN stats >= 0.8 THEN 'statistical' ELSE 'no_match' END AS target_method FROM b),
t AS (SELECT *, target_method NOT IN ('exclusion', 'no_match') AS is_target, round(CASE target_method WHEN 'exclusion' THEN 0.95 WHEN 'exact_name' THEN 0.95 WHEN 'keyword' THEN {_WORDS}
  WHEN 'position_plus_stats' THEN stats * 0.8 WHEN 'statistical' THEN stats * 0.6 ELSE 0.7 END, 6) AS target_confidence FROM m)"""


def _target_rows(load):
    return semantic.target_columns(profile(frames(load, "orders", "customer", "lineitem", "messy"), WITH_SEMANTICS))


@query("p23_target_detection", f"WITH {_TARGETS} SELECT table_name, column_name, is_target, target_confidence, target_method FROM t")
def _(load):
    return _target_rows(load).select(*KEYS, "is_target", r("target_confidence").alias("target_confidence"), "target_method")


@query("p23_likely_targets", f"WITH {_TARGETS} SELECT table_name, column_name, target_confidence, target_method FROM t WHERE is_target AND target_confidence >= 0.6")
def _(load):
    return semantic.likely_targets(_target_rows(load)).withColumn("target_confidence", r("target_confidence"))


@query("p24_protected_columns", f"""WITH {_TARGETS} SELECT table_name, column_name,
  (is_target AND target_confidence >= 0.6) OR {" OR ".join(f"contains(n, '{w}')" for w in K.PROTECTED_KEYWORDS)} AS is_protected FROM t""")
def _(load):
    return semantic.protected_columns(_target_rows(load)).select(*KEYS, "is_protected")
