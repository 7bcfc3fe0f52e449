"""Queries for recommendations over profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.profiles import _TARGETS, _semantic_sql
from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import frames, profile_sql
from colsmith.operators.profile import ALL_PARTS, WITH_SEMANTICS, profile
from colsmith.plans import recommend as R
from colsmith.plans.actions import FALLBACKS, REGISTRY  # noqa: F401
from colsmith.plans.rules import FAMILIES, Rule, catalogue

KEYS = ["table_name", "column_name"]
NAMES = ("customer", "orders", "part", "lineitem", "events", "messy")


def _profile(load, parts=ALL_PARTS, names=NAMES):
    return profile(frames(load, *names), parts)


def _stats_cte(names=NAMES):
    fields = ", ".join(f"{e} AS {n}" for n, e in R.statistics_sql().items())
    extra = "zeros, present, min_value IS NULL AS no_range"
    return f"s AS MATERIALIZED (SELECT table_name, column_name, {fields}, {extra} FROM {profile_sql(*names)} p)"


def _match_cte(rules):
    """Every firing rule of every column, in rule order."""
    branches = " UNION ALL ".join(
        f"SELECT table_name, column_name, CAST({rule.confidence} AS DOUBLE) AS confidence, {place} AS place, '{rule.action}' AS action, '{rule.name}' AS rule "
        f"FROM s WHERE {rule.condition}" for place, rule in enumerate(rules))
    return f"m AS MATERIALIZED ({branches})"


_CALIBRATED = """(CASE WHEN confidence > 0.95 THEN greatest(confidence * 0.9, 0.92) ELSE confidence * 0.9 END
  * CASE action WHEN 'drop_column' THEN 0.95 WHEN 'keep_as_is' THEN 0.75 ELSE 1 END)"""
_BEST = """b AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY confidence DESC, place) AS nth FROM m QUALIFY nth = 1)"""
_FEW = "is_string AND unique_count BETWEEN 2 AND 3 AND NOT has_delimiters"
_TAILS = "is_numeric AND has_range AND abs(skewness) <= 1.5 AND iqr > 0 AND far_outlier_pct > 0.01"
_RULED = f"""d AS (SELECT s.table_name, s.column_name,
  CASE WHEN {_FEW} THEN 'label_encode' WHEN {_TAILS} THEN 'robust_scale' ELSE coalesce(b.action, 'keep_as_is') END AS action,
  CASE WHEN {_FEW} THEN 0.95::DOUBLE WHEN {_TAILS} THEN 0.9::DOUBLE WHEN b.action IS NULL THEN 0.5::DOUBLE ELSE {_CALIBRATED.replace('confidence', 'b.confidence').replace('CASE action', 'CASE b.action')} END AS confidence,
  CASE WHEN {_FEW} THEN 'CLEAN_LOW_CARDINALITY' WHEN {_TAILS} THEN 'OUTLIER_AWARE_SCALING' ELSE coalesce(b.rule, 'NO_RULE') END AS rule
  FROM s LEFT JOIN b USING (table_name, column_name))"""
RULED = f"{_stats_cte()}, {_match_cte(catalogue())}, {_BEST}, {_RULED}"


@query("d1_target_protection", "SELECT 'orders' AS table_name, 'o_totalprice' AS column_name, 'keep_as_is' AS action, 0.99::DOUBLE AS confidence FROM (SELECT count(*) FROM orders) t")
def _(load):
    found = R.rule_decisions(_profile(load, names=("orders",)), target=" O_TotalPrice ")
    return found.where(F.col("rule") == "TARGET").select(*KEYS, "action", "confidence")


@query("d2_low_cardinality_shortcut", f"WITH {_stats_cte()} SELECT table_name, column_name, 'label_encode' AS action, 0.95::DOUBLE AS confidence FROM s WHERE {_FEW}")
def _(load):
    return R.rule_decisions(_profile(load)).where(F.col("rule") == "CLEAN_LOW_CARDINALITY").select(*KEYS, "action", "confidence")


@query("d3_outlier_shortcut", f"WITH {_stats_cte()} SELECT table_name, column_name, 'robust_scale' AS action FROM s WHERE {_TAILS} AND NOT ({_FEW})")
def _(load):
    return R.rule_decisions(_profile(load)).where(F.col("rule") == "OUTLIER_AWARE_SCALING").select(*KEYS, "action")


@query("d4_rule_matches", f"WITH {_stats_cte()}, {_match_cte(catalogue())} SELECT table_name, column_name, rule, action, round(confidence, 6) AS confidence FROM m")
def _(load):
    found = R.match_rules(R.rule_statistics(_profile(load)))
    return found.select(*KEYS, F.explode("matches").alias("m")).select(*KEYS, "m.rule", "m.action", r("m.confidence").alias("confidence"))


# Definitions of the rules of three families over profile columns, written apart from the catalogue (fixed values): name, action, confidence, condition.
_SPELLED_OUT = (
    ("DROP_IF_MOSTLY_NULL", "drop_column", "CASE WHEN null_pct >= 0.95 THEN 0.95 ELSE least(0.75, null_pct * 0.875) END", "null_pct > 0.8 OR present = 0"),
    ("DROP_IF_CONSTANT", "drop_column", "0.75", "unique_count = 1 AND null_pct < 0.5"),
    ("DROP_IF_ALL_UNIQUE", "drop_column", "0.65", "NOT is_numeric AND row_count > 1000 AND unique_ratio > 0.995 AND avg_length > 20"),
    ("REMOVE_DUPLICATES", "remove_duplicates", "least(0.85, 0.6 + (row_count - unique_count) / row_count / 4)",
     "NOT is_categorical AND row_count > 100 AND unique_ratio < 0.1 AND (row_count - unique_count) / row_count > 0.7"),
    ("CONSERVATIVE_FALLBACK", "keep_as_is", "0.5", "null_pct < 0.3 AND unique_count > 1 AND unique_ratio < 0.99"),
    ("KEEP_IF_PRIMARY_KEY", "keep_as_is", "0.95", "unique_ratio > 0.95 AND unique_count > 10 AND null_pct < 0.05"),
    ("KEEP_IF_ORDINAL_OR_YEAR", "keep_as_is", "0.6", "is_numeric AND null_pct < 0.1 AND (min_value >= 1900 AND max_value <= 2100 AND unique_count <= 200 OR unique_count <= 10 AND max_value <= 10)"),
    ("KEEP_IF_ALREADY_NORMALIZED", "keep_as_is", "0.92", "is_numeric AND null_pct < 0.05 AND mean BETWEEN -0.5 AND 0.5 AND std BETWEEN 0.8 AND 1.2 AND skew BETWEEN -0.5 AND 0.5"),
    ("KEEP_IF_GOOD_DISTRIBUTION", "keep_as_is", "0.6", "is_numeric AND null_pct < 0.05 AND abs(skew) < 1 AND outlier_count = 0 AND coalesce(cv, 100) < 2"),
    ("KEEP_IF_CATEGORICAL_CLEAN", "keep_as_is", "0.85", "is_categorical AND null_pct < 0.05 AND unique_count BETWEEN 2 AND 50 AND unique_ratio < 0.8"),
    ("KEEP_IF_NO_QUALITY_ISSUES", "keep_as_is", "0.55", "null_pct = 0 AND unique_ratio > 0.05 AND unique_ratio < 0.95 AND coalesce(outlier_count, 0) = 0"),
    ("FILL_NULL_MEDIAN_NUMERIC", "fill_null_median", "0.85", "is_numeric AND null_pct > 0.05 AND null_pct < 0.3 AND outlier_count > 0"),
    ("FILL_NULL_MEAN_NUMERIC", "fill_null_mean", "0.9", "is_numeric AND null_pct > 0.05 AND null_pct < 0.3 AND outlier_count = 0 AND abs(skew) < 1"),
    ("FILL_NULL_MODE_CATEGORICAL", "fill_null_mode", "0.85", "is_categorical AND null_pct > 0.05 AND null_pct < 0.3"),
    ("FILL_NULL_FORWARD_TIMESERIES", "fill_null_forward", "0.88", "is_temporal AND null_pct < 0.2"),
    ("DROP_IF_HIGH_NULL_NO_PATTERN", "drop_column", "0.75", "null_pct > 0.4 AND null_pct <= 0.6"),
    ("KEEP_IF_LOW_NULL_GOOD_QUALITY", "keep_as_is", "0.7", "null_pct < 0.05 AND unique_ratio > 0.1 AND unique_ratio < 0.9"),
    ("PARSE_DATETIME_ISO", "parse_datetime", "least(0.98, matches_iso_datetime)", "is_string AND matches_iso_datetime > 0.8"),
    ("PARSE_DATETIME_COMMON", "parse_datetime", "least(0.95, matches_date_pattern)", "is_string AND matches_date_pattern > 0.85"),
    ("PARSE_BOOLEAN_TF", "parse_boolean", "0.98", "unique_count <= 3 AND matches_boolean_tf > 0.9"),
    ("PARSE_BOOLEAN_YN", "parse_boolean", "0.98", "unique_count <= 3 AND matches_boolean_yn > 0.9"),
    ("PARSE_BOOLEAN_01", "parse_boolean", "0.85", "unique_count <= 3 AND matches_boolean_01 > 0.9"),
    ("PARSE_NUMERIC_STRING", "parse_numeric", "least(0.95, matches_numeric_pattern)", "is_string AND matches_numeric_pattern > 0.9"),
    ("PARSE_JSON_STRUCTURE", "parse_json", "least(0.92, matches_json)", "is_string AND matches_json > 0.85"),
    ("PARSE_CATEGORICAL_LOW_CARDINALITY", "parse_categorical", "0.88", "is_string AND unique_count < 50 AND unique_ratio < 0.5"),
    ("LOG_TRANSFORM_HIGH_SKEW", "log_transform", "least(0.95, 0.6 + skew / 20)", "is_numeric AND skew > 2 AND min_value > 0 AND max_value - min_value > 100"),
    ("LOG1P_TRANSFORM_WITH_ZEROS", "log1p_transform", "0.92", "is_numeric AND skew > 2 AND min_value >= 0 AND zeros > 0 AND max_value - min_value > 100"),
    ("BOX_COX_MODERATE_SKEW", "box_cox", "0.88", "is_numeric AND skew > 1.5 AND skew < 2 AND min_value > 0"),
    ("YEO_JOHNSON_NEGATIVE_VALUES", "yeo_johnson", "0.85", "is_numeric AND abs(skew) > 1.5 AND min_value <= 0"),
    ("CLIP_OUTLIERS_HIGH_PERCENTAGE", "clip_outliers", "least(0.9, 0.6 + 0.3 * outlier_count / present)", "is_numeric AND outlier_count / present > 0.1"),
    ("WINSORIZE_MODERATE_OUTLIERS", "winsorize", "0.85", "is_numeric AND outlier_count / present > 0.05 AND outlier_count / present <= 0.1"),
    ("STANDARD_SCALE_NORMAL", "standard_scale", "0.9", "is_numeric AND abs(skew) < 0.5 AND coalesce(outlier_count / present, 0) < 0.05 AND NOT scaled"),
    ("ROBUST_SCALE_WITH_OUTLIERS", "robust_scale", "0.92", "is_numeric AND outlier_count / present >= 0.05 AND outlier_count / present < 0.1 AND NOT scaled"),
    ("MINMAX_SCALE_BOUNDED", "minmax_scale", "0.85", "is_numeric AND min_value >= 0 AND max_value <= 100 AND outlier_count / present < 0.02"),
    ("QUANTILE_TRANSFORM_BIMODAL", "quantile_transform", "0.8", "is_numeric AND kurtosis < -1"),
)
_SPELLED_BASE = f"""a AS MATERIALIZED (SELECT *, coalesce(skewness, 0) AS skew, coalesce(abs(mean) < 0.1 AND std > 0.8 AND std < 1.2, FALSE) AS scaled FROM {profile_sql(*NAMES)} p)"""


@query("d4_spelled_out_rules", f"WITH {_SPELLED_BASE} " + " UNION ALL ".join(
    f"SELECT table_name, column_name, '{n}' AS rule, '{a}' AS action, round(CAST({c} AS DOUBLE), 6) AS confidence FROM a WHERE {w}" for n, a, c, w in _SPELLED_OUT))
def _(load):
    rules = [x for x in catalogue() if x.family in ("data_quality", "type_detection", "statistical")]
    found = R.match_rules(R.rule_statistics(_profile(load)), rules)
    return found.select(*KEYS, F.explode("matches").alias("m")).select(*KEYS, "m.rule", "m.action", r("m.confidence").alias("confidence"))


def _family_query(family):
    rules = [x for x in catalogue() if x.family == family.__name__]

    @query(f"d4_family_{family.__name__}", f"WITH {_stats_cte(('orders', 'messy'))}, {_match_cte(rules)} SELECT table_name, column_name, rule, round(confidence, 6) AS confidence FROM m")
    def run(load):
        found = R.match_rules(R.rule_statistics(_profile(load, names=("orders", "messy"))), rules)
        return found.select(*KEYS, F.explode("matches").alias("m")).select(*KEYS, "m.rule", r("m.confidence").alias("confidence"))


for _family in (FAMILIES[0], FAMILIES[2], FAMILIES[9]):
    _family_query(_family)

_USER = Rule("KEEP_SMALL_CODES", "keep_as_is", 300, "0.999", "is_numeric AND unique_count < 30")


@query("d4_user_rule", f"WITH {_stats_cte()}, {_match_cte([_USER])} SELECT table_name, column_name, 'keep_as_is' AS action, round(0.92 * 0.75, 6)::DOUBLE AS confidence FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.table_name = m.table_name AND s.column_name = m.column_name AND ({_FEW} OR {_TAILS}))")
def _(load):
    found = R.rule_decisions(_profile(load), rules=[*catalogue(), _USER])
    return found.where(F.col("rule") == "KEEP_SMALL_CODES").select(*KEYS, "action", r("confidence").alias("confidence"))


@query("d5_calibrated_decisions", f"WITH {RULED} SELECT table_name, column_name, action, round(confidence, 6) AS confidence, rule FROM d")
def _(load):
    return R.rule_decisions(_profile(load)).select(*KEYS, "action", r("confidence").alias("confidence"), "rule")


@query("d6_alternatives", f"""WITH {RULED}, a AS (SELECT m.table_name, m.column_name, m.action, m.confidence * 0.9 AS confidence,
  row_number() OVER (PARTITION BY m.table_name, m.column_name ORDER BY place) AS nth FROM m JOIN d USING (table_name, column_name) WHERE m.action <> d.action AND d.rule NOT IN ('CLEAN_LOW_CARDINALITY', 'OUTLIER_AWARE_SCALING'))
SELECT table_name, column_name, action, round(confidence, 6) AS confidence FROM a WHERE nth <= 3""")
def _(load):
    found = R.rule_decisions(_profile(load))
    return found.select(*KEYS, F.explode("alternatives").alias("a")).select(*KEYS, "a.action", r("a.confidence").alias("confidence"))


_PROPOSED = ("standard_scale", "log_transform", "parse_datetime", "hash_encode", "onehot_encode", "clip_outliers", "text_clean", "drop_column")


def _proposals(found):
    return found.select(*KEYS, F.explode(F.array(*[F.lit(a) for a in _PROPOSED])).alias("action"))


_PROPOSED_SQL = "(SELECT unnest([" + ", ".join(f"'{a}'" for a in _PROPOSED) + "]) AS action)"
_BASE = profile_sql(*NAMES, text=False)


@query("d7_safety", f"""
WITH q AS (SELECT p.*, action, CASE WHEN action IN ('standard_scale', 'log_transform') AND NOT is_numeric THEN 'needs numbers'
  WHEN action = 'log_transform' AND min_value < 0 THEN 'contains negative values'
  WHEN action = 'parse_datetime' AND is_numeric AND min_value BETWEEN 1900 AND 2100 AND max_value BETWEEN 1900 AND 2100 THEN 'numeric years'
  WHEN action = 'hash_encode' AND is_numeric AND unique_count > 50 THEN 'continuous numbers' WHEN action = 'onehot_encode' AND unique_count > 50 THEN 'too many values' END AS problem
  FROM {_BASE} p, {_PROPOSED_SQL} a)
SELECT table_name, column_name, action, problem IS NULL AS is_safe, problem, CASE WHEN problem IS NULL THEN action WHEN is_string AND unique_count <= 10 THEN 'onehot_encode'
  WHEN is_string AND unique_count <= 50 THEN 'label_encode' WHEN is_string THEN 'keep_as_is' WHEN is_numeric THEN 'standard_scale' ELSE 'keep_as_is' END AS suggested_action FROM q""")
def _(load):
    found = _profile(load, {"numbers", "values"})
    return R.safety(_proposals(found), found)


_SKEW = "(skewness * (present - 2) / sqrt(present * (present - 1.0::DOUBLE)))"
_HYBRID = f"""h AS (SELECT *, CASE WHEN (is_numeric AND std_pop <= 1e-10) OR unique_count = 1 THEN 1
  WHEN (contains(lower(column_name), 'id') OR contains(lower(column_name), 'key') OR contains(lower(column_name), 'uuid') OR contains(lower(column_name), 'index')) AND unique_ratio > 0.95 THEN 2
  WHEN is_numeric AND min_value > 0 AND abs({_SKEW}) > 2 THEN 4
  WHEN is_numeric AND iqr > 0 AND outlier_pct > 0.15 THEN 5 WHEN is_numeric AND range_size > 1e-10 AND (std_pop > 100 OR range_size > 1000) THEN 6
  WHEN unique_ratio < 0.01 THEN 7 WHEN null_pct > 0.6 THEN 8 END AS nth FROM {_BASE} p)"""
_HYBRID_ACTION = "CASE nth WHEN 1 THEN 'drop_column' WHEN 2 THEN 'drop_column' WHEN 4 THEN 'log_transform' WHEN 5 THEN 'clip_outliers' WHEN 6 THEN 'standard_scale' WHEN 7 THEN 'keep_as_is' WHEN 8 THEN 'drop_column' END"
_HYBRID_CONF = "CASE nth WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 4 THEN 0.88 WHEN 5 THEN 0.83 WHEN 6 THEN 0.82 WHEN 7 THEN 0.75 WHEN 8 THEN 0.8 ELSE 0 END::DOUBLE"


@query("d8_hybrid_rules", f"WITH {_HYBRID} SELECT table_name, column_name, {_HYBRID_ACTION} AS rule_action, {_HYBRID_CONF} AS rule_confidence FROM h")
def _(load):
    return R.hybrid_rules(_profile(load, {"numbers", "values", "quartiles"})).select(*KEYS, "rule_action", "rule_confidence")


@query("d9_hybrid_table", f"""WITH {_HYBRID} SELECT table_name, column_name, coalesce({_HYBRID_ACTION}, 'keep_as_is') AS action, {_HYBRID_CONF} AS confidence,
  CASE WHEN nth IS NULL THEN 'ml' ELSE 'rule' END AS source FROM h WHERE column_name <> 'o_totalprice'""")
def _(load):
    return R.hybrid_decisions(_profile(load, {"numbers", "values", "quartiles"}), target="o_totalprice").select(*KEYS, "action", "confidence", "source")


# A stand-in for model output, made from the profile itself.
_MODEL = "CASE WHEN is_numeric THEN 'standard_scale' ELSE 'drop_column' END"
_MODEL_CONF = "round(0.4 + 0.5 * unique_ratio, 6)"


def _predictions(found):
    return found.select(*KEYS, F.expr(_MODEL).alias("model_action"), F.expr(_MODEL_CONF).cast("double").alias("model_confidence"))


_MODELLED = f"{RULED}, x AS (SELECT d.*, {_MODEL} AS model_action, ({_MODEL_CONF})::DOUBLE AS model_confidence, is_numeric FROM d JOIN s USING (table_name, column_name))"


@query("d10_blend", f"""WITH {_MODELLED} SELECT table_name, column_name, CASE WHEN action = model_action OR confidence > model_confidence THEN action ELSE model_action END AS action,
  round(CASE WHEN action = model_action THEN least(0.95, (confidence + model_confidence) / 2 + 0.1) ELSE greatest(confidence, model_confidence) * 0.9 END, 6) AS confidence FROM x""")
def _(load):
    found = _profile(load)
    both = R.rule_decisions(found).join(_predictions(found), KEYS)
    action, confidence = R.blend(F.col("action"), F.col("confidence"), F.col("model_action"), F.col("model_confidence"))
    return both.select(*KEYS, action.alias("action"), r(confidence).alias("confidence"))


@query("d11_model_action_check", f"""WITH {_MODELLED}, y AS (SELECT table_name, column_name, is_numeric, action, confidence, unnest(['standard_scale', 'fill_null_mean', 'label_encode', 'drop_column']) AS proposed FROM x)
SELECT table_name, column_name, proposed, CASE WHEN proposed IN ('standard_scale', 'fill_null_mean') AND NOT is_numeric THEN CASE WHEN proposed = 'fill_null_mean' THEN 'fill_null_mode' ELSE 'keep_as_is' END
  WHEN proposed = 'label_encode' AND is_numeric THEN 'keep_as_is' WHEN proposed = 'drop_column' AND action = 'keep_as_is' AND confidence > 0.6 THEN 'keep_as_is' ELSE proposed END AS action FROM y""")
def _(load):
    found = _profile(load)
    rows = R.rule_decisions(found).join(found.select(*KEYS, "is_numeric"), KEYS).withColumn(
        "proposed", F.explode(F.array(*[F.lit(a) for a in ("standard_scale", "fill_null_mean", "label_encode", "drop_column")])))
    return rows.select(*KEYS, "proposed", R.sound_model_action(F.col("proposed"), F.col("is_numeric"), F.col("action"), F.col("confidence")).alias("action"))


_SAFE = """CASE WHEN null_pct > 0.5 THEN 'keep_as_is' WHEN is_numeric AND range_size > 1000 THEN 'robust_scale' WHEN is_numeric THEN 'keep_as_is'
  WHEN is_categorical AND unique_count <= 10 THEN 'onehot_encode' WHEN is_categorical AND unique_count <= 1000 THEN 'frequency_encode' WHEN is_categorical THEN 'hash_encode' ELSE 'keep_as_is' END"""
_SAFE_CONF = """CASE WHEN null_pct > 0.5 THEN 0.6 WHEN is_numeric AND range_size > 1000 THEN 0.65 WHEN is_numeric THEN 0.7
  WHEN is_categorical AND unique_count <= 10 THEN 0.68 WHEN is_categorical AND unique_count <= 1000 THEN 0.65 WHEN is_categorical THEN 0.68 ELSE 0.6 END::DOUBLE"""


@query("d12_conservative_fallback", f"SELECT table_name, column_name, {_SAFE} AS safe_action, {_SAFE_CONF} AS safe_confidence FROM {_BASE} p")
def _(load):
    return R.conservative(_profile(load, {"numbers", "values"}))


_DECIDED = f"""{RULED}, f AS (SELECT d.table_name, d.column_name, is_numeric, unique_count, CASE WHEN d.confidence >= 0.65 AND NOT unsafe THEN 'symbolic' WHEN d.confidence > 0.5 THEN 'symbolic' ELSE 'conservative_fallback' END AS source,
  CASE WHEN d.confidence > 0.5 THEN d.action ELSE {_SAFE} END AS action, CASE WHEN d.confidence > 0.5 THEN d.confidence ELSE {_SAFE_CONF} END AS confidence, rule
  FROM d JOIN s USING (table_name, column_name), (SELECT FALSE AS unsafe) u)"""


@query("d13_context_bias", f"""WITH {_DECIDED} SELECT table_name, column_name, CASE WHEN action = 'keep_as_is' AND is_numeric THEN 'standard_scale' ELSE action END AS action,
  CASE WHEN action = 'keep_as_is' AND is_numeric THEN 'context_bias' ELSE source END AS source FROM f WHERE action <> 'label_encode'""")
def _(load):
    found = R.recommend(_profile(load), context="regression")
    return found.where(~F.col("action").isin("label_encode", "onehot_encode") | (F.col("source") != "context_bias")).where(F.col("action") != "label_encode").select(*KEYS, "action", "source")


@query("d14_warnings", f"""WITH {_DECIDED} SELECT table_name, column_name, confidence < 0.5 AS require_manual_review,
  CASE WHEN confidence < 0.5 THEN 'confidence under one half: a person should decide' WHEN confidence < 0.7 THEN 'confidence under 0.7: worth a look' END AS warning FROM f""")
def _(load):
    return R.recommend(_profile(load)).select(*KEYS, "require_manual_review", "warning")


@query("d15_decisions", f"WITH {_DECIDED} SELECT table_name, column_name, action, round(confidence, 6) AS confidence, source, rule FROM f")
def _(load):
    return R.recommend(_profile(load)).select(*KEYS, "action", r("confidence").alias("confidence"), "source", "rule")


_UNSAFE = """coalesce(action IN ('standard_scale', 'robust_scale', 'minmax_scale', 'log_transform', 'log1p_transform') AND NOT is_numeric, FALSE)
  OR coalesce(action IN ('log_transform', 'log1p_transform') AND min_value < 0, FALSE) OR coalesce(action = 'hash_encode' AND is_numeric AND unique_count > 50, FALSE)
  OR coalesce(action = 'parse_datetime' AND is_numeric AND min_value BETWEEN 1900 AND 2100 AND max_value BETWEEN 1900 AND 2100, FALSE) OR coalesce(action = 'onehot_encode' AND unique_count > 50, FALSE)"""
_WITH_MODEL = f"""{RULED}, x AS (SELECT d.*, {_MODEL} AS model_action, ({_MODEL_CONF})::DOUBLE AS model_confidence, is_numeric, d.confidence >= 0.65 AND NOT ({_UNSAFE}) AS sure
  FROM d JOIN s USING (table_name, column_name) WHERE column_name <> 'o_totalprice')"""


@query("d15_decisions_with_model", f"""WITH {_WITH_MODEL} SELECT table_name, column_name,
  CASE WHEN sure OR (confidence > 0.5 AND (action = model_action OR confidence > model_confidence)) THEN action WHEN confidence > 0.5 THEN model_action
  WHEN model_action = 'standard_scale' AND NOT is_numeric THEN 'keep_as_is' WHEN model_action = 'drop_column' AND action = 'keep_as_is' AND confidence > 0.6 THEN 'keep_as_is' ELSE model_action END AS action,
  round(CASE WHEN sure THEN confidence WHEN confidence > 0.5 AND action = model_action THEN least(0.95, (confidence + model_confidence) / 2 + 0.1)
  WHEN confidence > 0.5 THEN greatest(confidence, model_confidence) * 0.9 ELSE model_confidence END, 6) AS confidence, CASE WHEN sure THEN 'symbolic' ELSE 'neural' END AS source FROM x""")
def _(load):
    found = _profile(load)
    return R.recommend(found, target="o_totalprice", predictions=_predictions(found)).select(*KEYS, "action", r("confidence").alias("confidence"), "source")


_VALIDATED = ("orders", "customer", "messy")
_CHECKED = f"""WITH {_TARGETS}, y AS ({_semantic_sql(_VALIDATED)}),
k AS (SELECT t.*, semantic_type AS kind, action, is_target AND target_confidence >= 0.7 AS aimed, semantic_type = 'numeric' OR is_numeric AS number,
  action IN ('standard_scale', 'log_transform', 'clip_outliers') AS numbers_only, coalesce(sem_number, 0) * present / row_count AS parsed
  FROM t JOIN y USING (table_name, column_name), {_PROPOSED_SQL} a WHERE table_name IN {_VALIDATED}),
c AS (SELECT *, [CASE WHEN aimed AND action IN ('drop_column', 'clip_outliers') THEN '!keep_as_is' WHEN aimed AND action IN ('standard_scale', 'log_transform') THEN '?' ELSE '' END,
  CASE WHEN number OR NOT numbers_only THEN '' WHEN parsed >= 0.8 THEN '?' WHEN kind = 'text' THEN '!keep_as_is' ELSE '!text_clean' END,
  CASE WHEN action <> 'log_transform' THEN '' WHEN NOT is_numeric THEN '!keep_as_is' WHEN present = 0 THEN '!drop_column' ELSE '' END,
  CASE WHEN action <> 'onehot_encode' OR unique_count <= 20 THEN '' WHEN unique_count <= 50 THEN '?' WHEN unique_count < 1000 THEN '!frequency_encode' ELSE '!hash_encode' END,
  CASE WHEN action <> 'text_clean' THEN '' WHEN kind IN ('url', 'phone', 'email', 'identifier') THEN '!drop_column' WHEN kind = 'text' AND coalesce(avg_length, 0) < 5 THEN '?' ELSE '' END,
  CASE WHEN kind = 'empty' AND action <> 'drop_column' THEN '' WHEN null_pct > 0.9 THEN '?' ELSE '' END] AS results, kind = 'empty' AND action <> 'drop_column' AS emptied FROM k),
w AS (SELECT *, list_filter(results, lambda v: v LIKE '!%') AS blocked, len(list_filter(results, lambda v: v = '?')) AS doubts FROM c)
SELECT table_name, column_name, action AS original_action, emptied OR len(blocked) = 0 AS is_valid, CASE WHEN emptied THEN 'drop_column' WHEN len(blocked) = 0 THEN action ELSE substr(blocked[1], 2) END AS recommended_action,
  CAST(len(blocked) AS INTEGER) AS blockers, CAST(doubts AS INTEGER) AS warnings FROM w"""


@query("d16_action_validation", _CHECKED)
def _(load):
    found = _profile(load, WITH_SEMANTICS, _VALIDATED)
    return R.validate_actions(found, _proposals(found)).drop("checks")


_TYPED = _semantic_sql()


@query("d16_target_and_number_checks", f"""WITH {_TARGETS}, y AS ({_TYPED}), k AS (SELECT t.*, y.semantic_type, action FROM t JOIN y USING (table_name, column_name), {_PROPOSED_SQL} a WHERE table_name IN ('customer', 'messy'))
SELECT table_name, column_name, action AS original_action, is_target AND target_confidence >= 0.7 AND action IN ('drop_column', 'clip_outliers') AS target_blocked,
  action IN ('standard_scale', 'log_transform', 'clip_outliers') AND NOT is_numeric AND semantic_type <> 'numeric' AND coalesce(sem_number * present / row_count, 0) < 0.8 AS number_blocked,
  action = 'onehot_encode' AND unique_count > 50 AS cardinality_blocked, action = 'text_clean' AND semantic_type IN ('url', 'phone', 'email', 'identifier') AS text_blocked FROM k""")
def _(load):
    found = _profile(load, WITH_SEMANTICS, ("customer", "messy"))
    checked = R.validate_actions(found, _proposals(found))

    def blocked(name):
        return F.exists("checks", lambda c: (c["check"] == name) & (c["result"] == "invalid"))

    return checked.select(*KEYS, "original_action", blocked("target_protection").alias("target_blocked"), blocked("numeric_requirement").alias("number_blocked"),
                          blocked("cardinality_limits").alias("cardinality_blocked"), blocked("text_meaningfulness").alias("text_blocked"))


@query("d17_action_by_type", f"""WITH y AS ({_TYPED}) SELECT table_name, column_name, semantic_type, CASE semantic_type WHEN 'numeric' THEN CASE WHEN abs(coalesce(skewness, 0)) > 2 AND coalesce(min_value, 0) >= 0 THEN 'log1p_transform'
  WHEN abs(coalesce(skewness, 0)) < 1 THEN 'standard_scale' ELSE 'robust_scale' END WHEN 'categorical' THEN CASE WHEN unique_count <= 50 THEN 'onehot_encode' ELSE 'frequency_encode' END
  WHEN 'datetime' THEN 'datetime_extract' WHEN 'boolean' THEN 'parse_boolean' WHEN 'text' THEN 'text_clean' ELSE 'drop_column' END AS action
  FROM y JOIN {profile_sql("messy", "customer", "events", text=False)} p USING (table_name, column_name)""")
def _(load):
    return R.action_by_type(_profile(load, WITH_SEMANTICS, ("messy", "customer", "events")))


@query("d18_applicable_actions", f"""SELECT table_name, column_name, action FROM {_BASE} p, (VALUES ('keep_as_is', FALSE, FALSE, FALSE, FALSE, FALSE), ('drop_column', FALSE, FALSE, FALSE, FALSE, FALSE),
  ('drop_if_mostly_null', FALSE, FALSE, FALSE, FALSE, FALSE), ('drop_if_constant', FALSE, FALSE, FALSE, FALSE, FALSE), ('drop_if_all_unique', FALSE, FALSE, FALSE, FALSE, FALSE),
  ('standard_scale', TRUE, FALSE, FALSE, FALSE, FALSE), ('robust_scale', TRUE, FALSE, FALSE, FALSE, FALSE), ('log_transform', TRUE, FALSE, TRUE, FALSE, FALSE), ('box_cox', TRUE, FALSE, TRUE, FALSE, FALSE),
  ('onehot_encode', FALSE, TRUE, FALSE, TRUE, FALSE), ('target_encode', FALSE, TRUE, FALSE, FALSE, TRUE), ('datetime_extract_year', FALSE, FALSE, FALSE, FALSE, FALSE),
  ('cyclic_time_encode', FALSE, FALSE, FALSE, FALSE, FALSE), ('text_vectorize_tfidf', FALSE, FALSE, FALSE, FALSE, FALSE), ('geo_cluster_kmeans', TRUE, FALSE, FALSE, FALSE, FALSE)) a(action, num, cat, pos, few, many)
WHERE (NOT num OR is_numeric) AND (NOT cat OR is_categorical) AND (NOT pos OR coalesce(min_value > 0, FALSE)) AND (NOT few OR unique_count <= 10) AND (NOT many OR unique_count > 50)""")
def _(load):
    return R.applicable_actions(_profile(load, {"numbers", "values"}))


@query("d19_decision_statistics", f"""WITH {_DECIDED} SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS share,
  round(count(*) FILTER (confidence >= 0.65) / count(*), 6) AS high_confidence_share FROM f GROUP BY source""")
def _(load):
    found = R.decision_statistics(R.recommend(_profile(load)))
    return found.select("source", "n", r("share").alias("share"), r("high_confidence_share").alias("high_confidence_share"))


def _shown(value, digits):
    """A number as text, halves away from zero."""
    return f"printf('%.{digits}f', round({value}, {digits}))"


_EXPLAINED = f"""WITH {_DECIDED}, e AS (SELECT f.table_name, f.column_name, f.action, f.confidence, s.* EXCLUDE (table_name, column_name) FROM f JOIN s USING (table_name, column_name))
SELECT table_name, column_name, action, 'Recommendation for ' || chr(39) || column_name || chr(39) || ': ' || action || ' (confidence ' || {_shown("confidence * 100", 1)} || '%, ' ||
  CASE WHEN confidence >= 0.95 THEN 'very high: safe to apply' WHEN confidence >= 0.85 THEN 'high: apply' WHEN confidence >= 0.75 THEN 'good: apply, look at samples'
  WHEN confidence >= 0.65 THEN 'moderate: review' WHEN confidence >= 0.5 THEN 'low: decide by hand' ELSE 'very low: do not rely on it' END || ')' AS header,
  array_to_string(list_filter([CASE WHEN null_pct > 0.5 THEN {_shown("null_pct * 100", 1)} || '% of the values are missing' END, CASE WHEN unique_count = 1 THEN 'the column is constant' END,
    CASE WHEN abs(skewness) > 2 THEN 'strong skew (' || {_shown("skewness", 2)} || ')' END, CASE WHEN outlier_pct * 100 > 5 THEN {_shown("outlier_pct * 100", 1)} || '% of the values are outliers' END,
    CASE WHEN unique_ratio < 0.05 THEN 'few distinct values (' || unique_count || ')' END, CASE WHEN unique_count > 50 THEN 'many distinct values (' || unique_count || ')' END,
    CASE WHEN NOT no_range THEN 'values from ' || {_shown("min_value", 2)} || ' to ' || {_shown("max_value", 2)} END, CASE WHEN NOT no_range AND min_value > 0 THEN 'all values are positive' END], lambda v: v IS NOT NULL)[1:3], '; ') AS reasons FROM e"""


@query("d20_explained_reasons", _EXPLAINED)
def _(load):
    found = _profile(load)
    return R.explain(R.recommend(found), found).drop("statistics")


@query("d20_explanations")
def _(load):
    found = _profile(load)
    return R.explain(R.recommend(found), found)


@query("d21_evidence", f"""WITH {_DECIDED}, e AS (SELECT f.table_name, f.column_name, f.action, s.* EXCLUDE (table_name, column_name) FROM f JOIN s USING (table_name, column_name))
SELECT table_name, column_name, action, 'null_pct' AS metric, round(null_pct, 6) AS value, 0.6::DOUBLE AS threshold, '>' AS comparison FROM e WHERE action = 'drop_column'
UNION ALL SELECT table_name, column_name, action, 'unique_count', unique_count::DOUBLE, 1.0, '<=' FROM e WHERE action = 'drop_column'
UNION ALL SELECT table_name, column_name, action, 'unique_ratio', round(unique_ratio, 6), 0.95, '>' FROM e WHERE action = 'drop_column'
UNION ALL SELECT table_name, column_name, action, 'mean', round(mean, 6), 0.0, '!=' FROM e WHERE action LIKE '%\\_scale' ESCAPE '\\'
UNION ALL SELECT table_name, column_name, action, 'std', round(std, 6), 1.0, '!=' FROM e WHERE action LIKE '%\\_scale' ESCAPE '\\'
UNION ALL SELECT table_name, column_name, action, 'outlier_pct', round(outlier_pct, 6), 0.05, '<' FROM e WHERE action LIKE '%\\_scale' ESCAPE '\\'
UNION ALL SELECT table_name, column_name, action, 'unique_count', unique_count::DOUBLE, 50.0, '<=' FROM e WHERE action = 'onehot_encode'
UNION ALL SELECT table_name, column_name, action, 'null_pct', round(null_pct, 6), 0.8, '<' FROM e WHERE action = 'onehot_encode'
UNION ALL SELECT table_name, column_name, action, 'skewness', round(skewness, 6), 1.0, '>' FROM e WHERE action LIKE 'log%'
UNION ALL SELECT table_name, column_name, action, 'min_value', round(min_value, 6), 0.0, '>' FROM e WHERE action LIKE 'log%'
UNION ALL SELECT table_name, column_name, action, 'range_size', round(range_size, 6), 100.0, '>' FROM e WHERE action LIKE 'log%'""")
def _(load):
    found = _profile(load)
    return R.evidence(R.recommend(found), found).withColumn("value", r("value"))


@query("d22_label_bands", f"""WITH {_DECIDED} SELECT CASE WHEN f.confidence >= 0.9 THEN 'high' WHEN f.confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, f.action, count(*) AS n
FROM f JOIN s USING (table_name, column_name) WHERE present >= 10 GROUP BY ALL""")
def _(load):
    found = _profile(load)
    return R.action_counts(R.label_bands(R.recommend(found), found))
