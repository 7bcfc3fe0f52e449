"""Queries for learning from corrections. Corrections are derived from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.recommend import _BEST, _RULED, _match_cte, _stats_cte
from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import MESSY, messy, profile_sql
from colsmith.operators.profile import profile
from colsmith.plans import learning as L
from colsmith.plans.recommend import rule_decisions
from colsmith.plans.rules import catalogue

_PARTS = {"numbers", "values", "quartiles"}
_COLUMNS = list(MESSY)
_CORRECT = "CASE user_id % 3 WHEN 0 THEN 'log_transform' WHEN 1 THEN 'label_encode' ELSE 'drop_column' END"


def _corrections(load):
    names = F.array(*[F.lit(c) for c in _COLUMNS])
    return load("events").select(
        F.col("event_id").alias("correction_id"), "user_id", "ts", F.lit("messy").alias("table_name"), F.get(names, (F.col("event_id") % len(_COLUMNS)).cast("int")).alias("column_name"),
        F.col("event_type").alias("wrong_action"), F.expr(_CORRECT).alias("correct_action"), F.least(F.lit(1.0), F.col("value") / 100).alias("system_confidence"))


def _recorded(load):
    found = profile({"messy": messy(load)}, _PARTS)
    return L.record_corrections(_corrections(load), found), found


_LIST = "[" + ", ".join(f"'{c}'" for c in _COLUMNS) + "]"
_C = f"c AS (SELECT event_id AS correction_id, user_id, ts, {_LIST}[event_id % {len(_COLUMNS)} + 1] AS column_name, event_type AS wrong_action, {_CORRECT} AS correct_action, least(1.0, value / 100) AS system_confidence FROM events)"
_KIND = """CASE WHEN is_numeric THEN CASE WHEN null_pct > 0.5 THEN 'numeric_high_nulls' WHEN null_pct > 0.1 THEN 'numeric_medium_nulls' WHEN abs(coalesce(skewness, 0)) > 2 THEN 'numeric_high_skewness'
  WHEN abs(coalesce(skewness, 0)) > 1 THEN 'numeric_medium_skewness' WHEN coalesce(outlier_pct, 0) > 0.1 THEN 'numeric_many_outliers' ELSE 'numeric_normal' END
  WHEN is_string THEN CASE WHEN unique_ratio > 0.9 THEN 'categorical_high_uniqueness' WHEN unique_count > 50 THEN 'categorical_high_cardinality' WHEN unique_count < 10 THEN 'categorical_low_cardinality' ELSE 'categorical_medium_cardinality' END ELSE 'unknown' END"""
_P = f"p AS MATERIALIZED (SELECT *, {_KIND} AS pattern_type, coalesce(outlier_count > 0, FALSE) AS has_outliers FROM {profile_sql('messy', text=False)} x)"
_R = f"{_C}, {_P}, r AS (SELECT c.*, p.* EXCLUDE (column_name) FROM c JOIN p USING (column_name))"
_NUM = ("null_pct", "unique_ratio", "skewness", "kurtosis", "outlier_pct", "entropy")
_RULES = f"""{_R}, u AS (SELECT 'LEARNED_' || pattern_type || '_' || correct_action AS rule_name, pattern_type, correct_action AS recommended_action, count(*) AS support_count,
  least(0.95, 0.5 + count(*) / (count(*) + 10) / 2) AS base_confidence, {", ".join(f"avg({c}) AS t_{c}" for c in _NUM)}, avg(unique_count) AS t_cardinality,
  avg(is_numeric::INT) >= 0.5 AS t_is_numeric, avg(is_categorical::INT) >= 0.5 AS t_is_categorical, avg(is_temporal::INT) >= 0.5 AS t_is_temporal FROM r GROUP BY pattern_type, correct_action HAVING count(*) >= 10)"""


def _sim_sql():
    sign = lambda c: f"CASE WHEN {c} < -0.5 THEN -1 WHEN {c} > 0.5 THEN 1 ELSE 0 END"
    score, total = [], []
    for name, w in L.WEIGHTS.items():
        t, h = f"t_{name}", "unique_count" if name == "cardinality" else name
        if name == "is_boolean":
            score.append(f"{w}")
            total.append(f"{w}")
            continue
        total.append(f"CASE WHEN {t} IS NOT NULL THEN {w} ELSE 0 END")
        if name.startswith("is_"):
            score.append(f"CASE WHEN {t} = {h} THEN {w} ELSE 0 END")
        elif name in ("null_pct", "unique_ratio", "outlier_pct"):
            score.append(f"CASE WHEN abs({t} - {h}) <= 0.15 THEN {w} * (1 - abs({t} - {h}) / 0.15) ELSE 0 END")
        elif name in ("skewness", "kurtosis"):
            score.append(f"CASE WHEN {t} IS NOT NULL AND {h} IS NOT NULL AND {sign(t)} = {sign(h)} THEN {w} ELSE 0 END")
        elif name == "cardinality":
            gap = f"abs(log10(greatest({t}, 1)) - log10(greatest({h}, 1)))"
            score.append(f"CASE WHEN {t} > 0 AND {h} > 0 AND {gap} <= 1 THEN {w} * (1 - {gap}) ELSE 0 END")
    return f"(({' + '.join(score)}) / ({' + '.join(total)}))::DOUBLE"


_SIM = f"{_RULES}, s AS (SELECT p.table_name, p.column_name, u.*, {_sim_sql()} AS similarity FROM p, u)"


@query("l1_correction_records", f"WITH {_R} SELECT correction_id, column_name, wrong_action, correct_action, pattern_type, substr(sha256(pattern_type), 1, 16) AS pattern_hash, round(null_pct, 6) AS null_pct FROM r")
def _(load):
    return _recorded(load)[0].select("correction_id", "column_name", "wrong_action", "correct_action", "pattern_type", "pattern_hash", r("null_pct").alias("null_pct"))


@query("l2_pattern_types", f"WITH {_P} SELECT column_name, pattern_type FROM p")
def _(load):
    return profile({"messy": messy(load)}, _PARTS).select("column_name", L.pattern_type().alias("pattern_type"))


@query("l3_learned_rules", f"WITH {_RULES} SELECT rule_name, pattern_type, recommended_action, support_count, round(base_confidence, 6) AS base_confidence FROM u")
def _(load):
    found = L.learned_rules(_recorded(load)[0])
    return found.select("rule_name", "pattern_type", "recommended_action", "support_count", r("base_confidence").alias("base_confidence"))


@query("l4_pattern_similarity", f"WITH {_SIM} SELECT column_name, rule_name, round(similarity, 5) AS similarity FROM s")
def _(load):
    recorded, found = _recorded(load)
    return L.rule_similarities(found, L.learned_rules(recorded)).select("column_name", "rule_name", r("similarity", 5).alias("similarity"))


@query("l5_learned_decisions", f"""WITH {_SIM} SELECT column_name, recommended_action AS action, rule_name AS rule,
  round(least(base_confidence * (0.9 + 0.1 * (similarity - 0.85) / 0.15), 0.95), 5) AS confidence FROM s WHERE similarity >= 0.85""")
def _(load):
    recorded, found = _recorded(load)
    done = L.learned_decisions(L.similar_rules(found, L.learned_rules(recorded)))
    return done.select("column_name", "action", "rule", r("confidence", 5).alias("confidence"))


_RULED_MESSY = f"{_stats_cte(('messy',))}, {_match_cte(catalogue())}, {_BEST}, {_RULED}"
_BEST_LEARNED = f"""WITH {_SIM}, o AS (SELECT table_name, column_name, least(base_confidence * (0.9 + 0.1 * (similarity - 0.85) / 0.15), 0.95) AS confidence, recommended_action AS action, rule_name AS rule
  FROM s WHERE similarity >= 0.85) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY round(confidence, 9) DESC, action DESC, rule DESC) = 1"""


_SURER = "round(l.confidence, 9) > round(a.confidence, 9)"


@query("l5_merged_decisions", f"""SELECT a.table_name, a.column_name, CASE WHEN {_SURER} THEN l.action ELSE a.action END AS action,
  round(CASE WHEN {_SURER} THEN l.confidence ELSE a.confidence END, 5) AS confidence, CASE WHEN {_SURER} THEN l.rule ELSE a.rule END AS rule,
  CASE WHEN {_SURER} THEN 'learned' ELSE 'symbolic' END AS source FROM (WITH {_RULED_MESSY} SELECT * FROM d) a LEFT JOIN ({_BEST_LEARNED}) l USING (table_name, column_name)""")
def _(load):
    found = profile({"messy": messy(load)})
    rules = L.learned_rules(L.record_corrections(_corrections(load), found))
    merged = L.merge_candidates(rule_decisions(found), L.learned_decisions(L.similar_rules(found, rules)))
    return merged.withColumn("confidence", r("confidence", 5))


_HELD = "(correction_id % 5 = 0)"
_VALID = f"""{_R}, u AS (SELECT 'LEARNED_' || pattern_type || '_' || correct_action AS rule_name, pattern_type, correct_action AS recommended_action, count(*) AS support_count FROM r WHERE NOT {_HELD} GROUP BY pattern_type, correct_action HAVING count(*) >= 10),
w AS (SELECT rule_name, count(*) AS n, avg((correct_action = recommended_action)::INT) AS accuracy FROM (SELECT * FROM r WHERE {_HELD}) h JOIN u USING (pattern_type) GROUP BY rule_name)"""


def _heldout(load):
    """Rules from four fifths of the corrections, validated on the rest."""
    recorded, _ = _recorded(load)
    rules = L.learned_rules(recorded.where(F.col("correction_id") % 5 != 0))
    return rules, L.validate_rules(recorded.where(F.col("correction_id") % 5 == 0), rules, floor=0.3)


@query("l6_rule_validation", f"WITH {_VALID} SELECT rule_name, n, round(accuracy, 6) AS accuracy, n >= 20 AND accuracy >= 0.3 AS validated FROM w")
def _(load):
    return _heldout(load)[1].withColumn("accuracy", r("accuracy"))


_LOG = "g AS (SELECT u.rule_name, (abs(r.user_id + r.correction_id) % 10 < 8) AS correct FROM r JOIN u ON r.pattern_type = u.pattern_type AND r.correct_action = u.recommended_action)"


def _ab_log(load, rules):
    recorded, _ = _recorded(load)
    joined = recorded.join(rules.select("rule_name", F.col("pattern_type"), F.col("recommended_action").alias("correct_action")), ["pattern_type", "correct_action"])
    return joined.select("rule_name", (F.abs(F.col("user_id") + F.col("correction_id")) % 10 < 8).alias("correct"))


@query("l7_ab_outcomes", f"""WITH {_VALID}, {_LOG} SELECT rule_name, count(*) AS decisions, round(avg(correct::INT), 6) AS accuracy, CASE WHEN count(*) < 100 THEN 'continue'
  WHEN avg(correct::INT) >= 0.8 AND any_value(n >= 20 AND accuracy >= 0.3) THEN 'promote' ELSE 'reject' END AS outcome FROM g LEFT JOIN w USING (rule_name) GROUP BY rule_name""")
def _(load):
    rules, validated = _heldout(load)
    return L.ab_outcomes(_ab_log(load, rules), validated).withColumn("accuracy", r("accuracy"))


@query("l8_rule_stages", f"""WITH {_VALID}, {_LOG}, o AS (SELECT rule_name, CASE WHEN count(*) < 100 THEN 'testing' WHEN avg(correct::INT) >= 0.8 AND any_value(n >= 20 AND accuracy >= 0.3) THEN 'production' ELSE 'rejected' END AS stage
  FROM g LEFT JOIN w USING (rule_name) GROUP BY rule_name) SELECT rule_name, stage, stage <> 'rejected' AS is_active FROM o""")
def _(load):
    rules, validated = _heldout(load)
    return L.rule_status(rules, L.ab_outcomes(_ab_log(load, rules), validated)).select("rule_name", "stage", "is_active")


@query("l8_traffic_split", "SELECT event_id AS correction_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 AS in_test FROM events")
def _(load):
    return L.traffic_split(_corrections(load).select("correction_id"), "correction_id")


@query("l9_running_accuracy", f"WITH {_VALID}, {_LOG} SELECT rule_name, count(*) FILTER (correct) AS successes, count(*) FILTER (NOT correct) AS failures, round(avg(correct::INT), 6) AS accuracy FROM g GROUP BY rule_name")
def _(load):
    rules, _ = _heldout(load)
    return L.running_accuracy(_ab_log(load, rules)).withColumn("accuracy", r("accuracy"))


_RANGES = f"""{_R}, g AS (SELECT correct_action, count(*) AS support, count(*) / (SELECT count(*) FROM r) AS confidence, {", ".join(f"min({k}) AS {k}_min, max({k}) AS {k}_max" for k in L.RANGE_KEYS)},
  {", ".join(f"CASE WHEN min({k}) = max({k}) THEN min({k}) END AS {k}_is" for k in L.FLAG_KEYS)} FROM r GROUP BY correct_action)"""


@query("l10_range_patterns", f"WITH {_RANGES} SELECT correct_action, support, round(confidence, 6) AS confidence, {', '.join(f'round({k}_min, 5) AS {k}_min, round({k}_max, 5) AS {k}_max' for k in L.RANGE_KEYS)} FROM g WHERE support >= 10 AND confidence >= 0.2")
def _(load):
    found = L.range_patterns(_recorded(load)[0], min_share=0.2)
    return found.select("correct_action", "support", r("confidence").alias("confidence"), *[r(f"{k}_{e}", 5).alias(f"{k}_{e}") for k in L.RANGE_KEYS for e in ("min", "max")])


def _met_sql():
    met = [f"coalesce(p.{k} BETWEEN g.{k}_min AND g.{k}_max, FALSE)::INT" for k in L.RANGE_KEYS] + [f"coalesce(g.{k}_is = p.{k}, FALSE)::INT" for k in L.FLAG_KEYS]
    total = [f"(p.{k} IS NOT NULL AND g.{k}_min IS NOT NULL)::INT" for k in L.RANGE_KEYS] + [f"(g.{k}_is IS NOT NULL)::INT" for k in L.FLAG_KEYS]
    return f"(({' + '.join(met)}) / ({' + '.join(total)}))"


@query("l11_range_matches", f"WITH {_RANGES} SELECT p.table_name, p.column_name, g.correct_action, round({_met_sql()}, 6) AS match FROM p, g WHERE support >= 10 AND confidence >= 0.2 AND {_met_sql()} >= 0.8")
def _(load):
    recorded, found = _recorded(load)
    return L.match_ranges(found, L.range_patterns(recorded, min_share=0.2)).withColumn("match", r("match"))


@query("l12_mined_corrections", f"""WITH {_C}, t AS (SELECT * FROM c)
SELECT wrong_action, correct_action, count(*) AS n, count(*) >= 10 AS is_rule, round(least(0.95, count(*) / 20), 6) AS confidence FROM t GROUP BY ALL HAVING count(*) >= 5""")
def _(load):
    return L.mine_corrections(_corrections(load)).withColumn("confidence", r("confidence"))


@query("l13_learning_metrics", f"""WITH {_C} SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS) AS last_7_days, count(DISTINCT correct_action) AS actions,
  round(count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS) / 7, 6) AS velocity_per_day FROM c""")
def _(load):
    found = L.learning_metrics(_corrections(load), F.lit("2024-01-30").cast("timestamp"))
    return found.withColumn("velocity_per_day", r("velocity_per_day"))


@query("l13_top_rules", f"WITH {_VALID} SELECT rule_name, recommended_action, support_count, round(coalesce(accuracy, 0) * 100, 6) AS accuracy FROM u LEFT JOIN w USING (rule_name) ORDER BY support_count DESC, rule_name LIMIT 10")
def _(load):
    rules, validated = _heldout(load)
    return L.top_rules(rules, validated).withColumn("accuracy", r("accuracy"))


@query("l14_readable_rules", f"""WITH {_VALID}, {_LOG}, o AS (SELECT rule_name, CASE WHEN count(*) < 100 THEN 'testing' WHEN avg(correct::INT) >= 0.8 AND any_value(n >= 20 AND accuracy >= 0.3) THEN 'production' ELSE 'rejected' END AS stage
  FROM g LEFT JOIN w USING (rule_name) GROUP BY rule_name), m AS (SELECT pattern_type, correct_action AS recommended_action, avg(is_numeric::INT) >= 0.5 AS number, avg(null_pct) AS nulls, avg(unique_ratio) AS ratio
  FROM r WHERE NOT {_HELD} GROUP BY pattern_type, correct_action)
SELECT rule_name, 'When ' || CASE WHEN number THEN 'numeric' ELSE 'not numeric' END || ', nulls about ' || printf('%.0f', nulls * 100) || '%, unique ratio about ' || printf('%.2f', ratio) || ', apply ' || recommended_action AS description,
  support_count, coalesce(stage, 'testing') AS stage FROM u JOIN m USING (pattern_type, recommended_action) LEFT JOIN o USING (rule_name)""")
def _(load):
    rules, validated = _heldout(load)
    return L.readable_rules(L.rule_status(rules, L.ab_outcomes(_ab_log(load, rules), validated)))
