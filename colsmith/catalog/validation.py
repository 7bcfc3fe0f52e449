"""Queries for the checks of a transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import profile_sql
from colsmith.operators import cross
from colsmith.operators import validate as V
from colsmith.operators.profile import profile
from colsmith.plans.apply import fit


def _clipped(load):
    """Event values before and after clipping and a log, and a text column that stays."""
    before = load("events").select(F.col("value").alias("clipped"), F.col("value").alias("logged"), "event_type")
    fitted = fit(before, {"clipped": "clip_outliers", "logged": "log1p_transform", "event_type": "keep_as_is"})
    return before, fitted.transform(before), fitted


_LIMITS = "(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"
_VALUES = f"v AS (SELECT value AS b, greatest(least(value, hi), lo) AS clipped, ln(1 + value) AS logged, event_type FROM events, {_LIMITS} l)"


def _stat(x):
    q1, q3 = f"(SELECT quantile_cont({x}, 0.25) FROM v)", f"(SELECT quantile_cont({x}, 0.75) FROM v)"
    return (f"(SELECT abs(stddev_samp({x}) / avg({x})) FROM v)",
            f"(SELECT count(*) FILTER ({x} < {q1} - 1.5 * ({q3} - {q1}) OR {x} > {q3} + 1.5 * ({q3} - {q1})) / count(*) FROM v)",
            f"(SELECT -sum(n / (SELECT count(*) FROM v) * log2(n / (SELECT count(*) FROM v))) FROM (SELECT count(*) AS n FROM v GROUP BY {x}) g)")


def _metric_sql():
    parts = []
    for c in ("clipped", "logged"):
        (cb, ob, eb), (ca, oa, ea) = _stat("b"), _stat(c)
        parts += [f"SELECT '{c}' AS column_name, 'variance_stabilization' AS metric, {cb} AS before, {ca} AS after, {cb} - {ca} AS improvement, {cb} - {ca} >= 0.1 AS passed",
                  f"SELECT '{c}', 'outlier_reduction', {ob}, {oa}, {ob} - {oa}, {ob} - {oa} >= 0.05",
                  f"SELECT '{c}', 'information_preservation', {eb}, {ea}, {ea} / {eb} - 1, {ea} / {eb} >= 0.8"]
    t = _stat("event_type")[2]
    parts.append(f"SELECT 'event_type', 'information_preservation', {t}, {t}, 0.0, TRUE")
    return f"WITH {_VALUES}, m AS ({' UNION ALL '.join(parts)}) "


def _log_tail(z):
    """Log of the normal distribution function at z in SQL: a power series near zero, a continued fraction far out."""
    square, terms = f"({z} * {z})", 60
    series = "1.0"
    for k in range(terms, 0, -1):
        series = f"(1 + {square} / {2 * k + 1} * {series})"
    density = f"exp(-{square} / 2) / sqrt(2 * pi())"
    fraction = f"abs({z})"
    for k in range(60, 0, -1):
        fraction = f"(abs({z}) + {k}.0 / {fraction})"
    tail = f"(-{square} / 2 - ln(sqrt(2 * pi())) - ln({fraction}))"
    return f"CASE WHEN {z} < -4 THEN {tail} WHEN {z} > 4 THEN ln(1 - exp({tail})) ELSE ln(0.5 + {z} * {density} * {series}) END"


def _darling_sql(c):
    return f"""(SELECT -count(*) - sum((2 * i - 1) * ({_log_tail("z")}) + (2 * (n - i) + 1) * ({_log_tail("(-z)")})) / count(*) FROM (
      SELECT row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z FROM v WHERE {c} IS NOT NULL) s)"""


_NORMAL = f"WITH {_VALUES}, d AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_darling_sql('b')} AS before, {_darling_sql(c)} AS after" for c in ("clipped", "logged")) + ")"


@query("v1_normality", f"{_NORMAL} SELECT column_name, round(before, 4) AS before, round(after, 4) AS after, round(before - after, 4) + 0.0::DOUBLE AS improvement, after < before AS passed FROM d")
def _(load):
    before, after, _ = _clipped(load)
    found = V.statistical_metrics(before, after, ["clipped", "logged"]).where(F.col("metric") == "normality")
    return found.select("column_name", *[r(c, 4).alias(c) for c in ("before", "after", "improvement")], "passed")


def _metric_query(name, metric):
    @query(name, _metric_sql() + f"SELECT column_name, round(before, 6) AS before, round(after, 6) AS after, round(improvement, 6) + 0.0::DOUBLE AS improvement, passed FROM m WHERE metric = '{metric}'")
    def run(load):
        before, after, _ = _clipped(load)
        found = V.statistical_metrics(before, after, ["clipped", "logged", "event_type"], normality=False).where(F.col("metric") == metric)
        return found.select("column_name", r("before").alias("before"), r("after").alias("after"), r("improvement").alias("improvement"), "passed")


_metric_query("v2_variance", "variance_stabilization")
_metric_query("v3_outliers", "outlier_reduction")
_metric_query("v4_information", "information_preservation")


@query("v5_score", _metric_sql() + "SELECT column_name, round(avg(passed::INT), 6) AS score, avg(passed::INT) >= 0.6 AS passed FROM m GROUP BY column_name")
def _(load):
    before, after, _ = _clipped(load)
    found = V.statistical_verdict(V.statistical_metrics(before, after, ["clipped", "logged", "event_type"], normality=False))
    return found.select("column_name", r("score").alias("score"), "passed")


@query("v6_range", f"""WITH {_VALUES} SELECT column_name, round(b, 6) AS before, round(a, 6) AS after, a / b <= 1.2 AS passed FROM (
  SELECT 'clipped' AS column_name, max(b) - min(b) AS b, max(clipped) - min(clipped) AS a FROM v UNION ALL SELECT 'logged', max(b) - min(b), max(logged) - min(logged) FROM v) x""")
def _(load):
    before, after, _ = _clipped(load)
    found = V.range_check(before, after, ["clipped", "logged"])
    return found.select("column_name", r("before").alias("before"), r("after").alias("after"), "passed")


_ACTIONS = ("onehot_encode", "log_transform", "standard_scale", "drop_column")


@query("v7_semantic_validity", f"""SELECT table_name, column_name, action, NOT ((action = 'onehot_encode' AND unique_count > 50) OR (action = 'log_transform' AND is_numeric AND min_value <= 0)
  OR (action = 'standard_scale' AND is_numeric AND abs(mean) < 0.1 AND abs(std - 1) < 0.2)
  OR (action = 'drop_column' AND (contains(column_name, 'id') OR contains(column_name, 'key') OR contains(column_name, 'label') OR contains(column_name, 'class')))) AS passed
  FROM {profile_sql("customer", "orders", text=False)} p, (SELECT unnest([{", ".join(f"'{a}'" for a in _ACTIONS)}]) AS action) a""")
def _(load):
    found = profile({t: load(t) for t in ("customer", "orders")}, {"numbers", "values"})
    proposed = found.select("table_name", "column_name", F.explode(F.array(*[F.lit(a) for a in _ACTIONS])).alias("action"))
    return V.semantic_issues(proposed, found).drop("issues")


@query("v8_consistency", f"""WITH {_LIMITS[1:-1].join(['l AS (', ')'])}, w AS (SELECT value AS b, user_id AS u, greatest(least(value, hi), lo) AS clipped, ln(1 + value) AS logged FROM events, l),
f AS (SELECT 'clipped' AS column_name, (max(clipped) - min(clipped)) / (max(b) - min(b)) <= 1.2 AS in_range, TRUE AS sensible, abs(corr(clipped, u) - corr(b, u)) <= 0.15 AS related FROM w
  UNION ALL SELECT 'logged', (max(logged) - min(logged)) / (max(b) - min(b)) <= 1.2, NOT min(b) <= 0, abs(corr(logged, u) - corr(b, u)) <= 0.15 FROM w)
SELECT column_name, in_range AND sensible AND related AS consistent FROM f""")
def _(load):
    before, after, fitted = _clipped(load)
    events = load("events").withColumns({"clipped": F.col("value"), "logged": F.col("value")})
    moved = fitted.transform(events)
    kept = [cross.correlation_change(moved, "value", c, ["user_id"]) for c in ("clipped", "logged")]
    found = profile({"events": before.select("clipped", "logged")}, {"numbers", "values"})
    chosen = fitted.report(before.sparkSession).select(F.lit("events").alias("table_name"), F.col("column").alias("column_name"), F.col("applied").alias("action"))
    issues = V.semantic_issues(chosen.where(F.col("column_name") != "event_type"), found)
    return V.consistency_verdict(V.range_check(before, after, ["clipped", "logged"]), issues, *kept)


@query("v9_report", _metric_sql() + "SELECT count(*) AS total, count(*) AS processed, count(s) AS validated, count(*) FILTER (s >= 0.6) AS passed FROM (SELECT avg(passed::INT) AS s FROM m GROUP BY column_name) x")
def _(load):
    before, after, fitted = _clipped(load)
    verdicts = V.statistical_verdict(V.statistical_metrics(before, after, ["clipped", "logged", "event_type"], normality=False))
    return V.transform_report(fitted.report(before.sparkSession), verdicts)
