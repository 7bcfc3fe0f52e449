"""Queries for the checked transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.operators import safe, text
from colsmith.operators.temporal import PARTS


@query("f1_safe_standard_scale", """
SELECT c_custkey, round((c_acctbal - m) / s, 6) AS value FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) p""")
def _(load):
    done, _ = safe.standard_scale(load("customer"), "c_acctbal")
    return done.select("c_custkey", r("c_acctbal").alias("value"))


@query("f2_safe_log_transform", """
SELECT c_custkey, round(ln(1 + c_acctbal + CASE WHEN a < 0 THEN abs(a) + 1 ELSE 0 END), 6) AS value
FROM customer, (SELECT min(c_acctbal) AS a FROM customer) p""")
def _(load):
    done, _ = safe.log_transform(load("customer"), "c_acctbal")
    return done.select("c_custkey", r("c_acctbal").alias("value"))


@query("f3_safe_onehot", """
SELECT c_custkey, round(n / (SELECT count(*) FROM customer), 9) AS value FROM customer
JOIN (SELECT c_name AS v, count(*) AS n FROM customer GROUP BY c_name) g ON c_name = v""")
def _(load):
    done, _ = safe.one_hot(load("customer").select("c_custkey", "c_name"), "c_name")
    return done.select("c_custkey", r("c_name", 9).alias("value"))


_STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOP_WORDS)


@query("f4_safe_tfidf", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
v AS (SELECT term, count(*) AS c, count(DISTINCT doc_id) AS df FROM t WHERE term NOT IN ({_STOP}) GROUP BY term ORDER BY c DESC, term LIMIT 20),
i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v),
w AS (SELECT doc_id, t.term, count(*) * first(idf) AS raw, first(place) AS place FROM t JOIN i ON t.term = i.term GROUP BY doc_id, t.term),
z AS (SELECT doc_id, place, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT d.doc_id, {", ".join(f"round(coalesce(max(CASE WHEN place = {i} THEN weight END), 0), 6) AS text_tfidf_{i}" for i in range(20))}
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id""")
def _(load):
    done, _ = safe.tfidf(load("documents").select("doc_id", "text"), "text", 20)
    return done.select("doc_id", *[r(c).alias(c) for c in done.columns if c != "doc_id"])


@query("f5_datetime_parts", """
SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek,
  hour(ts)::INT AS ts_hour, minute(ts)::INT AS ts_minute, quarter(ts)::INT AS ts_quarter FROM events""")
def _(load):
    return safe.datetime_parts(load("events").select("event_id", "ts"), "ts", PARTS)[0].drop("ts")


@query("f6_safe_robust_scale", """
SELECT event_id, round((value - m) / w, 6) + 0.0 AS value FROM events,
 (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM events) p""")
def _(load):
    done, _ = safe.robust_scale(load("events").select("event_id", "value"), "value")
    return done.select("event_id", r("value").alias("value"))


@query("f7_safe_minmax_scale", """
SELECT event_id, round((value - a) / (b - a), 6) AS value FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) p""")
def _(load):
    done, _ = safe.minmax_scale(load("events").select("event_id", "value"), "value")
    return done.select("event_id", r("value").alias("value"))


@query("f8_safe_text_clean", "SELECT conv_id, turn, regexp_replace(trim(lower(text), ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS text FROM conversations")
def _(load):
    return safe.clean_text(load("conversations").select("conv_id", "turn", "text"), "text")[0]


@query("f_safe_outcomes", r"""
WITH f AS (SELECT count(DISTINCT k) AS constants, min(c_acctbal) AS low, count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segments, count(c_name) AS n, avg(length(c_name)) AS size,
  avg(regexp_matches(c_name, '\s')::INT) AS blanks, avg((TRY_CAST(c_name AS TIMESTAMP) IS NOT NULL)::INT) AS dates FROM (SELECT *, 5.0 AS k FROM customer) c),
o AS (SELECT unnest(['standard_scale', 'robust_scale', 'minmax_scale']) AS requested, constants > 1 AS good FROM f)
SELECT 'constant' AS column_name, requested, CASE WHEN good THEN requested ELSE 'keep_as_is' END AS actual, CASE WHEN good THEN 'success' ELSE 'skipped' END AS status FROM o
UNION ALL SELECT 'c_acctbal', 'log_transform', CASE WHEN low <= 0 THEN 'log1p_transform' ELSE 'log_transform' END, 'success' FROM f
UNION ALL SELECT 'c_name', 'onehot_encode', CASE WHEN names > 50 THEN 'frequency_encode' ELSE 'onehot_encode' END, CASE WHEN names > 50 THEN 'fallback' ELSE 'success' END FROM f
UNION ALL SELECT 'c_mktsegment', 'onehot_encode', CASE WHEN segments > 50 THEN 'frequency_encode' ELSE 'onehot_encode' END, CASE WHEN segments > 50 THEN 'fallback' ELSE 'success' END FROM f
UNION ALL SELECT 'c_name', 'text_vectorize', CASE WHEN names / n > 0.95 AND size > 10 AND blanks < 0.3 THEN 'drop_column' ELSE 'text_vectorize' END,
  CASE WHEN names / n > 0.95 AND size > 10 AND blanks < 0.3 THEN 'skipped' ELSE 'success' END FROM f
UNION ALL SELECT 'c_name', 'datetime_extract', CASE WHEN dates < 0.9 THEN 'keep_as_is' ELSE 'datetime_extract' END, CASE WHEN dates < 0.9 THEN 'skipped' ELSE 'success' END FROM f""")
def _(load):
    df = load("customer").withColumn("constant", F.lit(5.0))
    outcomes = [safe.standard_scale(df, "constant")[1], safe.log_transform(df, "c_acctbal")[1], safe.one_hot(df, "c_name")[1],
                safe.one_hot(df, "c_mktsegment")[1], safe.tfidf(df, "c_name")[1], safe.robust_scale(df, "constant")[1],
                safe.minmax_scale(df, "constant")[1], safe.datetime_parts(df, "c_name")[1]]
    return safe.outcome_table(df.sparkSession, outcomes).select(F.col("column").alias("column_name"), "requested", "actual", "status")
