"""Queries for relations between columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import STAR, frames, profile_sql
from colsmith.operators import cross
from colsmith.operators.profile import profile
from colsmith.plans.apply import fit

_ALL = ("customer", "supplier", "part", "orders", "lineitem", "events", "messy")


@query("x1_primary_keys", f"SELECT table_name, column_name, round(unique_ratio, 6) AS unique_ratio FROM {profile_sql(*_ALL, text=False)} p WHERE null_count = 0 AND unique_ratio >= 0.995")
def _(load):
    return cross.primary_keys(profile(frames(load, *_ALL), {"values"})).withColumn("unique_ratio", r("unique_ratio"))


def _composite_sql():
    columns = STAR["lineitem"]
    single = {c: f"(SELECT count(DISTINCT {c}) FROM lineitem)" for c in columns}
    parts = []
    for a, b in combinations(columns, 2):
        parts.append(f"SELECT '{a},{b}' AS columns, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM lineitem)) / (SELECT count(*) FROM lineitem) AS u")
    keyed = " AND ".join(f"({single[c]} / (SELECT count(*) FROM lineitem) < 0.995 OR NOT contains(columns, '{c}'))" for c in columns)
    return f"SELECT columns, round(u, 6) AS unique_ratio FROM ({' UNION ALL '.join(parts)}) x WHERE u >= 0.995 AND {keyed}"


@query("x2_composite_keys", _composite_sql())
def _(load):
    found = cross.composite_keys(load("lineitem"), "lineitem", max_size=2)
    return found.select(F.array_join("columns", ",").alias("columns"), r("unique_ratio").alias("unique_ratio"))


def _composite_three_sql():
    """Pairs and triples of columns; a triple counts unless one of its columns or pairs is a key already."""
    columns = STAR["lineitem"]
    rows = "(SELECT count(*) FROM lineitem)"
    parts = [f"SELECT {list(names)} AS names, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(names)} FROM lineitem)) / {rows} AS u"
             for size in (1, 2, 3) for names in combinations(columns, size)]
    return f"""WITH k AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}) x WHERE u >= 0.995)
SELECT array_to_string(names, ',') AS columns, round(u, 6) AS unique_ratio FROM k WHERE len(names) > 1
  AND NOT EXISTS (SELECT 1 FROM k o WHERE len(o.names) < len(k.names) AND list_has_all(k.names, o.names))"""


@query("x2_composite_keys_of_three", _composite_three_sql())
def _(load):
    found = cross.composite_keys(load("lineitem"), "lineitem", max_size=3)
    return found.select(F.array_join("columns", ",").alias("columns"), r("unique_ratio").alias("unique_ratio"))


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("x3_correlations", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_name, '{b}' AS other, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in _NUMBERS for b in _NUMBERS if a != b)
    + ") x WHERE abs(correlation) >= 0.01")
def _(load):
    return cross.correlations(load("lineitem"), "lineitem", 0.01).select("column_name", "other", r("correlation").alias("correlation"))


def _cramer_sql(table, a, b):
    return f"""SELECT '{a}' AS column_name, '{b}' AS other, round(sqrt(sum(CASE WHEN rs = 2 AND cs = 2 THEN pow(greatest(abs(coalesce(o, 0) - e) - 0.5, 0), 2) / e
   ELSE pow(coalesce(o, 0) - e, 2) / e END) / (any_value(n) * (least(any_value(rs), any_value(cs)) - 1))), 6) AS cramers_v FROM (
   SELECT x.v AS xv, y.v AS yv, d.n, rs, cs, x.n * y.n / d.n AS e FROM (SELECT {a} AS v, count(*) AS n FROM {table} GROUP BY v) x,
   (SELECT {b} AS v, count(*) AS n FROM {table} GROUP BY v) y, (SELECT count(*) AS n, count(DISTINCT {a}) AS rs, count(DISTINCT {b}) AS cs FROM {table}) d) g
   LEFT JOIN (SELECT {a} AS av, {b} AS bv, count(*) AS o FROM {table} GROUP BY av, bv) c ON av = xv AND bv = yv"""


@query("x4_cramers_v", " UNION ALL ".join([
    _cramer_sql("lineitem", "l_returnflag", "l_linestatus"), _cramer_sql("part", "p_type", "p_brand"),
    _cramer_sql("labels", "quality", "toxic")]))
def _(load):
    found = cross.cramers_v(load("lineitem"), [("l_returnflag", "l_linestatus")])
    found = found.union(cross.cramers_v(load("part"), [("p_type", "p_brand")])).union(cross.cramers_v(load("labels"), [("quality", "toxic")]))
    return found.select("column_name", "other", r("cramers_v").alias("cramers_v"))


@query("x4_associations", _cramer_sql("orders", "o_orderstatus", "o_orderpriority"))
def _(load):
    return cross.associations(load("orders"), "orders", 0.0).withColumn("cramers_v", r("cramers_v"))


@query("x5_schema_types", f"""
WITH f AS (SELECT table_name, count(*) FILTER (is_temporal OR coalesce(matches_iso_datetime, 0) >= 1) AS temporal_columns,
  count(*) FILTER ((contains(lower(column_name), 'id') OR contains(lower(column_name), 'key') OR contains(lower(column_name), 'uuid')) AND unique_ratio > 0.9) AS id_columns,
  avg(is_numeric::INT) AS numeric_ratio, count(*) FILTER (is_string AND unique_count > 20) AS many, count(*) AS total FROM {profile_sql(*_ALL)} p GROUP BY table_name)
SELECT table_name, temporal_columns, id_columns, round(numeric_ratio, 6) AS numeric_ratio, CASE WHEN temporal_columns > 0 AND numeric_ratio > 0.5 THEN 'time_series'
  WHEN id_columns > 0 AND many > 0 THEN 'transactional' WHEN id_columns > 0 AND numeric_ratio < 0.4 THEN 'hierarchical' WHEN numeric_ratio > 0.7 AND total > 20 THEN 'feature_rich' ELSE 'unknown' END AS schema_type FROM f""")
def _(load):
    found = cross.schema_types(profile(frames(load, *_ALL), {"values", "text"}))
    return found.select("table_name", "temporal_columns", "id_columns", r("numeric_ratio").alias("numeric_ratio"), "schema_type")


@query("x6_foreign_keys", """
SELECT 'orders' AS table_name, 'o_custkey' AS column_name, 'customer' AS other_table, 'c_custkey' AS other,
  round((SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) / (SELECT count(DISTINCT o_custkey) FROM orders), 6) AS overlap
UNION ALL SELECT 'customer', 'c_nationkey', 'nation', 'n_nationkey',
  round((SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) / (SELECT count(DISTINCT c_nationkey) FROM customer), 6)""")
def _(load):
    found = cross.foreign_keys({t: load(t) for t in ("orders", "customer", "nation")})
    return found.withColumn("overlap", r("overlap"))


@query("x7_correlation_change", """
WITH p AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem),
t AS (SELECT *, greatest(least(l_extendedprice, hi), lo) AS x FROM lineitem, p),
c AS (SELECT [abs(corr(x, l_quantity) - corr(l_extendedprice, l_quantity)), abs(corr(x, l_discount) - corr(l_extendedprice, l_discount)), abs(corr(x, l_tax) - corr(l_extendedprice, l_tax))] AS d FROM t)
SELECT 'changed' AS column_name, round(list_avg(d), 6) AS mean_change, round(list_max(d), 6) AS max_change, list_avg(d) <= 0.15 AS passed FROM c""")
def _(load):
    df = load("lineitem").withColumn("changed", F.col("l_extendedprice"))
    done = fit(df, {"changed": "winsorize"}).transform(df)
    found = cross.correlation_change(done, "l_extendedprice", "changed", ["l_quantity", "l_discount", "l_tax"])
    return found.select("column_name", r("mean_change").alias("mean_change"), r("max_change").alias("max_change"), "passed")
