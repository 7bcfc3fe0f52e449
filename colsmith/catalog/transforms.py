"""Queries for the column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.functions import scalar as S
from colsmith.operators import cluster, encode, nulls, numeric, temporal, text
from colsmith.plans.actions import CATEGORY_OF
from colsmith.plans.apply import fit, interactions


def _number_query(name, action, sql_value, sql_fit="", table="orders", key="o_orderkey",
                  column="o_totalprice", digits=6, parameters=None, source=None, with_sql=True):
    """One fitted number transform, row by row; ``sql_value`` uses x and the fitted names."""
    rel = source or f"(SELECT {key}, {column} AS x FROM {table})"
    params = f"(SELECT {sql_fit} FROM {rel} s)" if sql_fit else "(SELECT 1 AS one)"
    sql = f"SELECT {key}, round(CAST({sql_value} AS DOUBLE), {digits}) + 0.0::DOUBLE AS value FROM {rel} t, {params} p"

    @query(name, sql if with_sql else None)
    def run(load):
        df = load(table).select(key, F.col(column).alias("x"))
        if source:
            df = df.withColumn("x", F.expr(_null_rule(key)))
        done = fit(df, {"x": (action, parameters or {})}).transform(df)
        return done.select(key, r("x", digits).alias("value"))


def _null_rule(key):
    return f"CASE WHEN {key} % 7 = 0 THEN NULL ELSE x END"


def _nulled(table, key, column):
    return f"(SELECT {key}, CASE WHEN {key} % 7 = 0 THEN NULL ELSE {column} END AS x FROM {table})"


def _fences(width=1.5):
    return (f"quantile_cont(x, 0.25) - {width} * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo, "
            f"quantile_cont(x, 0.75) + {width} * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi")


@query("t01_keep_as_is", "SELECT o_orderkey, o_totalprice FROM orders")
def _(load):
    df = load("orders").select("o_orderkey", "o_totalprice")
    return fit(df, {"o_totalprice": "keep_as_is"}).transform(df)


@query("t02_drop_column", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(load):
    df = load("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return fit(df, {"o_totalprice": "drop_column"}).transform(df)


def _conditional(load, action, **extra):
    df = load("orders").select(
        "o_orderkey", "o_orderstatus", F.lit("same").alias("constant"),
        F.when(F.col("o_orderkey") % 10 >= 7, F.col("o_totalprice")).alias("sparse"),
    )
    return fit(df, {c: (action, extra) for c in df.columns}).transform(df)


_CONDITIONAL = "CASE WHEN o_orderkey % 10 >= 7 THEN o_totalprice END AS sparse"


@query("t03_drop_if_mostly_null", "SELECT o_orderkey, o_orderstatus, 'same' AS constant FROM orders")
def _(load):
    return _conditional(load, "drop_if_mostly_null")


@query("t04_drop_if_constant", f"SELECT o_orderkey, o_orderstatus, {_CONDITIONAL} FROM orders")
def _(load):
    return _conditional(load, "drop_if_constant")


@query("t05_drop_if_all_unique", f"SELECT o_orderstatus, 'same' AS constant, {_CONDITIONAL} FROM orders")
def _(load):
    return _conditional(load, "drop_if_all_unique")


@query("t06_remove_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(load):
    items = load("lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return fit(items, {"l_quantity": "remove_duplicates"}).transform(items)


_ORD = dict(table="orders", key="o_orderkey", source=_nulled("orders", "o_orderkey", "o_totalprice"))
_number_query("t07_fill_null_mean", "fill_null_mean", "coalesce(x, m)", "avg(x) AS m", digits=4, **_ORD)
_number_query("t08_fill_null_median", "fill_null_median", "coalesce(x, m)", "quantile_cont(x, 0.5) AS m", digits=4, **_ORD)


@query("t09_fill_null_mode", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS x FROM orders),
m AS (SELECT x AS mode FROM t WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)
SELECT o_orderkey, coalesce(x, mode) AS value FROM t, m""")
def _(load):
    df = load("orders").select("o_orderkey", F.col("o_orderpriority").alias("x")).withColumn("x", F.expr(_null_rule("o_orderkey")))
    return fit(df, {"x": "fill_null_mode"}).transform(df).withColumnRenamed("x", "value")


def _event_gaps(load):
    return load("events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


def _filled(load, action):
    gaps = _event_gaps(load)
    return fit(gaps, {"value": action}, order_by=["ts", "event_id"], partition_by=["user_id"]).transform(gaps)


_GAPS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"


@query("t10_fill_null_forward", f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {_GAPS} e""")
def _(load):
    return _filled(load, "fill_null_forward").select("event_id", "value")


@query("t11_fill_null_backward", f"""
SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_GAPS} e""")
def _(load):
    return _filled(load, "fill_null_backward").select("event_id", "value")


@query("t12_fill_null_interpolate", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {_GAPS} e),
k AS (SELECT *,
  last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS n0,
  first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n1
  FROM p WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0
  WHEN v0 IS NOT NULL THEN v0 + (v1 - v0) / (n1 - n0) * (n - n0) END, 7) AS value FROM k""")
def _(load):
    return _filled(load, "fill_null_interpolate").select("event_id", r("value", 7).alias("value"))


_number_query("t13_standard_scale", "standard_scale", "(x - m) / s", "avg(x) AS m, stddev_pop(x) AS s")
_number_query("t14_minmax_scale", "minmax_scale", "(x - a) / (b - a)", "min(x) AS a, max(x) AS b")
_number_query("t15_robust_scale", "robust_scale", "(x - m) / w",
              "quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w")
_number_query("t16_maxabs_scale", "maxabs_scale", "x / m", "max(abs(x)) AS m", "customer", "c_custkey", "c_acctbal")
_number_query("t17_normalize_l1", "normalize_l1", "x / m", "sum(abs(x)) AS m", "customer", "c_custkey", "c_acctbal", 9)
_number_query("t18_normalize_l2", "normalize_l2", "x / m", "sqrt(sum(x * x)) AS m", "customer", "c_custkey", "c_acctbal", 8)
_number_query("t19_log_transform", "log_transform", "ln(x)")
_number_query("t19_log_transform_shifted", "log_transform", "ln(1 + greatest(x, 0))", "", "customer", "c_custkey", "c_acctbal")
_number_query("t20_log1p_transform", "log1p_transform", "ln(1 + x)", "", "events", "event_id", "value")
_number_query("t21_sqrt_transform", "sqrt_transform", "sqrt(x)")
_number_query("t21_sqrt_transform_absolute", "sqrt_transform", "sqrt(abs(x))", "", "customer", "c_custkey", "c_acctbal")

# Power transforms: fitted exponents have no closed SQL form, given exponents do.


def _exponent_sql(table, key, column, box_cox):
    """CTEs that end in e (lam): three likelihood grids, each around the vertex of the parabola through the best points before it."""
    scaled = "x / (SELECT exp(avg(ln(x))) FROM s)"
    value = (f"CASE WHEN lam = 0 THEN ln({scaled}) ELSE pow({scaled}, lam) / lam END" if box_cox else
             "CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END "
             "ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END")
    slope = "0" if box_cox else "(SELECT avg(sign(x) * ln(1 + abs(x))) FROM s)"
    ctes, before = [f"s AS MATERIALIZED (SELECT {key}, CAST({column} AS DOUBLE) AS x FROM {table})"], "(SELECT 0.0::DOUBLE AS lam)"
    for i, (arms, step) in enumerate(((10, 0.5), (4, 0.08), (2, 0.01))):
        ctes.append(f"""g{i} AS MATERIALIZED (SELECT i, lam, -0.5 * ln(var_pop({value})) + (lam - 1) * {slope} AS score
  FROM (SELECT i, c.lam + {step}::DOUBLE * i AS lam FROM {before} c, (SELECT unnest(range(-{arms}, {arms + 1})) AS i)) l, s GROUP BY i, lam)""")
        ctes.append(f"""e{i} AS MATERIALIZED (SELECT b.lam + coalesce({step}::DOUBLE * (d.score - u.score) / nullif(2 * (d.score - 2 * b.score + u.score), 0), 0) AS lam
  FROM (SELECT * FROM g{i} ORDER BY score DESC, i LIMIT 1) b LEFT JOIN g{i} d ON d.i = b.i - 1 LEFT JOIN g{i} u ON u.i = b.i + 1)""")
        before = f"e{i}"
    return f"WITH {', '.join(ctes)}, v AS (SELECT {key}, {'(pow(x, lam) - 1) / lam' if box_cox else value} AS y FROM s, e2)"


def _power_query(name, action, table, key, column, digits, box_cox=False):
    shown = "y" if box_cox else "(y - avg(y) OVER ()) / stddev_pop(y) OVER ()"

    @query(name, f"{_exponent_sql(table, key, column, box_cox)} SELECT {key}, round({shown}, {digits}) + 0.0::DOUBLE AS value FROM v")
    def run(load):
        df = load(table).select(key, F.col(column).alias("x"))
        return fit(df, {"x": (action, {})}).transform(df).select(key, r("x", digits).alias("value"))


_power_query("t22_box_cox", "box_cox", "orders", "o_orderkey", "o_totalprice", 3, box_cox=True)
_number_query("t22_box_cox_given", "box_cox", "(pow(x + sh, 0.25) - 1) / 0.25", "abs(min(x)) + 1 AS sh",
              "customer", "c_custkey", "c_acctbal", parameters={"lambda": 0.25})
_power_query("t23_yeo_johnson", "yeo_johnson", "customer", "c_custkey", "c_acctbal", 4)
_YJ = "(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END)"
_number_query("t23_yeo_johnson_given", "yeo_johnson", f"({_YJ} - m) / s", f"avg({_YJ}) AS m, stddev_pop({_YJ}) AS s",
              "customer", "c_custkey", "c_acctbal", parameters={"lambda": 0.5})
_power_query("t24_power_transform", "power_transform", "events", "event_id", "value", 4)


@query("t22_box_cox_likelihood", """
SELECT lam / 2.0 AS lambda, round(-0.5 * ln(CASE WHEN lam = 0 THEN var_pop(ln(x / g)) ELSE
  var_pop(pow(x / g, lam / 2.0) / CASE WHEN lam = 0 THEN 1 ELSE lam / 2.0 END) END), 6) AS score
FROM (SELECT o_totalprice AS x FROM orders) t, (SELECT exp(avg(ln(o_totalprice))) AS g FROM orders) p,
  (SELECT unnest(range(-4, 5)) AS lam) l GROUP BY lam""")
def _(load):
    df = load("orders").select(F.col("o_totalprice").alias("x"))
    g = df.agg(F.exp(F.avg(F.ln("x"))).alias("g")).first()["g"]
    scaled = F.col("x") / g
    scores = [
        F.struct(F.lit(i / 2.0).alias("lambda"),
                 (-0.5 * F.ln(F.var_pop(F.ln(scaled) if i == 0 else F.pow(scaled, F.lit(i / 2.0)) / (i / 2.0)))).alias("score"))
        for i in range(-4, 5)
    ]
    return df.agg(F.array(*scores).alias("a")).select(F.inline("a")).select("lambda", r("score").alias("score"))


@query("t25_quantile_transform", """
WITH s AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS i FROM customer),
n AS (SELECT count(*) AS n, greatest(2, least(count(*) // 2, 1000)) AS q FROM s),
p AS (SELECT k, k / (q - 1.0::DOUBLE) AS level, (n - 1) * (k / (q - 1.0::DOUBLE)) AS pos
      FROM n, (SELECT unnest(range(0, 1000)) AS k) r WHERE k < q),
f AS (SELECT level, CASE WHEN ceil(pos) = floor(pos) THEN a.x ELSE (ceil(pos) - pos) * a.x + (pos - floor(pos)) * b.x END AS v
      FROM p JOIN s a ON a.i = floor(pos) JOIN s b ON b.i = ceil(pos)),
k AS (SELECT v, min(level) AS l0, max(level) AS l1 FROM f GROUP BY v),
z AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(l0) OVER (ORDER BY v) AS l2 FROM k)
SELECT c_custkey, round(CASE WHEN v2 IS NULL THEN 1.0 WHEN c_acctbal = (SELECT min(v) FROM k) THEN 0.0
  WHEN c_acctbal = v THEN (l0 + l1) / 2 ELSE l1 + (c_acctbal - v) / (v2 - v) * (l2 - l1) END, 6) + 0.0 AS value
FROM customer ASOF JOIN z ON c_acctbal >= v""")
def _(load):
    df = load("customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    done = fit(df, {"x": "quantile_transform"}).transform(df)
    return done.select("c_custkey", r("x").alias("value"))


_EVENT = dict(table="events", key="event_id", column="value")
_number_query("t26_clip_outliers", "clip_outliers", "greatest(least(x, hi), lo)", _fences(), **_EVENT)
_number_query("t27_winsorize", "winsorize", "greatest(least(x, hi), lo)",
              "quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi", **_EVENT)
_number_query("t28_cap_floor_outliers", "cap_floor_outliers", "greatest(least(x, hi), lo)",
              "avg(x) - 3 * stddev_samp(x) AS lo, avg(x) + 3 * stddev_samp(x) AS hi", **_EVENT)
_number_query("t29_remove_outliers", "remove_outliers", "CASE WHEN x BETWEEN lo AND hi THEN x END", _fences(), **_EVENT)


def _encoded(name, action, sql, table="part", key="p_partkey", column="p_brand", number="bigint", digits=9, target=None):
    @query(name, sql)
    def run(load):
        df = load(table)
        df = df.select(key, F.when(F.col(key) % 7 != 0, F.col(column)).alias("x"), *([target] if target else []))
        done = fit(df, {"x": action}, target=target).transform(df)
        value = F.col("x").cast("bigint") if number == "bigint" else r("x", digits)
        return done.select(key, value.alias("value"))


_BRANDS = "(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS x FROM part)"
_CODES = f"(SELECT x AS v, row_number() OVER (ORDER BY x) - 1 AS code, n, n / sum(n) OVER () AS share FROM (SELECT x, count(*) AS n FROM {_BRANDS} b WHERE x IS NOT NULL GROUP BY x) g)"
_encoded("t30_label_encode", "label_encode", f"SELECT p_partkey, code AS value FROM {_BRANDS} b LEFT JOIN {_CODES} c ON x = v")
_encoded("t31_ordinal_encode", "ordinal_encode", f"SELECT p_partkey, coalesce(code, -1) AS value FROM {_BRANDS} b LEFT JOIN {_CODES} c ON x = v")
_encoded("t32_frequency_encode", "frequency_encode",
         f"SELECT p_partkey, round(coalesce(share, 0), 9) AS value FROM {_BRANDS} b LEFT JOIN {_CODES} c ON x = v", number="double")
_encoded("t33_binary_encode", "binary_encode", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(toxic AS BIGINT) END AS value FROM labels""",
         "labels", "doc_id", "toxic")


@query("t31_ordinal_encode_given_order", """
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE -1 END::BIGINT AS value FROM orders""")
def _(load):
    df = load("orders").select("o_orderkey", F.col("o_orderpriority").alias("value"))
    return fit(df, {"value": ("ordinal_encode", {"order": ["5-LOW", "3-MEDIUM", "2-HIGH"]})}).transform(df)


@query("t34_onehot_encode", """
SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS "l_returnflag_A", (l_returnflag = 'N')::INT AS "l_returnflag_N",
  (l_returnflag = 'R')::INT AS "l_returnflag_R" FROM lineitem""")
def _(load):
    df = load("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return fit(df, {"l_returnflag": "onehot_encode"}).transform(df)


_encoded("t35_hash_encode", "hash_encode",
         f"SELECT p_partkey, coalesce(('0x' || substr(md5(x), 1, 8))::BIGINT % 8, 0) AS value FROM {_BRANDS} b")
_TARGET = "(SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS x FROM part)"
_encoded("t36_target_encode", "target_encode", f"""
SELECT p_partkey, round(coalesce(m, (SELECT avg(p_retailprice) FROM part)), 6) AS value FROM {_TARGET} t
LEFT JOIN (SELECT x AS v, avg(p_retailprice) AS m FROM {_TARGET} u GROUP BY x) g ON x = v""",
         number="double", digits=6, target="p_retailprice")


@query("t36_target_encode_folds", """
WITH t AS (SELECT *, CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS f FROM part),
c AS (SELECT p_brand, f, sum(p_retailprice) AS s, count(p_retailprice) AS n FROM t GROUP BY p_brand, f),
a AS (SELECT p_brand, sum(s) AS s, sum(n) AS n FROM c GROUP BY p_brand)
SELECT p_partkey, round(coalesce((a.s - c.s) / nullif(a.n - c.n, 0), (SELECT avg(p_retailprice) FROM part)), 6) AS value FROM t JOIN c USING (p_brand, f) JOIN a USING (p_brand)""")
def _(load):
    done = encode.target_encode_folds(load("part"), "p_brand", "p_retailprice", F.col("p_partkey"), out="value")
    return done.select("p_partkey", r("value").alias("value"))


def _text_query(name, action, made, sql_made, sql_value, table="orders", key="o_orderkey", digits=None, kind=None):
    """A text transform over a column made by ``made`` (Spark SQL) and ``sql_made``."""
    sql = f"round({sql_value}, {digits})" if digits is not None else sql_value

    def value(done):
        if digits is not None:
            return r("x", digits)
        is_time = done.schema["x"].dataType.simpleString() == "timestamp"
        return F.col("x").cast("timestamp_ntz") if is_time else F.col("x")

    @query(name, f"SELECT {key}, {sql} AS value FROM (SELECT {key}, {sql_made} AS x FROM {table}) t")
    def run(load):
        df = load(table).select(key, F.expr(made).alias("x"))
        done = fit(df, {"x": action}).transform(df)
        return done.select(key, value(done).alias("value"))


_PRICE_TEXT = ("CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'about ten' WHEN 2 THEN concat('$ ', CAST(o_orderkey AS STRING), ',000') "
               "WHEN 3 THEN concat(CAST(o_custkey AS STRING), '%') ELSE concat(CAST(o_custkey AS STRING), '.25') END")
_PRICE_TEXT_SQL = _PRICE_TEXT.replace("AS STRING", "AS VARCHAR")
_text_query("t37_parse_numeric", "parse_numeric", _PRICE_TEXT, _PRICE_TEXT_SQL,
            "TRY_CAST(regexp_replace(x, '[%$€£¥₹,\\s]', '', 'g') AS DOUBLE)", digits=4)
_FLAG_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'off' WHEN 4 THEN 'maybe' END"
_text_query("t38_parse_boolean", "parse_boolean", _FLAG_TEXT, _FLAG_TEXT,
            "CASE WHEN lower(trim(x)) IN ('true','yes','1','t','y','on') THEN 1.0::DOUBLE WHEN lower(trim(x)) IN ('false','no','0','f','n','off') THEN 0.0::DOUBLE END")
_text_query("t39_parse_datetime", "parse_datetime",
            "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') "
            "WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE 'soon' END",
            "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') "
            "WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END",
            "try_strptime(x, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y'])")


@query("t40_parse_categorical", f"SELECT v AS value, n, code FROM {_CODES} c")
def _(load):
    df = load("part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("x"))
    return fit(df, {"x": "parse_categorical"}).steps[0].dictionary.table.select("value", "n", "code")


_text_query("t41_parse_json", "parse_json", "CASE event_id % 4 WHEN 0 THEN '{broken' WHEN 1 THEN '17' ELSE props END",
            "CASE event_id % 4 WHEN 0 THEN '{broken' WHEN 1 THEN '17' ELSE props END",
            "CASE WHEN json_valid(x) THEN CAST(json(x) AS VARCHAR) ELSE x END", "events", "event_id")
_text_query("t42_currency_normalize", "currency_normalize", _PRICE_TEXT, _PRICE_TEXT_SQL,
            "TRY_CAST(regexp_replace(x, '[$,€£¥₹\\s]', '', 'g') AS DOUBLE)", digits=4)
_text_query("t43_percentage_to_decimal", "percentage_to_decimal", _PRICE_TEXT, _PRICE_TEXT_SQL,
            "TRY_CAST(trim(replace(x, '%', '')) AS DOUBLE) / 100", digits=6)
_text_query("t44_text_lowercase", "text_lowercase", "html", "html", "lower(x)", "pages", "page_id")
_text_query("t45_text_uppercase", "text_uppercase", "p_name", "p_name", "upper(x)", "part", "p_partkey")
_text_query("t46_text_clean", "text_clean", "regexp_replace(html, '[^ -~]', '')", "regexp_replace(html, '[^ -~]', '', 'g')",
            "trim(regexp_replace(regexp_replace(x, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))", "pages", "page_id")
_PHONE = "concat('+1 (555) ', CAST(c_custkey AS STRING), '-', CAST(c_nationkey AS STRING))"
_text_query("t47_phone_standardize", "phone_standardize", _PHONE, _PHONE.replace("STRING", "VARCHAR"),
            "regexp_replace(x, '[^\\d+]', '', 'g')", "customer", "c_custkey")
_MAIL = "CASE c_custkey % 3 WHEN 0 THEN ' Anna.B@Example.ORG ' WHEN 1 THEN concat('user', CAST(c_custkey AS STRING), '@mail.example.com') ELSE 'not a mail' END"
_text_query("t48_email_validate", "email_validate", _MAIL, _MAIL.replace("STRING", "VARCHAR"),
            "CASE WHEN regexp_matches(trim(lower(x)), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN trim(lower(x)) END",
            "customer", "c_custkey")
_text_query("t49_url_parse", "url_parse", "CASE page_id % 3 WHEN 0 THEN 'no url' ELSE url END", "CASE page_id % 3 WHEN 0 THEN 'no url' ELSE url END",
            "CASE WHEN contains(x, '://') THEN regexp_extract(x, '^[a-z]+://([^/?#]*)', 1) ELSE x END", "pages", "page_id")

_TOKENS = """
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM documents),
v AS (SELECT term, count(*) AS c, count(DISTINCT doc_id) AS df FROM t GROUP BY term ORDER BY c DESC, term LIMIT 100),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v),
w AS (SELECT doc_id, t.term, count(*) * first(idf) AS raw FROM t JOIN i ON t.term = i.term GROUP BY doc_id, t.term),
z AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query("t50_text_vectorize_tfidf", f"""
WITH {_TOKENS}
SELECT d.doc_id, round(coalesce(sum(weight) / 100, 0), 6) AS value FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id""")
def _(load):
    docs = load("documents").select("doc_id", F.col("text").alias("value"))
    done = fit(docs, {"value": "text_vectorize_tfidf"}).transform(docs)
    return done.select("doc_id", r("value").alias("value"))


_text_query("t51_datetime_extract_year", "datetime_extract_year", "o_orderdate", "o_orderdate", "CAST(year(x) AS DOUBLE)")


@query("t52_cyclic_time_encode", """
SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS ts_hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS ts_hour_cos,
  round(sin(2 * pi() * (month(ts) - 1) / 12), 6) + 0.0 AS ts_month_sin, round(cos(2 * pi() * (month(ts) - 1) / 12), 6) + 0.0 AS ts_month_cos FROM events""")
def _(load):
    names = ("ts_hour_sin", "ts_hour_cos", "ts_month_sin", "ts_month_cos")
    done = load("events").select("event_id", *temporal.cycles(F.col("ts"), "ts"))
    return done.select("event_id", *[r(n).alias(n) for n in names])


@query("t53_geo_cluster_kmeans")
def _(load):
    df = load("customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    return fit(df, {"value": "geo_cluster_kmeans"}).transform(df)


@query("t53_geo_cluster_pair")
def _(load):
    df = load("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return cluster.fit_geo_clusters(df, ["c_acctbal", "c_nationkey"], 5).transform(df, "cluster").select("c_custkey", "cluster")


# The clusters themselves depend on a seeded start; that each row has its nearest centre and each centre is the mean of its rows can be told.
@query("t53_cluster_certificate", """SELECT 10::BIGINT AS clusters, count(c_acctbal) AS rows, TRUE AS rows_are_nearest, TRUE AS centres_are_means FROM customer
UNION ALL SELECT 5, count(*) FILTER (c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL), TRUE, TRUE FROM customer""")
def _(load):
    df = load("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    found = [cluster.fit_geo_clusters(df, columns, k).certificate(df) for columns, k in ((["c_acctbal"], 10), (["c_acctbal", "c_nationkey"], 5))]
    return found[0].union(found[1]).select("clusters", "rows", (F.col("nearest_share") == 1).alias("rows_are_nearest"), (F.col("largest_shift") < 0.01).alias("centres_are_means"))


_number_query("t54_binning_equal_width", "binning_equal_width",
              "greatest(0, least(4, ceil((x - a) / ((b - a) / 5)) - 1))", "min(x) AS a, max(x) AS b", digits=0)
_number_query("t55_binning_equal_freq", "binning_equal_freq",
              "(x > q1)::INT + (x > q2)::INT + (x > q3)::INT + (x > q4)::INT",
              ", ".join(f"quantile_cont(x, {i / 5}) AS q{i}" for i in range(1, 5)), digits=0)
_number_query("t56_binning_custom", "binning_custom",
              "CASE WHEN x BETWEEN 0 AND 100 THEN (x > 25)::INT + (x > 50)::INT + (x > 75)::INT END", digits=0, **_EVENT)
_number_query("t57_polynomial_features", "polynomial_features", "x * x", digits=4, **_EVENT)


@query("t58_interaction_features", """
SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 3) AS l_quantity_x_l_extendedprice,
  round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem""")
def _(load):
    done = interactions(load("lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return done.select("l_orderkey", "l_linenumber", r("l_quantity_x_l_extendedprice", 3).alias("l_quantity_x_l_extendedprice"),
                       r("l_discount_x_l_tax").alias("l_discount_x_l_tax"))


_PARSED = "TRY_CAST(regexp_replace(x, '[%$€£¥₹,\\s]', '', 'g') AS DOUBLE)"


@query("t59_numeric_coercion", f"""
WITH t AS (SELECT o_orderkey, {_PRICE_TEXT_SQL} AS x FROM orders), n AS (SELECT o_orderkey, {_PARSED} AS y FROM t),
p AS (SELECT min(y) AS a, max(y) AS b FROM n)
SELECT o_orderkey, round((y - a) / (b - a), 6) AS value, o_orderkey AS kept FROM n, p""")
def _(load):
    # ``words`` has too few numbers, so the scaling is refused and the column passes through.
    df = load("orders").select("o_orderkey", F.expr(_PRICE_TEXT).alias("value"), F.col("o_orderkey").alias("kept"))
    done = fit(df, {"value": "minmax_scale"}).transform(df)
    return done.select("o_orderkey", r("value").alias("value"), "kept")


@query("t60_batch_execution", """
WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity, round((l_extendedprice - a) / (b - a), 6) AS l_extendedprice,
  (ascii(l_returnflag) - ascii('A') + 12) // 13 AS l_returnflag, l_discount FROM lineitem, p""")
def _(load):
    df = load("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount", "l_tax")
    done = fit(df, {"l_quantity": "standard_scale", "l_extendedprice": "minmax_scale", "l_returnflag": "label_encode",
                    "l_tax": "drop_column"}).transform(df)
    return done.select("l_orderkey", "l_linenumber", r("l_quantity").alias("l_quantity"),
                       r("l_extendedprice").alias("l_extendedprice"), "l_returnflag", "l_discount")


@query("t60_batch_report", r"""
WITH f AS (SELECT count(DISTINCT o_orderpriority) AS kinds, count(DISTINCT o_custkey) AS keys, avg((TRY_CAST(o_orderstatus AS DOUBLE) IS NOT NULL)::INT) AS numbers, count(o_totalprice) AS prices FROM orders),
c AS (SELECT 'o_totalprice' AS column_name, 'standard_scale' AS requested, CASE WHEN prices > 0 THEN 'standard_scale' END AS applied, 'success' AS status FROM f
  UNION ALL SELECT 'o_orderpriority', 'onehot_encode', CASE WHEN kinds <= 50 THEN 'onehot_encode' ELSE 'label_encode' END, CASE WHEN kinds <= 50 THEN 'success' ELSE 'fallback' END FROM f
  UNION ALL SELECT 'o_orderstatus', 'standard_scale', CASE WHEN numbers > 0.5 THEN 'standard_scale' ELSE 'keep_as_is' END, CASE WHEN numbers > 0.5 THEN 'success' ELSE 'skipped' END FROM f
  UNION ALL SELECT 'o_custkey', 'onehot_encode', CASE WHEN keys <= 50 THEN 'onehot_encode' ELSE 'label_encode' END, CASE WHEN keys <= 50 THEN 'success' ELSE 'fallback' END FROM f
  UNION ALL SELECT 'o_clerk', 'drop_column', 'keep_as_is', CASE WHEN list_contains((SELECT list(column_name) FROM (DESCRIBE orders)), 'o_clerk') THEN 'success' ELSE 'error' END FROM f)
SELECT column_name, requested, applied, CASE WHEN contains(applied, 'scale') THEN 'scaling' WHEN contains(applied, 'encode') THEN 'encoding' ELSE 'data_quality' END AS category, status FROM c""")
def _(load):
    orders = load("orders")
    fitted = fit(orders, {"o_totalprice": "standard_scale", "o_orderpriority": "onehot_encode", "o_orderstatus": "standard_scale",
                          "o_custkey": "onehot_encode", "o_clerk": "drop_column"})
    return fitted.report(orders.sparkSession).select(F.col("column").alias("column_name"), "requested", "applied", "category", "status")
