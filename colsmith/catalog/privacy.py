"""Queries for private aggregates and anonymised columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import profile_sql
from colsmith.operators.profile import profile
from colsmith.plans import privacy as K


def _uniform_sql(*keys: str) -> str:
    parts = "".join(f" || '|' || coalesce('=' || {k}, 'null')" for k in keys)
    return f"((CAST('0x' || substr(sha256('7'{parts}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {1 << 52}::DOUBLE)"


def _laplace_sql(scale: float, *keys: str) -> str:
    u = f"({_uniform_sql(*keys)} - 0.5)"
    return f"(-{scale}::DOUBLE * sign({u}) * ln(1 - 2 * abs({u})))"


@query("k1_laplace_noise", f"SELECT o_orderstatus, round(count(*) + {_laplace_sql(1, 'o_orderstatus')}, 6) AS noisy FROM orders GROUP BY o_orderstatus")
def _(load):
    return load("orders").groupBy("o_orderstatus").count().select("o_orderstatus", r(F.col("count") + K.laplace(1.0, 1.0, 7, F.col("o_orderstatus"))).alias("noisy"))


@query("k2_gaussian_noise", f"""SELECT o_orderstatus, round(count(*) + sqrt(-2 * ln({_uniform_sql("'radius'", "o_orderstatus")})) * cos(2 * pi() * {_uniform_sql("'angle'", "o_orderstatus")})
  * sqrt(2 * ln(1.25 / 1e-5)), 6) AS noisy FROM orders GROUP BY o_orderstatus""")
def _(load):
    return load("orders").groupBy("o_orderstatus").count().select("o_orderstatus", r(F.col("count") + K.gaussian(1.0, 1e-5, 1.0, 7, F.col("o_orderstatus"))).alias("noisy"))


@query("k3_private_histogram", f"""SELECT event_type AS value, greatest(round(count(*) + {_laplace_sql(1, "'event_type'", 'event_type')}), 0)::BIGINT AS n FROM events GROUP BY event_type""")
def _(load):
    return K.private_histogram(load("events"), "event_type", 1.0, 7)


@query("k3_private_count", f"""SELECT greatest(round(count(*) + {_laplace_sql(1, "'count'")}), 0)::BIGINT AS n FROM orders""")
def _(load):
    return K.private_count(load("orders"), 1.0, 7)


@query("k4_private_mean", f"""SELECT round(avg(greatest(least(value, 200), 0)) + {_laplace_sql(1, "'mean'", "'value'")} * 200 / count(value), 6) AS mean FROM events""")
def _(load):
    return K.private_mean(load("events"), "value", 0.0, 200.0, 1.0, 7).select(r("mean").alias("mean"))


_STATS = profile_sql("orders", text=False)


@query("k5_budget", f"SELECT column_name, round(0.1::DOUBLE * row_number() OVER (ORDER BY column_name), 6) AS spent, row_number() OVER (ORDER BY column_name) <= 3 AS answered FROM {_STATS} p")
def _(load):
    rows = profile({"orders": load("orders")}, {"numbers", "values"}).select("column_name", F.coalesce("mean", F.lit(0.0)).alias("value"))
    found = K.budgeted(rows, "column_name", 0.3, seed=7)
    return found.select("column_name", r("spent").alias("spent"), F.col("private_value").isNotNull().alias("answered"))


@query("k6_k_anonymity", """
SELECT event_id, CASE WHEN n < 80 THEN '*' ELSE CAST(e.user_id AS VARCHAR) END AS user_id FROM events e JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) g ON e.user_id = g.user_id""")
def _(load):
    return K.k_anonymous(load("events").select("event_id", "user_id"), "user_id", 80).select("event_id", "user_id")


@query("k7_two_level_anonymity", """
SELECT event_id, CASE WHEN n < 70 THEN '*' WHEN n < 90 THEN 'OTHER' ELSE CAST(e.user_id AS VARCHAR) END AS user_id FROM events e JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) g ON e.user_id = g.user_id""")
def _(load):
    return K.k_anonymous(load("events").select("event_id", "user_id"), "user_id", 90, 70).select("event_id", "user_id")


@query("k8_salted_hash", "SELECT c_custkey, sha256('pepper' || c_name) AS sha, md5('pepper' || c_name) AS short FROM customer")
def _(load):
    return load("customer").select("c_custkey", K.salted_hash(F.col("c_name"), "pepper").alias("sha"), K.salted_hash(F.col("c_name"), "pepper", "md5").alias("short"))


@query("k9_discretise", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE least(4, floor((greatest(least(c_acctbal, 8000), 0)) / 1600)) END::BIGINT AS bin FROM customer""")
def _(load):
    value = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return load("customer").select("c_custkey", K.discretise(value, 5, 0.0, 8000.0).alias("bin"))


@query("k10_generalise", "SELECT c_custkey, round_even(c_acctbal, 1) + 0.0::DOUBLE AS value FROM customer")
def _(load):
    return load("customer").select("c_custkey", (K.generalise(F.col("c_acctbal"), 1) + F.lit(0.0)).alias("value"))


@query("k11_without_identifiers", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(load):
    return K.without_identifiers(load("customer"))


@query("k12_private_fingerprint", f"""SELECT least(4, floor(null_pct * 5))::BIGINT AS null_pct_bucket, least(4, floor(unique_ratio * 5))::BIGINT AS unique_ratio_bucket,
  substr(sha256(column_name), 1, 16) AS column_name_hash, substr(sha256(table_name), 1, 16) AS table_name_hash, is_numeric, is_categorical, is_temporal, round_even(skewness, 2) + 0.0::DOUBLE AS skewness_anonymous FROM {_STATS} p""")
def _(load):
    found = K.private_fingerprint(profile({"orders": load("orders")}), noise=False)
    return found.select("null_pct_bucket", "unique_ratio_bucket", "column_name_hash", "table_name_hash", "is_numeric", "is_categorical", "is_temporal",
                        (F.col("skewness_anonymous") + F.lit(0.0)).alias("skewness_anonymous"))


def _noisy_sql(c: str) -> str:
    return f"""round_even({c} + {_laplace_sql(2, f"'{c}'", "table_name", "column_name")}, 1) + 0.0::DOUBLE AS {c}_anonymous"""


_MOMENTS = ("mean", "median", "std", "skewness", "kurtosis")


@query("k12_noisy_fingerprint", f"""SELECT {", ".join(_noisy_sql(c) for c in _MOMENTS)}, least(2, floor(null_pct * 3))::BIGINT AS null_pct_bucket, least(2, floor(unique_ratio * 3))::BIGINT AS unique_ratio_bucket,
  substr(sha256(column_name), 1, 16) AS column_name_hash, substr(sha256(table_name), 1, 16) AS table_name_hash, is_numeric, is_categorical, is_temporal FROM {_STATS} p""")
def _(load):
    found = K.private_fingerprint(profile({"orders": load("orders")}), "high", seed=7)
    return found.withColumns({f"{c}_anonymous": F.col(f"{c}_anonymous") + F.lit(0.0) for c in _MOMENTS})
