"""Relations and SQL fragments several catalogue modules share."""

from __future__ import annotations

from colsmith.functions import constants as K

# Orders dressed up as the kind of table people upload: nulls, currency, contacts, codes.
MESSY = {
    "order_id": ("n", "o_orderkey"),
    "price_text": ("s", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('$', CAST(o_custkey AS STRING), '.50') END"),
    "share_text": ("s", "concat(CAST(o_custkey % 100 AS STRING), '%')"),
    "is_open": ("s", "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END"),
    "level": ("s", "CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"),
    "email": ("s", "concat('user', CAST(o_custkey AS STRING), '@mail', CAST(o_custkey % 5 AS STRING), '.example.com')"),
    "phone": ("s", "concat('555', lpad(CAST(o_custkey AS STRING), 7, '0'))"),
    "photo_url": ("s", "concat('https://host', CAST(o_custkey % 9 AS STRING), '.example.com/', CAST(o_orderkey AS STRING))"),
    "day_text": ("s", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
    "note": ("s", "CASE o_orderkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL ELSE 'fine,  ok' END"),
    "amount": ("n", "CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE o_totalprice END"),
    "payload": ("s", "concat('{\"a\": {\"b\": [', CAST(o_custkey AS STRING), ']}}')"),
    "code": ("n", "CASE WHEN o_orderkey % 50 = 0 THEN -999 ELSE o_custkey END"),
    "flag": ("n", "CAST(o_orderkey % 2 AS INT)"),
    "constant": ("s", "'same'"),
    "model_year": ("n", "CAST(2000 + o_custkey % 20 AS INT)"),
}
MESSY_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e) in MESSY.items()) + " FROM orders)"

# Column kinds of the star tables: n number, s text, t time, in table order.
STAR = {
    "region": {"r_regionkey": "n", "r_name": "s"},
    "nation": {"n_nationkey": "n", "n_name": "s", "n_regionkey": "n"},
    "customer": {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "n", "s_name": "s", "s_nationkey": "n", "s_acctbal": "n"},
    "part": {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"},
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n",
                 "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
    "events": {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "n", "props": "s"},
}


def messy(load):
    """The texts cost far more than reading orders, whose file may hold all rows in one stretch; so the rows are dealt out first. Most texts are made of
    the customer's key, so a customer's rows go together; a part with too many of them is split."""
    return load("orders").hint("rebalance", "o_custkey").selectExpr(*[f"{e} AS {c}" for c, (_, e) in MESSY.items()])


def frames(load, *names):
    return {n: messy(load) if n == "messy" else load(n) for n in names}


def _kinds(name):
    return {c: k for c, (k, _) in MESSY.items()} if name == "messy" else STAR[name]


def quoted(pattern: str) -> str:
    """A Java pattern as an RE2 literal; word characters of any script are spelled out."""
    text = pattern.replace(r"(?U)[^\w\s]", r"[^\p{L}\p{M}\p{N}_\s]").replace(r"(?U:\w)", r"[\p{L}\p{M}\p{N}_]")
    return "'" + text.replace("'", "''") + "'"


def _share(condition):
    return f"coalesce(avg(CASE WHEN x IS NOT NULL THEN ({condition})::INT END), 0)"


def profile_sql(*names: str, text: bool = True, semantics: bool = False) -> str:
    """SQL of the profile table, one branch per column."""
    branches = []
    for name in names:
        relation = MESSY_SQL if name == "messy" else name
        for place, (column, kind) in enumerate(_kinds(name).items()):
            cast = "CAST({} AS DOUBLE)".format(column) if kind == "n" else column
            common = (
                f"'{name}' AS table_name, '{column}' AS column_name, {place} AS position, {kind == 'n'} AS is_numeric, {kind == 's'} AS is_string, "
                f"{kind == 't'} AS is_temporal, count(*) AS row_count, count(x) AS present, count(DISTINCT x) AS unique_count, "
                "(SELECT max(n) FROM v) AS top_count, (SELECT sum(n * log2(n)) FROM v) AS sum_n_log"
            )
            ctes = (f"c AS (SELECT {cast} AS x FROM {relation} r), v AS (SELECT x, count(*) AS n FROM c WHERE x IS NOT NULL GROUP BY x)")
            extra = ""
            if kind == "n":
                ctes += ", q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM c)"
                extra = (
                    ", min(x) AS min_value, max(x) AS max_value, avg(x) AS mean, quantile_cont(x, 0.5) AS median, (SELECT q1 FROM q) AS q25, "
                    "(SELECT q3 FROM q) AS q75, stddev_samp(x) AS std, stddev_pop(x) AS std_pop, skewness(x) AS skewness, kurtosis(x) AS kurtosis, "
                    "kurtosis_pop(x) AS kurt_pop, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x > 0) AS positives, count(*) FILTER (x < 0) AS negatives, "
                    "count(*) FILTER (x % 1 <> 0) AS decimals, count(*) FILTER (x IN (-999, -9999, 99999, 999999, -1)) AS encoded_nulls, "
                    "(SELECT count(*) FROM c, q WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
                    "(SELECT count(*) FROM c, q WHERE x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) AS far_outlier_count"
                )
                if semantics:
                    digits = "CAST(CAST(x AS BIGINT) AS VARCHAR)"
                    extra += f", avg(length({digits})) AS avg_length, {_share(f'x % 1 = 0 AND length({digits}) BETWEEN 10 AND 15')} AS sem_phone"
            elif kind == "s":
                extra = (
                    ", avg(length(x)) AS avg_length, min(length(x)) AS min_length, max(length(x)) AS max_length, stddev_samp(length(x)) AS length_std"
                )
                if text:
                    for n, p in K.VALUE_PATTERNS.items():
                        extra += f", {_share(f'regexp_matches(x, {quoted(f'^(?:{p})')})')} AS {n}"
                    for n, p in K.CONTENT_PATTERNS.items():
                        extra += f", coalesce(bool_or(regexp_matches(x, {quoted(p)})), FALSE) AS {n}"
                    for n, p in K.DOMAIN_PATTERNS.items():
                        extra += f", {_share(f'regexp_matches(x, {quoted(f'^(?:{p})')})')} AS dpm_{n}"
                    hits = " + ".join(f"coalesce(max(regexp_matches(x, {quoted(p)})::INT), 0)" for p in K.COMPLEXITY_PATTERNS)
                    words = ", ".join(f"'{w}'" for w in K.NULL_WORDS)
                    dates = " + ".join(f"count(*) FILTER (contains(x, '{d}'))" for d in K.NULL_DATES)
                    scales = " OR ".join("coalesce(bool_and(lower(x) IN (" + ", ".join(f"'{w}'" for w in s) + ")), FALSE)" for s in K.ORDINAL_SCALES)
                    extra += (f", {hits} AS complexity_hits, {_share('json_valid(x)')} AS matches_json, "
                              f"count(*) FILTER (lower(x) IN ({words})) + {dates} AS encoded_nulls, "
                              f"({scales} OR coalesce(bool_and(regexp_matches(x, '^\\d+$')), FALSE)) AS all_ordinal")
                if semantics:
                    for n, p in K.SEMANTIC_PATTERNS.items():
                        arg = "trim(x)" if n == "phone" else "x"
                        extra += f", {_share(f'regexp_matches({arg}, {quoted(p)})')} AS sem_{n}"
                    extra += f", {_share(f'regexp_matches(x, {quoted(K.EMAIL)})')} AS sem_email, {_share('TRY_CAST(trim(x) AS DOUBLE) IS NOT NULL')} AS sem_number"
                    for n, p in K.SECOND_PATTERNS.items():
                        extra += f", {_share(f'regexp_matches(trim(x), {quoted(p)})')} AS alt_{n}"
                    extra += f", {_share(f'regexp_matches(trim(x), {quoted(K.EMAIL)})')} AS alt_email, avg(length(trim(x))) AS trimmed_length"
                    nulls = ", ".join(f"'{w}'" for w in K.NULL_INDICATORS)
                    sets = lambda ss: " OR ".join("coalesce(bool_and(lower(trim(x)) IN (" + ", ".join(f"'{w}'" for w in s) + ")), FALSE)" for s in ss)
                    extra += (f", count(*) FILTER (lower(trim(x)) IN ({nulls})) AS null_indicators, ({sets(K.BOOLEAN_SETS)}) AS in_boolean_set, "
                              f"({sets(K.BINARY_SETS)}) AS in_binary_set")
            branches.append(f"SELECT * FROM (WITH {ctes} SELECT {common}{extra} FROM c) b")
    union = " UNION ALL BY NAME ".join(branches)
    return f"""(SELECT *, row_count - present AS null_count, (row_count - present) / row_count AS null_pct, unique_count / row_count AS unique_ratio,
  (row_count - unique_count) / row_count AS duplicate_ratio, max_value - min_value AS range_size, q75 - q25 AS iqr,
  CASE WHEN is_numeric THEN CASE WHEN mean <> 0 THEN abs(std / mean) ELSE 0 END END AS cv,
  outlier_count / present AS outlier_pct, far_outlier_count / present AS far_outlier_pct, top_count / present AS top_share,
  top_count / row_count AS mode_frequency, CASE WHEN unique_count > 1 THEN (log2(present) - sum_n_log / present) / log2(unique_count) ELSE 0 END AS entropy,
  (present * log2(row_count) - sum_n_log) / row_count AS entropy_bits, coalesce(encoded_nulls, 0) / row_count AS encoded_null_ratio,
  is_string AND unique_count / row_count < 0.5 AS is_categorical FROM ({union}) u)"""
