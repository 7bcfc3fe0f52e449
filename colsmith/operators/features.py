"""Feature vectors of columns: 20, 30, 62 and 40 numbers per column.

They are projections over the profile table. Two further passes serve the features a profile
does not hold: diversity of characters, hosts and domains, and order-dependent measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import constants as K
from colsmith.functions import scalar as S
from colsmith.operators import profile as P
from colsmith.operators.ordering import SEGMENT_ROWS, with_lags

LAGS = (1, 7, 12, 24)


def named(*words: str) -> Column:
    """The lower-cased column name contains one of the words."""
    return S.any_of([F.lower("column_name").contains(w) for w in words])


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def _number() -> Column:
    return F.col("is_numeric") & (F.col("present") > 0)


def _type_code() -> Column:
    return S.first_match([
        (F.col("is_numeric"), 0), (F.col("is_categorical"), 1), (F.col("is_temporal"), 3), (F.col("is_text"), 2)], 4)


def _bimodality() -> Column:
    n = F.col("present").cast("double")
    bottom = F.col("kurt_pop") + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    value = S.safe_ratio(F.col("skew_pop") * F.col("skew_pop") + 1, bottom)
    return zero(F.when(_number() & (n > 3) & (F.col("std_pop") > 0), value))


def _first_signal() -> Column:
    return S.first_match([(named(w), v) for w, v in K.NAME_SIGNALS], 0.0)


def minimal_features(profile: DataFrame) -> DataFrame:
    """20 features per column."""
    median = F.col("median")
    spread = F.when(F.col("iqr") > 0, F.col("outlier_pct"))
    return profile.select(
        "table_name", "column_name",
        F.col("null_pct").alias("null_percentage"), "unique_ratio",
        zero("skew_pop").alias("skewness"), zero(spread).alias("outlier_percentage"),
        F.col("entropy_bits").alias("entropy"), "pattern_complexity", _bimodality().alias("multimodality_score"),
        S.first_match([(F.col("unique_ratio") > 0.95, 3), (F.col("unique_count") > 50, 2), (F.col("unique_count") > 10, 1)], 0)
        .alias("cardinality_bucket"),
        _type_code().alias("detected_dtype"), _first_signal().alias("column_name_signal"),
        zero(F.when(F.col("present") > 3, F.col("kurt_pop"))).alias("kurtosis"),
        zero(F.when(F.col("mean") != 0, F.col("std_pop") / F.abs(F.col("mean")))).alias("coefficient_of_variation"),
        zero("zero_ratio").alias("zero_ratio"), flag(F.col("negatives") > 0).alias("has_negative"),
        flag(F.col("decimals") > 0).alias("has_decimal"),
        flag(named("id", "key", "uuid")).alias("name_contains_id"),
        flag(named("date", "time", "timestamp")).alias("name_contains_date"),
        flag(named("price", "cost", "amount", "revenue")).alias("name_contains_price"),
        zero(F.when(median != 0, F.col("range_size") / median)).alias("range_ratio"),
        zero(F.when((median != 0) & (F.col("present") > 3), F.col("iqr") / median)).alias("iqr_ratio"),
    )


def diversity(df: DataFrame, table_name: str) -> DataFrame:
    """Distinct characters, URL hosts and mail domains per text column."""
    texts = [f for f in P.fields_of({table_name: df}) if f.is_text]
    spark = df.sparkSession
    schema = "table_name string, column_name string, chars bigint, hosts bigint, host_rows bigint, domains bigint, domain_rows bigint"
    found = {f.k: dict.fromkeys(("chars", "hosts", "host_rows", "domains", "domain_rows"), 0) for f in texts}
    if texts:
        cells = P.stacked(texts, lambda f: F.struct(F.lit(f.k).alias("k"), f.column.alias("x")))
        items = cells.where(F.col("x").isNotNull()).select("k", F.explode(F.concat(
            F.transform(F.array_distinct(F.split("x", "")), lambda ch: F.struct(F.lit("chars").alias("kind"), ch.alias("item"))),
            F.array(
                F.struct(F.lit("hosts").alias("kind"), F.regexp_extract("x", r"https?://([^/]+)", 1).alias("item")),
                F.struct(F.lit("domains").alias("kind"), F.regexp_extract("x", r"@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", 1).alias("item"))),
        )).alias("e")).select("k", "e.kind", "e.item").where(F.col("item") != "")
        counted = items.groupBy("k", "kind", "item").agg(F.count(F.lit(1)).alias("n"))
        for r in counted.groupBy("k", "kind").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect():
            found[r["k"]][r["kind"]] = r["d"]
            if r["kind"] != "chars":
                found[r["k"]][f"{r['kind'][:-1]}_rows"] = r["n"]
    rows = [(table_name, f.name, *found[f.k].values()) for f in texts]
    return spark.createDataFrame(rows, schema)


def sequence_features(df: DataFrame, table_name: str, order_by: list[str],
                      chunk_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Lag correlations, direction counts and trend of every number column in a given order."""
    numbers = [f for f in P.fields_of({table_name: df}) if f.is_number]
    keys = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order_by)]
    cells = [F.struct(F.lit(f.name).alias("column_name"), f.number.alias("x")) for f in numbers]
    long = df.select(*keys, F.inline(F.array(*cells))).where(F.col("x").isNotNull())
    lagged = with_lags(long, "x", list(LAGS), [f"o{i}" for i in range(len(order_by))], ["column_name"],
                       chunk_rows, chunk_rows)
    step = F.col("x") - F.col("lag_1")
    made = [F.count(F.lit(1)).alias("n"), F.count_if(step >= 0).alias("up"), F.count_if(step <= 0).alias("down"),
            F.corr(F.col("position").cast("double"), "x").alias("trend")]
    made += [F.corr("x", f"lag_{k}").alias(f"corr_{k}") for k in LAGS]
    found = lagged.groupBy("column_name").agg(*made)
    clean = {f"corr_{k}": F.coalesce(F.nanvl(F.col(f"corr_{k}"), F.lit(0.0)), F.lit(0.0)) for k in LAGS}
    clean["trend"] = F.coalesce(F.nanvl(F.col("trend"), F.lit(0.0)), F.lit(0.0))
    return found.withColumns(clean).withColumn("table_name", F.lit(table_name))


def _naming_quality() -> Column:
    name = F.col("column_name")
    return (
        F.when(name.contains("_") | name.rlike("^[a-z]"), 0.3).otherwise(0.0) + F.when(F.length(name) > 3, 0.2).otherwise(0.0)
        + F.when(name.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), 0.3).otherwise(0.0) + F.when(F.length(name) < 30, 0.2).otherwise(0.0)
    )


def _text_share(c: str) -> Column:
    return zero(F.when(F.col("is_string"), F.col(c)))


def enhanced_features(profile: DataFrame, diverse: DataFrame, sequence: DataFrame) -> DataFrame:
    """30 features per column: the first ten of the 20 and twenty more."""
    keys = ["table_name", "column_name"]
    base = minimal_features(profile).select(*keys, "null_percentage", "unique_ratio", "skewness", "outlier_percentage", "entropy",
                                            "pattern_complexity", "multimodality_score", "cardinality_bucket", "detected_dtype",
                                            "column_name_signal")
    long_enough = F.col("n_seq") > 10
    joined = profile.join(diverse, keys, "left").join(sequence.withColumnRenamed("n", "n_seq"), keys, "left")
    gaps = 1 - F.col("unique_count") / (F.col("max_value") - F.col("min_value") + 1)
    key_like = (F.col("unique_ratio") > 0.95) & (F.col("null_pct") < 0.01)
    more = joined.select(
        *keys,
        zero("q25").alias("quantile_25"), zero("q75").alias("quantile_75"),
        F.when(F.col("is_numeric"), F.col("top_share")).otherwise(F.col("mode_frequency")).alias("mode_frequency"),
        zero(F.when(F.col("is_integer") & (F.col("unique_count") > 1), gaps)).alias("has_value_gaps"),
        zero(F.when(F.col("median") != 0, F.abs(F.col("iqr") / F.col("median")))).alias("coefficient_dispersion"),
        _text_share("avg_length").alias("avg_string_length"),
        zero(F.when(F.col("avg_length") > 0, F.col("chars") / (F.col("avg_length") * F.col("present")))).alias("char_diversity"),
        _text_share("matches_numeric_pattern").alias("numeric_string_ratio"),
        S.first_match([(named(*words), i) for i, words in enumerate(K.SEMANTIC_KEYWORDS)], 5).alias("semantic_type"),
        S.first_match([(named(*words), i) for i, words in enumerate(K.BUSINESS_KEYWORDS)], 5).alias("domain_category"),
        _naming_quality().alias("naming_quality_score"),
        F.when((F.col("unique_ratio") > 0.1) & (F.col("unique_ratio") < 0.95) & named("_id", "fk_", "ref_"), 0.8).otherwise(0.0)
        .alias("is_foreign_key_candidate"),
        F.when(key_like, F.when(named("id", "key", "pk"), 1.0).otherwise(0.5)).otherwise(0.0).alias("is_primary_key_candidate"),
        zero(F.when(long_enough, F.col("corr_1"))).alias("autocorrelation_lag1"),
        zero(F.when(long_enough, F.greatest("up", "down") / F.col("n_seq"))).alias("is_monotonic_score"),
        _text_share("embedded_nulls").alias("has_embedded_nulls"),
        zero(F.when(F.col("host_rows") > 0, F.col("hosts") / F.col("host_rows"))).alias("url_host_diversity"),
        zero(F.when(F.col("domain_rows") > 0, F.col("domains") / F.col("domain_rows"))).alias("email_domain_diversity"),
        _text_share("json_depth").alias("json_complexity"), _text_share("looks_delimited").alias("delimited_pattern_score"),
    )
    return base.join(more, keys)


def meta_learning_features(profile: DataFrame, diverse: DataFrame, sequence: DataFrame) -> DataFrame:
    """62 features per column: ten basic, twenty from the name, fifteen "looks like", and shapes."""
    keys = ["table_name", "column_name"]
    basic = ["null_percentage", "unique_ratio", "skewness", "outlier_percentage", "entropy", "pattern_complexity",
             "multimodality_score", "cardinality_bucket", "detected_dtype", "column_name_signal"]
    base = minimal_features(profile).select(*keys, *basic)
    low, high, mean = F.col("min_value"), F.col("max_value"), F.col("mean")
    number = _number()
    text = F.col("detected_dtype").isin(1, 2) & (F.col("present") > 0)
    enough = number & (F.col("present") >= 10)
    name = F.col("column_name")
    j = profile.drop("unique_ratio", "entropy", "pattern_complexity", "skewness").join(base, keys)
    j = j.join(diverse, keys, "left").join(sequence.withColumnRenamed("n", "n_seq"), keys, "left")

    def number_when(*cases):
        return zero(F.when(number, S.first_match(list(cases), 0.0)))

    def text_over(column: str, bound: float) -> Column:
        return flag(text & (F.col(column) > bound))

    dispersion = zero(F.when(enough & (mean != 0), F.abs(F.col("iqr") / mean)))
    relative = zero(F.when(enough & (mean != 0), F.col("range_size") / F.abs(mean)))
    shape = S.first_match([
        ((relative > 0) & (dispersion < 0.3), 2), (F.col("multimodality_score") > 0.555, 4),
        (F.col("skew_pop").between(-0.5, 0.5), 1), (F.col("skew_pop") > 1.5, 3)], 0)
    ordered = number & (F.col("n_seq") >= 20)
    seasonal = F.greatest(*[F.when((F.col("n_seq") / 2 > k) & (F.abs(F.col(f"corr_{k}")) > 0.3), F.abs(F.col(f"corr_{k}"))).otherwise(F.lit(0.0))
                            for k in LAGS if k > 1])
    return j.select(
        *keys, *basic,
        *[flag(named(*words)).alias(f"name_contains_{group}") for group, words in K.NAME_GROUPS.items()],
        flag(F.length(name) <= 3).alias("name_is_short"), flag(F.length(name) >= 20).alias("name_is_long"),
        number_when(((low >= 1900) & (high <= 2100) & (mean > 1950), 1.0)).alias("looks_like_year"),
        number_when(((low >= 0) & (high <= 120) & (mean > 0) & (high < 100), 0.8), ((low >= 0) & (high <= 120) & (mean > 0), 0.5)).alias("looks_like_age"),
        number_when(((low >= 0) & (high <= 5), 1.0), ((low >= 0) & (high <= 10), 0.8)).alias("looks_like_rating"),
        number_when(((low >= 0) & (high <= 100), 0.7)).alias("looks_like_percentage"),
        text_over("looks_money", 0.3).alias("looks_like_currency"), text_over("looks_zip", 0.5).alias("looks_like_zipcode"),
        text_over("looks_call", 0.5).alias("looks_like_phone"), text_over("sem_email", 0.5).alias("looks_like_email"),
        text_over("looks_web", 0.5).alias("looks_like_url"),
        flag(text & (F.col("unique_lower") <= 3) & F.col("boolean_words")).alias("looks_like_boolean"),
        zero(F.when(text, S.first_match([((F.col("unique_ratio") < 0.1) & (F.col("cardinality_bucket") <= 1), 1.0),
                                         (F.col("unique_ratio") < 0.3, 0.5)], 0.0))).alias("looks_like_categorical"),
        flag(text & (F.col("unique_lower") <= 5) & F.col("ordinal_words")).alias("looks_like_ordinal"),
        text_over("looks_code", 0.5).alias("looks_like_code"),
        zero(F.when(text, S.first_match([((F.col("avg_length") > 50) & (F.col("length_std") > 20), 1.0), (F.col("avg_length") > 20, 0.5)], 0.0)))
        .alias("looks_like_freetext"),
        text_over("looks_special", 0.1).alias("has_special_characters"),
        F.when(enough & (F.col("std") > 0) & (F.col("present") >= 30), shape).otherwise(0).alias("distribution_type"),
        zero(F.when(enough, F.col("top_share"))).alias("mode_spike_ratio"), flag(enough & (F.col("outlier_count") > 0)).alias("has_outlying_values"),
        zero(F.when(enough, F.col("q25"))).alias("quantile_25"), zero(F.when(enough, F.col("q75"))).alias("quantile_75"),
        dispersion.alias("coefficient_dispersion"), relative.alias("range_normalized"), flag(enough & (F.col("zeros") > 0)).alias("contains_zeros"),
        _text_share("avg_length").alias("avg_string_length"),
        zero(F.when(F.col("avg_length") > 0, F.col("chars") / (F.col("avg_length") * F.col("present")))).alias("char_diversity"),
        _text_share("matches_numeric_pattern").alias("numeric_string_ratio"), _text_share("mixed_case").alias("has_mixed_case"),
        _text_share("word_count").alias("word_count_avg"),
        zero(F.when(ordered, F.col("corr_1"))).alias("autocorrelation_lag1"),
        zero(F.when(ordered, F.greatest("up", "down") / (F.col("n_seq") - 1))).alias("is_monotonic_score"),
        zero(F.when(ordered & (F.col("n_seq") >= 50), seasonal)).alias("seasonality_score"),
        zero(F.when(ordered, F.abs(F.col("trend")))).alias("trend_strength"),
    )


def meta_features(profile: DataFrame) -> DataFrame:
    """40 features per column, the input of the hybrid rules and of the action models."""
    number = _number()
    stringy = F.col("is_string") & (F.col("present") > 0)
    spread = F.when((F.col("iqr") > 0) & (F.col("present") > 3), F.col("outlier_pct"))
    ratio = F.col("unique_ratio")

    def num(c):
        return zero(F.when(number, F.col(c)))

    return profile.select(
        "table_name", "column_name",
        F.col("null_pct").alias("missing_ratio"), "unique_ratio",
        (F.log1p(F.col("unique_count").cast("double")) / 10).alias("unique_count_norm"),
        (F.log1p(F.col("row_count").cast("double")) / 15).alias("row_count_norm"), flag(F.col("null_pct") == 0).alias("is_complete"),
        flag(F.col("is_numeric")).alias("is_numeric"), flag(F.col("type_name") == "boolean").alias("is_bool"),
        flag(F.col("is_temporal")).alias("is_datetime"), flag(F.col("is_string")).alias("is_object"),
        flag(F.col("is_categorical")).alias("is_categorical"),
        num("mean").alias("mean"), num("std_pop").alias("std"), num("min_value").alias("min"), num("max_value").alias("max"),
        num("median").alias("median"), num("skew_pop").alias("skewness"), zero(F.when(F.col("present") > 3, F.col("kurt_pop"))).alias("kurtosis"),
        zero(F.when(number, spread)).alias("outlier_ratio"), num("positive_ratio").alias("positive_ratio"),
        num("negative_ratio").alias("negative_ratio"), num("zero_ratio").alias("zero_ratio"),
        flag(number & (F.col("min_value") > 0)).alias("can_log"), flag(number & (F.col("min_value") >= 0)).alias("can_sqrt"),
        flag(number & (F.col("range_size") > 1e-10)).alias("has_range"), flag(number & (F.col("std_pop") > 1e-10)).alias("has_variance"),
        zero(F.when(stringy, F.col("avg_length"))).alias("avg_length"), zero(F.when(stringy, F.col("max_length").cast("double"))).alias("max_length"),
        zero(F.when(stringy, F.col("min_length").cast("double"))).alias("min_length"), zero(F.when(stringy, F.col("length_std"))).alias("length_std"),
        flag(ratio < 0.01).alias("cardinality_low"), flag((ratio >= 0.01) & (ratio < 0.5)).alias("cardinality_medium"),
        flag((ratio >= 0.5) & (ratio < 0.95)).alias("cardinality_high"), flag(ratio >= 0.95).alias("cardinality_unique"),
        F.col("entropy_bits").alias("entropy"), "mode_frequency",
        *[flag(named(*words)).alias(group) for group, words in K.SHORT_NAME_GROUPS.items()],
    )
