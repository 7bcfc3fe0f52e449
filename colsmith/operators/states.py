"""Profiles that merge: the state of each column after one load, to be stored and united with the states of other loads.

A state needs one scan of a load, and a second one for the columns of few distinct values. It has counts, centred moments (which add by the parallel formulas, not as raw powers),
shares of patterns weighted by their values, an HLL sketch of distinct values and a KLL sketch of quantiles. A column with up to ``EXACT_VALUES`` distinct values
by its sketch also has the exact count of every value. Merging reads states only, so the profile of a year of loads costs one row a load and column.

From merged states everything is exact but, where a column has more distinct values, the distinct count (within ``DISTINCT_ERROR``), and quartiles and outlier counts (within
``RANK_ERROR`` of the rows) everywhere. Entropy, top value and ordinal scales need value counts and are null for columns without. A column is a
counted one only while all its loads counted it and the union stays within the bound. An empty load has a state of zeros and changes nothing; a column that a load lacks counts as absent there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions import constants as K
from colsmith.functions import scalar as S
from colsmith.operators import profile as P
from colsmith.session import checkpoint

EXACT_VALUES = 1_000
HLL_BITS = 14
KLL_SIZE = 2_000
GRID = 1_000  # quantiles that outliers are counted by
DISTINCT_ERROR = 0.03  # three standard errors of the HLL sketch
RANK_ERROR = 0.004  # of the rows, on each side of a quantile
KEYS = ["table_name", "column_name"]
_COUNTED = ["zeros", "positives", "negatives", "decimals", "encoded_nulls"]
_SHARES = [*K.VALUE_PATTERNS, "matches_json"]


@dataclass
class State:
    """``columns``: one row a table and column; ``values``: counts of the values of counted columns."""

    columns: DataFrame
    values: DataFrame

    def save(self, path: str) -> None:
        self.columns.write.mode("overwrite").parquet(f"{path}/columns")
        self.values.write.mode("overwrite").parquet(f"{path}/values")

    @staticmethod
    def load(spark: SparkSession, path: str) -> State:
        return State(spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/values"))


def _text_state(x: Column) -> dict[str, Column]:
    present = x.isNotNull().cast("bigint")
    found = P.text_aggregates(x, F.when(x.isNotNull(), F.lit(1)))
    hits = reduce(lambda a, b: a.bitwiseOR(b), [F.max(F.coalesce(S.has_pattern(x, p), F.lit(False)).cast("int")) * (1 << i) for i, p in enumerate(K.COMPLEXITY_PATTERNS)])
    size = F.length(x).cast("bigint")
    return {
        **{c: F.coalesce(found[c], F.lit(0.0)) for c in _SHARES}, **{c: found[c] for c in K.CONTENT_PATTERNS}, "domain_pattern_matches": found["domain_pattern_matches"],
        "word_nulls": F.coalesce(found["encoded_nulls"], F.lit(0)).cast("bigint"), "hits": hits, "chars": F.sum(size), "chars_squared": F.sum(size.cast("double") * size),
        "min_length": F.min(size), "max_length": F.max(size), "texts": F.sum(present)}


def state(tables: dict[str, DataFrame]) -> State:
    """State of all simple columns of the tables."""
    fields = P.fields_of(tables)
    spark = next(iter(tables.values())).sparkSession
    nothing = F.lit(None).cast("double")
    cells = P.stacked(fields, lambda f: F.struct(
        F.lit(f.k).alias("k"), f.column.isNotNull().alias("has"), (f.number if f.is_number else nothing).alias("x"),
        (f.column.cast("string") if f.is_text else F.lit(None).cast("string")).alias("text"), F.when(f.column.isNotNull(), F.xxhash64(f.column)).alias("h")))
    x, n = F.col("x"), F.count("x")
    spread = F.coalesce(F.var_pop("x"), F.lit(0.0))
    made = {
        "row_count": F.count(F.lit(1)), "present": F.count_if("has"), "numbers": n, "min_value": F.min("x"), "max_value": F.max("x"), "mean": F.avg("x"), "m2": spread * n,
        "m3": F.coalesce(F.when(spread > 0, F.skewness("x")), F.lit(0.0)) * n * F.pow(spread, 1.5), "m4": F.when(spread > 0, F.kurtosis("x") + 3).otherwise(0.0) * n * spread * spread,
        **{c: P._NUMBER_FIELDS[c](x).cast("bigint") for c in _COUNTED}, **_text_state(F.col("text")),
        "hll": F.hll_sketch_agg("h", F.lit(HLL_BITS)), "kll": F.kll_sketch_agg_double("x", F.lit(KLL_SIZE))}
    found = cells.groupBy("k").agg(*[c.alias(name) for name, c in made.items()])
    places, of = {}, []
    for f in fields:
        places[f.table] = places.get(f.table, -1) + 1
        of.append((f.k, f.table, f.name, places[f.table], f.source_kind, f.is_number, f.is_text, S.is_time_type(f.kind), f.kind in P.WHOLE))
    names = F.broadcast(spark.createDataFrame(of, "k int, table_name string, column_name string, position int, type_name string, is_numeric boolean, is_string boolean, "
                                                  "is_temporal boolean, is_integer boolean"))
    columns = names.join(found, "k", "left").fillna(0, ["row_count", "present", "numbers", *_COUNTED, "texts", "word_nulls"])
    columns = checkpoint(columns.withColumn("counted", F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0)) <= EXACT_VALUES))
    few = {r["k"] for r in columns.where("counted").select("k").collect()}
    fields = [f for f in fields if f.k in few]
    if fields:
        values = P.value_counts(fields).join(names.select("k", *KEYS), "k").select(*KEYS, "whole", "real", "word", "digest", "n")
    else:
        values = spark.createDataFrame([], "table_name string, column_name string, whole bigint, real double, word string, digest string, n bigint")
    return State(columns.drop("k").withColumn("loads", F.lit(1)), checkpoint(values))


def merge(states: list[State]) -> State:
    """The state of the loads together; types and places are those of the first state that knows the column."""
    columns = reduce(lambda a, b: a.unionByName(b), [s.columns.withColumn("first", F.lit(i)) for i, s in enumerate(states)])
    values = reduce(lambda a, b: a.unionByName(b), [s.values for s in states])
    everywhere = W.partitionBy(*KEYS)
    columns = columns.withColumn("together", F.sum(F.coalesce(F.col("mean"), F.lit(0.0)) * F.col("numbers")).over(everywhere) / F.nullif(F.sum("numbers").over(everywhere), F.lit(0)))
    d, n, m2, m3 = F.coalesce(F.col("mean") - F.col("together"), F.lit(0.0)), F.col("numbers"), F.col("m2"), F.col("m3")
    total = F.sum("texts")

    def weighted(c: Column) -> Column:
        return F.coalesce(F.sum(c * F.col("texts")) / F.nullif(total, F.lit(0)), F.lit(0.0))

    made = {
        **{c: F.min_by(c, "first") for c in ("position", "type_name", "is_numeric", "is_string", "is_temporal", "is_integer")},
        **{c: F.sum(c) for c in ("row_count", "present", "numbers", *_COUNTED, "word_nulls", "chars", "chars_squared", "texts", "loads")},
        **{c: F.min(c) for c in ("min_value", "min_length")}, **{c: F.max(c) for c in ("max_value", "max_length", *K.CONTENT_PATTERNS)},
        "mean": F.first("together"), "m2": F.sum(m2 + n * d * d), "m3": F.sum(m3 + 3 * d * m2 + n * d * d * d), "m4": F.sum(F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d),
        **{c: weighted(F.col(c)) for c in _SHARES}, "hits": F.bit_or("hits"), "hll": F.hll_union_agg("hll"), "kll": F.kll_merge_agg_double("kll"), "counted": F.bool_and("counted"),
        "domain_pattern_matches": F.create_map(*[e for name in K.DOMAIN_PATTERNS for e in (F.lit(name), weighted(F.coalesce(F.col("domain_pattern_matches")[name], F.lit(0.0))))])}
    merged = columns.groupBy(*KEYS).agg(*[c.alias(name) for name, c in made.items()])
    merged = merged.withColumn("counted", F.col("counted") & (F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0)) <= EXACT_VALUES))
    summed = values.groupBy(*KEYS, "whole", "real", "word", "digest").agg(F.sum("n").alias("n"))
    kept = checkpoint(merged)
    return State(kept, checkpoint(summed.join(F.broadcast(kept.where("counted").select(*KEYS)), KEYS, "left_semi")))


def profile(found: State) -> DataFrame:
    """The profile table of a state, with the columns of an exact profile."""
    c = found.columns
    n, m2 = F.col("numbers"), F.col("m2")
    spread = F.when(m2 > 0, m2)
    texts, mean_length = F.nullif("texts", F.lit(0)), F.col("chars") / F.nullif("texts", F.lit(0))
    # A sketch of nothing has no quantiles.
    filled = F.when(n > 0, F.col("kll"))
    grid = F.kll_sketch_get_quantile_double(filled, F.array(*[F.lit((2 * i + 1) / (2 * GRID)) for i in range(GRID)]))
    low, middle, high = (F.kll_sketch_get_quantile_double(filled, F.lit(q)) for q in (0.25, 0.5, 0.75))

    def outside(width: float) -> Column:
        """Rows beyond the fences by the sketch's quantiles; none where a fence lies beyond the least or greatest value."""
        gap = width * (F.col("q75") - F.col("q25"))
        under = F.when(F.col("min_value") < F.col("q25") - gap, F.size(F.filter("grid", lambda q: q < F.col("q25") - gap))).otherwise(0)
        over = F.when(F.col("max_value") > F.col("q75") + gap, F.size(F.filter("grid", lambda q: q > F.col("q75") + gap))).otherwise(0)
        return F.when(n > 0, F.round((under + over) / GRID * n).cast("bigint"))

    exact = found.values.groupBy(*KEYS).agg(*P.value_aggregates())
    made = c.withColumns({"grid": grid, "q25": low, "median": middle, "q75": high}).join(F.broadcast(exact), KEYS, "left")
    counted = F.col("counted") & F.col("unique_count").isNotNull()
    estimate = F.least(F.round(F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0))).cast("bigint"), F.col("present"))
    bits = sum((F.col("hits").bitwiseAND(1 << i).cast("boolean").cast("int") for i in range(len(K.COMPLEXITY_PATTERNS))), F.lit(0))
    fields = {
        "n": F.when(F.col("is_numeric"), n), "std": F.when(n > 1, F.sqrt(m2 / (n - 1))), "skew_pop": F.sqrt(n.cast("double")) * F.col("m3") / F.pow(spread, 1.5),
        "kurt_pop": n * F.col("m4") / (spread * spread) - 3, "avg_length": mean_length,
        "length_std": F.when(F.col("texts") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("chars_squared") - F.col("chars") * mean_length) / (F.col("texts") - 1))),
        "encoded_nulls": F.when(texts.isNotNull(), F.col("word_nulls")).when(F.col("is_numeric"), F.col("encoded_nulls")), "complexity_hits": F.when(texts.isNotNull(), bits),
        "unique_count": F.when(counted, F.col("unique_count")).otherwise(estimate),
        **{k: F.when(F.col("present") == 0, zero).when(counted, F.col(k)) for k, zero in (("top_count", 0), ("sum_n_log", 0.0), ("all_ordinal", False))}, "outlier_count": outside(1.5), "far_outlier_count": outside(3.0),
        **{k: F.when(F.col("is_numeric"), F.col(k)) for k in _COUNTED if k != "encoded_nulls"},
        **{k: F.when(texts.isNotNull(), F.col(k)) for k in [*_SHARES, *K.CONTENT_PATTERNS, "domain_pattern_matches"]},
    }
    have = {*made.columns, *fields}
    types = dict(part.split(" ", 1) for part in P.RAW_SCHEMA.split(", "))
    raw = made.select(*[(fields.get(name, F.col(name)) if name in have else F.lit(None)).cast(t).alias(name) for name, t in types.items()], "counted", "loads")
    return P.derive(raw)
