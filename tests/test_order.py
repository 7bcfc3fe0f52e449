"""Quantiles and order-dependent operators, on one segment and on many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsmith.operators import encode, nulls
from colsmith.operators.ordering import ranked_dictionary, with_lags, with_position
from colsmith.operators.quantiles import exact_quantiles
from colsmith.operators.validate import anderson_darling, anderson_darlings


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows hold one value, and another third belong to one key."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 6)) if i % 3 else 0, 7.0 if i % 3 == 1 else float(np.round(rng.normal(50, 20), 3)), None if i % 4 == 0 else float(i % 11))
            for i in range(3000)]
    return spark.createDataFrame(rows, "i int, key int, x double, gap double").persist()


def test_quantiles_narrowed_to_the_exact_ranks(skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    values = np.array([r["x"] for r in skewed.collect()])
    for limit in (10_000, 100):
        found = exact_quantiles(skewed, {"x": probs}, direct_rows=limit)["x"]
        assert found == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_many_quantiles_of_a_long_column(skewed):
    probs = [i / 40 for i in range(41)]
    values = np.array([r["x"] for r in skewed.collect()])
    found = exact_quantiles(skewed, {"x": probs}, direct_rows=200)["x"]
    assert found == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]})["x"] == [None]


def _column(df, name):
    return [r[name] for r in df.orderBy("i").select(name).collect()]


@pytest.mark.parametrize("fill", [nulls.fill_forward, nulls.fill_backward, nulls.interpolate])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_fills_do_not_depend_on_segments(skewed, fill, keys):
    one = _column(fill(skewed, "gap", ["i"], keys), "gap")
    many = _column(fill(skewed, "gap", ["i"], keys, segment_rows=250), "gap")
    assert [None if v is None else round(v, 9) for v in one] == [None if v is None else round(v, 9) for v in many]


def test_interpolation_by_position(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, None), (4, 8.0), (5, None)], "i int, v double")
    assert _column(nulls.interpolate(df, "v", ["i"]), "v") == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_positions_and_lags_over_segments(skewed):
    placed = with_position(skewed, ["i"], ["key"], "n", segment_rows=300)
    count = {r["key"]: r["n"] for r in placed.groupBy("key").agg(F.max("n").alias("n"), F.countDistinct("n").alias("d")).collect()}
    assert count == {r["key"]: r["count"] for r in skewed.groupBy("key").count().collect()}
    lagged = with_lags(skewed, "x", [1, 12], ["i"], [], chunk_rows=200, segment_rows=300)
    xs = _column(skewed, "x")
    assert _column(lagged, "lag_12") == [None] * 12 + xs[:-12]
    assert _column(lagged, "lag_1") == [None] + xs[:-1]


def test_large_dictionaries_get_the_same_codes(spark, skewed):
    values = spark.createDataFrame([(f"v{i:04d}",) for i in range(300)], "value string")
    small = {r["value"]: r["c"] for r in ranked_dictionary(values, "value", "c", 1000, 300).collect()}
    large = {r["value"]: r["c"] for r in ranked_dictionary(values, "value", "c", 10, 300).collect()}
    assert small == large == {f"v{i:04d}": i for i in range(300)}
    df = skewed.select("i", F.concat(F.lit("k"), F.col("i") % 40).alias("c"))
    joined = encode.label_encode(df, "c", encode.count_dictionary(df, "c", limit=5))
    direct = encode.label_encode(df, "c")
    assert _column(joined, "c") == _column(direct, "c")


def test_normality_statistic_against_ranks(skewed):
    import math

    x = np.sort([r["x"] for r in skewed.collect()])
    n, z = len(x), (x - x.mean()) / x.std(ddof=1)
    log_cdf = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z])
    log_sf = np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])
    i = np.arange(1, n + 1)
    expected = -n - np.sum((2 * i - 1) * (log_cdf + log_sf[::-1])) / n
    assert anderson_darling(skewed, "x") == pytest.approx(expected, rel=1e-9)
    assert anderson_darling(skewed, "x", segment_rows=300) == pytest.approx(expected, rel=1e-9)


def test_segments_split_a_key_that_half_of_the_rows_hold(spark):
    from colsmith.operators.ordering import SEGMENT, with_segments

    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("k"), F.lit("same").alias("t"))
    for order in (["k"], ["t"]):
        cut, single = with_segments(df, order, 1000)
        assert not single and max(r["count"] for r in cut.groupBy(SEGMENT).count().collect()) <= 2000
    placed = with_position(df, ["k"], [], "n", segment_rows=1000)
    assert placed.select("n").distinct().count() == 20_000


def test_normal_tail_far_out(spark):
    import math

    from colsmith.operators.validate import log_normal_tail

    points = [-40.0, -30.0, -12.0, -6.0, -3.0, -1.0, -0.3, 0.0, 0.3, 1.0, 3.0, 6.0]
    found = [r["v"] for r in spark.createDataFrame([(z,) for z in points], "z double").select(log_normal_tail(F.col("z")).alias("v"), "z").orderBy("z").collect()]
    for z, v in zip(points, found):
        exact = math.log(0.5 * math.erfc(-z / math.sqrt(2))) if z > -37 else -z * z / 2 - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / z**2 + 3 / z**4)
        assert v == pytest.approx(exact, rel=1e-9)


def test_normality_of_many_columns_in_shared_jobs(spark):
    rng = np.random.default_rng(4)
    data = np.round(rng.gamma(2, 2, (400, 50)) ** rng.uniform(0.5, 2, 50), 2)
    df = spark.createDataFrame([(*map(float, row), None, 1.0) for row in data], ", ".join(f"c{i} double" for i in range(50)) + ", nothing double, constant double")
    spark.sparkContext.setJobGroup("normality", "normality")
    found = anderson_darlings({c: (df, c) for c in df.columns}, segment_rows=3_000)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("normality"))
    spark.sparkContext.setJobGroup("other", "other")
    assert found["nothing"] is None and found["constant"] is None and jobs < 25
    for i in (0, 17, 49):
        assert found[f"c{i}"] == pytest.approx(anderson_darling(df, f"c{i}"), rel=1e-9)
