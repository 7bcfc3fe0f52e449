"""Merged profile states against exact profiles of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsmith.operators import states
from colsmith.operators.profile import profile

EXACT = ("row_count", "present", "null_pct", "min_value", "max_value", "zeros", "positives", "negatives", "decimals", "encoded_nulls", "min_length", "max_length", "complexity_hits", "is_numeric",
         "position", "type_name", "has_delimiters", "has_special_chars")
CLOSE = ("mean", "std", "skewness", "kurtosis", "avg_length", "length_std", "matches_json", "matches_numeric_pattern", "matches_email_pattern", "encoded_null_ratio", "pattern_complexity")
COUNTED = ("unique_count", "top_count", "entropy", "mode_frequency", "is_ordinal")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 60_000
    skewed = rng.lognormal(1, 1, n)
    values = [(i, float(skewed[i]) if i % 9 else None, 1e9 + float(i % 1000), "low" if i % 3 else "high", f"user{i}@mail{i % 7}.org", ["unknown", "{}", "12", "a,b"][i % 4], i % 40000 // 4, None, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(values, "id long, amount double, shifted double, risk string, mail string, mixed string, half int, nothing string, flag boolean").repartition(4).persist()


def found(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def merged(rows):
    parts = [rows.where(F.col("id") % 5 == i) for i in (0, 1)] + [rows.where(F.col("id") % 5 > 1), rows.limit(0)]
    return states.merge([states.state({"t": p}) for p in parts])


def same(a, b):
    return a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-6, abs=1e-9))


def compare(merged, exact, n):
    for name, e in exact.items():
        m = merged[name]
        assert [m[c] for c in EXACT] == [e[c] for c in EXACT], name
        assert [c for c in CLOSE if not same(m[c], e[c])] == [], name
        if m["counted"]:
            assert [c for c in COUNTED if not same(m[c], e[c])] == [], name
        else:
            assert m["top_count"] is None and m["unique_count"] == pytest.approx(e["unique_count"], rel=states.DISTINCT_ERROR), name


def test_merged_loads_profile_like_all_rows(rows, merged):
    exact, of = found(profile({"t": rows})), found(states.profile(merged))
    assert {c for c, r in of.items() if not r["counted"]} == {"id", "amount", "mail", "half"} and {r["loads"] for r in of.values()} == {4}
    compare(of, exact, rows.count())
    for name in ("id", "amount", "half"):
        x = np.sort([r[0] for r in rows.select(name).where(F.col(name).isNotNull()).collect()])
        for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            low, high = np.searchsorted(x, of[name][q], "left") / len(x), np.searchsorted(x, of[name][q], "right") / len(x)
            assert low - states.RANK_ERROR <= p <= high + states.RANK_ERROR
        for c in ("outlier_count", "far_outlier_count"):
            assert abs(of[name][c] - exact[name][c]) <= 3 * states.RANK_ERROR * len(x)


def test_one_state_and_merging_in_any_order(rows, merged):
    parts = [states.state({"t": rows.where(F.col("id") % 3 == i)}) for i in range(3)]
    compare(found(states.profile(states.state({"t": rows}))), found(profile({"t": rows})), rows.count())
    left = states.merge([states.merge(parts[:2]), parts[2]])
    right = states.merge([parts[2], states.merge([parts[1], parts[0]])])
    a, b = found(states.profile(left)), found(states.profile(right))
    for name in a:
        assert [a[name][c] for c in ("row_count", "unique_count", "top_count", "min_value")] == [b[name][c] for c in ("row_count", "unique_count", "top_count", "min_value")]
        assert all(same(a[name][c], b[name][c]) for c in ("mean", "std", "skewness", "kurtosis"))


def test_values_that_outgrow_the_bound(spark):
    parts = [states.state({"t": spark.range(i * 800, (i + 1) * 800).toDF("v")}) for i in range(2)]
    one = states.profile(states.merge(parts)).first()
    assert not one["counted"] and one["unique_count"] == pytest.approx(1600, rel=states.DISTINCT_ERROR) and one["top_count"] is None


def test_saved_states_and_new_columns(spark, tmp_path):
    states.state({"t": spark.createDataFrame([(1, "a")], "n int, s string")}).save(str(tmp_path / "a"))
    later = states.state({"t": spark.createDataFrame([(2, 0.5)], "n int, x double")})
    of = found(states.profile(states.merge([states.State.load(spark, str(tmp_path / "a")), later])))
    assert set(of) == {"n", "s", "x"} and of["n"]["row_count"] == 2 and of["n"]["mean"] == 1.5 and of["s"]["row_count"] == of["x"]["row_count"] == 1


def test_jobs_do_not_grow_with_columns(spark):
    wide = spark.range(100).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(60)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("states", "states")
    one = states.state({"t": wide})
    jobs = len(tracker.getJobIdsForGroup("states"))
    spark.sparkContext.setJobGroup("other", "other")
    assert one.columns.count() == 60 and jobs <= 12
