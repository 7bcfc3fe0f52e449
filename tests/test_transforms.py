"""Column transforms and their checked variants on small literal frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsmith.functions import scalar as S
from colsmith.operators import encode, safe, text
from colsmith.plans.actions import ALL_ACTIONS
from colsmith.plans.apply import fit


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def applied(df, action, **parameters):
    done = fit(df, {"x": (action, parameters)}, order_by=["i"]).transform(df)
    return [r["x"] for r in done.orderBy("i").collect()]


def test_there_are_58_actions():
    assert len(ALL_ACTIONS) == len(set(ALL_ACTIONS)) == 58


def test_every_action_fits_and_transforms(spark):
    rows = [(i, float(i % 7 + 1), "abc"[i % 3], f"2024-01-{i % 28 + 1:02d} 10:00:00", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, num double, cat string, day string, target double")
    for action in ALL_ACTIONS:
        column = "day" if "datetime" in action or "cyclic" in action else "cat" if "encode" in action or "text" in action or "parse" in action else "num"
        done = fit(df, {column: action}, target="target", order_by=["i"]).transform(df)
        assert done.count() > 0, action


def test_scaling_keeps_nulls_and_constant_columns(spark):
    assert applied(frame(spark, [1.0, None, 3.0]), "standard_scale") == [-1.0, None, 1.0]
    assert applied(frame(spark, [5.0] * 3), "minmax_scale") == [0.0] * 3
    assert applied(frame(spark, [5.0] * 3), "robust_scale") == [0.0] * 3
    assert applied(frame(spark, [3.0, -4.0]), "normalize_l2") == [0.6, -0.8]


def test_logs_and_roots(spark):
    assert applied(frame(spark, [1.0, math.e]), "log_transform") == pytest.approx([0, 1])
    assert applied(frame(spark, [-1.0, 0.0, 1.0]), "log_transform") == pytest.approx([0, 0, math.log(2)])
    assert applied(frame(spark, [-4.0, 9.0]), "sqrt_transform") == [2.0, 3.0]


def _likelihood(x, lam):
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def test_box_cox_exponent_is_the_best_one(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(2, 0.7, 400)) + 3
    step = fit(frame(spark, x.tolist()), {"x": "box_cox"}).steps[0]
    lam = step.statistics["lambda"]
    assert all(_likelihood(x, lam) >= _likelihood(x, lam + d) - 1e-7 for d in (-0.01, -0.001, 0.001, 0.01))


def test_yeo_johnson_is_standardised_and_monotone(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(2, 2, 300) - 1
    y = np.array(applied(frame(spark, x.tolist()), "yeo_johnson"))
    assert y.mean() == pytest.approx(0, abs=1e-9) and y.std() == pytest.approx(1)
    assert np.array_equal(np.argsort(x), np.argsort(y))


def test_quantile_transform_bounds_order_and_ties(spark):
    y = applied(frame(spark, [1.0, 2.0, 2.0, 2.0, 3.0, None, 10.0, 4.0]), "quantile_transform")
    assert y[0] == 0 and y[6] == 1 and y[5] is None and y[1] == y[2] == y[3]
    rest = [y[0], y[1], y[4], y[7], y[6]]
    assert rest == sorted(rest)


def test_bins(spark):
    assert applied(frame(spark, [0.0, 20.0, 20.1, 100.0]), "binning_equal_width") == [0, 0, 1, 4]
    assert applied(frame(spark, [-1.0, 0.0, 25.0, 26.0, 100.0, 101.0]), "binning_custom") == [None, 0, 0, 1, 3, None]
    assert applied(frame(spark, [1.0, 1.0, 1.0, 2.0, 3.0]), "binning_equal_freq", n_bins=4) == [0, 0, 0, 0, 1]


def test_parsers(spark):
    assert applied(frame(spark, ["$1,234.50", "45%", "x", "7"], "string"), "parse_numeric") == [1234.5, 45.0, None, 7.0]
    assert applied(frame(spark, ["a", "b", "1"], "string"), "parse_numeric") == ["a", "b", "1"]
    assert applied(frame(spark, [" YES ", "off", "?", None], "string"), "parse_boolean") == [1.0, 0.0, None, None]
    assert applied(frame(spark, ["{\"a\": 1}", "\"s\"", "{bad"], "string"), "parse_json") == ["{\"a\":1}", "s", "{bad"]
    assert applied(frame(spark, ["A@b.co", "no"], "string"), "email_validate") == ["a@b.co", None]
    assert applied(frame(spark, ["https://u@h.org:80/p?q", "plain"], "string"), "url_parse") == ["u@h.org:80", "plain"]


def test_encoders(spark):
    df = frame(spark, ["b", None, "a", "b"], "string")
    assert applied(df, "label_encode") == [1, None, 0, 1]
    assert applied(df, "ordinal_encode", order=["b"]) == [0, -1, -1, 0]
    assert applied(df, "frequency_encode") == pytest.approx([2 / 3, 0, 1 / 3, 2 / 3])
    assert fit(df, {"x": "onehot_encode"}).transform(df).columns == ["i", "x_a", "x_b"]


def test_out_of_fold_means_leave_the_own_row_out(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(40)], "i int, c string, t double")
    done = encode.target_encode_folds(df, "c", "t", F.col("i"), 4, "m").collect()
    fold = {r["i"]: r["f"] for r in df.select("i", S.stable_bucket(F.col("i"), 4).alias("f")).collect()}
    for r in done:
        others = [s["t"] for s in done if s["c"] == r["c"] and fold[s["i"]] != fold[r["i"]]]
        assert r["m"] == pytest.approx(sum(others) / len(others))


def test_refused_actions_fall_back(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(60)], "i int, x string")
    step = fit(df, {"x": "onehot_encode"}).steps[0]
    assert (step.action, step.status) == ("label_encode", "fallback")
    step = fit(df, {"x": "fill_null_forward"}).steps[0]
    assert step.status == "skipped"
    assert fit(df, {"y": "drop_column"}).refused[0].note == "no such column"


def test_tfidf_both_ways_agree(spark):
    df = spark.createDataFrame([(0, "red fish blue fish"), (1, "one fish two fish"), (2, None), (3, "green eggs")], "k int, t string")
    vocabulary = text.fit_vocabulary(df, "t", 4)
    assert vocabulary.terms == ["blue", "eggs", "fish", "green"]
    wide = {r["k"]: r["v"] for r in text.with_tfidf(df, "t", vocabulary, "v").collect()}
    long = {(r["k"], r["term"]): r["weight"] for r in text.tfidf_weights(df, "k", "t", vocabulary).collect()}
    for k, vector in wide.items():
        for term, weight in zip(vocabulary.terms, vector):
            assert weight == pytest.approx(long.get((k, term), 0.0))


@pytest.mark.parametrize("values, status", [([None, None, None], "skipped"), ([5.0] * 5, "skipped"), ([1.0, 2.0, None, 4.0, 5.0], "success")])
def test_safe_standard_scale(spark, values, status):
    assert safe.standard_scale(frame(spark, values), "x")[1].status == status


def test_safe_log_shifts_negatives(spark):
    done, outcome = safe.log_transform(frame(spark, [-10.0, -5.0, 0.0, 5.0, 10.0]), "x")
    assert outcome.actual == "log1p_transform"
    assert [r["x"] for r in done.orderBy("i").collect()][0] == pytest.approx(math.log(2))


def test_safe_tfidf_refuses_urls_and_ids(spark):
    urls = frame(spark, [f"https://a.b/{i}" for i in range(5)], "string")
    assert safe.tfidf(urls, "x")[1].actual == "drop_column"
    ids = frame(spark, [f"user-{i:012d}" for i in range(5)], "string")
    assert safe.tfidf(ids, "x")[1].explanation == "values look like codes, not prose"


def test_terms_with_combining_marks_are_found_in_transform(spark):
    df = spark.createDataFrame([("हिन्दी पाठ हिन्दी",), ("पाठ और",)], "t string")
    done = [r["t"] for r in fit(df, {"t": "text_vectorize_tfidf"}).transform(df).collect()]
    assert all(v > 0.3 for v in done)


def test_duplicates_are_whole_rows_unless_a_subset_is_ordered(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "i int, x string")
    assert fit(df, {"x": "remove_duplicates"}).transform(df).count() == 3
    first = fit(df, {"x": ("remove_duplicates", {"subset": ["x"], "order_by": ["i"]})}).transform(df)
    assert sorted(tuple(r) for r in first.collect()) == [(1, "a"), (3, "b")]
    with pytest.raises(ValueError):
        fit(df, {"x": ("remove_duplicates", {"subset": ["x"]})}).transform(df)


def test_decisions_that_are_not_accepted_and_checked_report(spark):
    df = spark.createDataFrame([(float(i % 17) ** 3, float(i), "ab"[i % 2]) for i in range(200)], "x double, y double, c string")
    fitted = fit(df, {"x": "log1p_transform", "y": "standard_scale", "c": "label_encode"}, accepted={"y": False})
    done = fitted.transform(df)
    report = {r["column"]: r for r in fitted.checked(df, done).collect()}
    assert report["y"]["status"] == "skipped" and report["y"]["note"] == "not accepted" and not report["y"]["validated"]
    assert report["x"]["validated"] and report["x"]["in_range"] and report["x"]["passed"] is not None
    assert done.select("y").exceptAll(df.select("y")).count() == 0


def test_target_encoding_out_of_fold(spark):
    df = spark.createDataFrame([(i, f"k{i}", float(i)) for i in range(50)], "i int, k string, target double")
    done = fit(df, {"k": ("target_encode", {"folds": 5, "key": "i"})}, target="target").transform(df)
    assert done.select("k").distinct().count() == 1  # a category that occurs once never sees its own target


@pytest.mark.parametrize("limit", [100, 2])
def test_target_means_of_many_columns_share_a_job(spark, limit):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), ("b", "x", None), ("c", "y", 5.0), (None, "y", 7.0)], "a string, b string, t double")
    counted = encode.Counted(df, ["a", "b"], limit, "t")
    for c in ("a", "b"):
        found, alone = counted.means(c), encode.target_dictionary(df, c, "t", limit)
        assert sorted(found.table.collect()) == sorted(alone.table.collect()) and (found.size, found.small) == (alone.size, alone.small)
    fitted = fit(df, {"a": "target_encode", "b": "target_encode"}, target="t")
    assert [tuple(r) for r in fitted.transform(df).orderBy("t").select("a", "b").collect()][1:] == [(2.0, 1.0), (2.0, 4.0), (5.0, 6.0), (4.0, 6.0)]
