"""Rules, recommendations, learning, privacy, evaluation and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsmith.operators.profile import WITH_SEMANTICS, profile
from colsmith.plans import evaluate as E
from colsmith.plans import learning as L
from colsmith.plans import privacy as K
from colsmith.plans import recommend as R
from colsmith.plans.rules import Rule, catalogue
from colsmith.session import scratch_path
from colsmith.streaming import windows as W


def actions(df):
    return {r["column_name"]: r["action"] for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(11)
    n = 500
    rows = list(zip(range(n), rng.normal(50, 5, n).tolist(), np.round(np.exp(rng.normal(3, 1.3, n))).tolist(), [42] * n,
                    rng.choice(["Yes", "No"], n).tolist(), rng.choice(["a", "b", "c", "d"], n).tolist(), [float(v % 2) for v in range(n)]))
    df = spark.createDataFrame(rows, "id long, normal double, skewed double, constant int, answer string, category string, target double")
    return profile({"t": df}, WITH_SEMANTICS).persist()


def test_catalogue_size_and_order():
    rules = catalogue()
    assert len(rules) == 216 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    assert len(catalogue(with_optional=True)) == 220


def test_rule_decisions(mixed):
    found = actions(R.rule_decisions(mixed, target="target"))
    assert found["constant"] == found["id"] == "drop_column" and found["answer"] == "label_encode"
    assert found["target"] == "keep_as_is" and found["skewed"] in ("log_transform", "binning_equal_freq")


def test_user_rules_take_part(mixed):
    rule = Rule("MINE", "winsorize", 500, "1.0", "name = 'normal'")
    assert actions(R.rule_decisions(mixed, rules=[*catalogue(), rule]))["normal"] == "winsorize"


def test_calibration(spark):
    df = spark.createDataFrame([(0.98, "drop_column"), (0.9, "keep_as_is"), (0.96, "x"), (0.5, "x")], "c double, a string")
    got = [r[0] for r in df.select(R.calibrate(F.col("c"), F.col("a"))).collect()]
    assert got == pytest.approx([0.92 * 0.95, 0.81 * 0.75, 0.92, 0.45])


def test_model_and_rules_blend(mixed):
    predictions = mixed.select("table_name", "column_name", F.lit("standard_scale").alias("model_action"), F.lit(0.99).alias("model_confidence"))
    found = {r["column_name"]: r for r in R.recommend(mixed, predictions=predictions, threshold=0.99).collect()}
    assert found["normal"]["source"] == "neural" and found["normal"]["action"] == "standard_scale"


def test_validation_blocks_and_suggests(mixed):
    proposals = mixed.select("table_name", "column_name", F.lit("binning_equal_width").alias("action"))
    found = {r["column_name"]: r for r in R.validate_actions(mixed, proposals).collect()}
    assert not found["target"]["is_valid"] and found["target"]["recommended_action"] == "keep_as_is" and found["normal"]["is_valid"]


def test_whole_word_names():
    words = {r.name: r.condition for r in catalogue(whole_words=True)}
    assert "concat('_', name, '_')" in words["DETECT_IP_ADDRESS"]


def test_similarity_of_a_column_with_itself(mixed):
    corrections = mixed.select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("correction_id"), "table_name", "column_name").where("column_name = 'normal'").withColumns({
        "correct_action": F.lit("robust_scale"), "system_confidence": F.lit(0.5)})
    rules = L.learned_rules(L.record_corrections(corrections, mixed))
    near = {r["column_name"]: r["similarity"] for r in L.rule_similarities(mixed, rules).collect()}
    # Entropy has a weight but no comparison, so a perfect match is 0.95 of the total.
    assert near["normal"] == pytest.approx(0.95) and near["category"] < 0.7
    assert actions(L.learned_decisions(L.rule_similarities(mixed, rules)))["normal"] == "robust_scale"


def _random_rules_and_columns(spark, rng, n_rules=60, n_columns=80):
    pick = lambda *c: c[rng.integers(len(c))]
    numbers = lambda: [pick(None, 0.0, 0.15, 0.3, 1.0, float(rng.random())), pick(None, 0.0, 1.0, float(rng.random())), pick(None, 0.0, 2.0), pick(None, 0.0, -3.0),
                       pick(None, 0.0, 0.1), pick(None, 1.5)]
    flags = lambda: [pick(True, False, None), pick(True, False), pick(False, None), pick(False, True)]
    rows = []
    for i in range(n_rules):
        rows.append((f"r{i}", "a", 0.9, 20, (*numbers(), pick(None, 1.0, 10.0, 100.0), *flags())))
    template = "struct<null_pct:double,unique_ratio:double,skewness:double,kurtosis:double,outlier_pct:double,entropy:double,cardinality:double,is_numeric:boolean,is_categorical:boolean,is_temporal:boolean,is_boolean:boolean>"
    rules = spark.createDataFrame(rows, f"rule_name string, recommended_action string, base_confidence double, support_count bigint, template {template}")
    columns = []
    for i in range(n_columns):
        # Half of the columns are close to some rule, so that pairs near the threshold occur.
        t = list(rows[i % n_rules][4]) if i % 2 else [*numbers(), pick(None, 10.0), *flags()]
        if i % 4 == 1 and t[0] is not None:
            t[0] = max(0.0, t[0] + float(rng.normal(0, 0.05)))
        columns.append(("t", f"c{i}", *t[:6], None if t[6] is None else int(t[6]), *t[7:10], "boolean" if t[10] else "double"))
    profile = spark.createDataFrame(columns, "table_name string, column_name string, null_pct double, unique_ratio double, skewness double, kurtosis double, outlier_pct double, "
                                             "entropy double, unique_count bigint, is_numeric boolean, is_categorical boolean, is_temporal boolean, type_name string")
    return profile, rules


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.9, 0.97])
def test_like_rules_by_keys_are_those_of_all_pairs(spark, threshold):
    profile, rules = _random_rules_and_columns(spark, np.random.default_rng(int(threshold * 100)))
    want = {(r["column_name"], r["rule_name"], round(r["similarity"], 9)) for r in L.rule_similarities(profile, rules).where(F.col("similarity") >= threshold).collect()}
    found = L.similar_rules(profile, rules, threshold)
    got = [(r["column_name"], r["rule_name"], round(r["similarity"], 9)) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and (want or threshold > 0.9)


def test_rules_in_blocks(spark, monkeypatch):
    profile, rules = _random_rules_and_columns(spark, np.random.default_rng(5), 30, 20)
    whole = {tuple(r) for r in L.rule_similarities(profile, rules).collect()}
    monkeypatch.setattr(L, "BROADCAST_ROWS", 7)
    again = [tuple(r) for r in L.rule_similarities(profile, rules).collect()]
    assert len(again) == 600 and set(again) == whole


def test_ab_outcomes(spark):
    log = spark.createDataFrame([("good", i % 10 != 0) for i in range(120)] + [("bad", i % 2 == 0) for i in range(120)] + [("new", True)] * 5, "rule_name string, correct boolean")
    valid = spark.createDataFrame([("good", True), ("bad", True), ("new", True)], "rule_name string, validated boolean")
    assert {r["rule_name"]: r["outcome"] for r in L.ab_outcomes(log, valid).collect()} == {"good": "promote", "bad": "reject", "new": "continue"}


def test_noise_has_the_right_spread(spark):
    df = spark.range(20000).select(K.laplace(0.5, 1.0, 3, F.col("id")).alias("l"), K.gaussian(1.0, 1e-5, 1.0, 3, F.col("id")).alias("g"))
    row = df.agg(F.avg("l"), F.stddev_pop("l"), F.avg("g"), F.stddev_pop("g")).first()
    assert abs(row[0]) < 0.1 and row[1] == pytest.approx(2 * 2 ** 0.5, rel=0.05)
    assert abs(row[2]) < 0.15 and row[3] == pytest.approx((2 * np.log(1.25e5)) ** 0.5, rel=0.05)


def test_seeded_noise_belongs_to_its_key(spark):
    noisy = lambda df, seed=3: {r["k"]: r["l"] for r in df.select("k", K.laplace(1.0, 1.0, seed, F.col("k")).alias("l")).collect()}
    df = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("null",)], "k string")
    first = noisy(df)
    assert first == noisy(df.repartition(5)) and len(set(first.values())) == 5
    assert first != noisy(df, 4)
    with pytest.raises(ValueError):
        K.laplace(1.0, 1.0, 3)
    one = spark.range(50).select(F.lit("x").alias("c"))
    assert K.private_histogram(one, "c", 1.0, 5).collect() == K.private_histogram(one.repartition(7), "c", 1.0, 5).collect()


def test_exhausted_budget_gives_null(spark):
    rows = spark.createDataFrame([(i, 10.0) for i in range(5)], "i int, value double")
    found = [r["private_value"] for r in K.budgeted(rows, "i", 0.3, 0.1).orderBy("i").collect()]
    assert all(v is not None for v in found[:3]) and found[3:] == [None, None]


def test_k_anonymity(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",), (None,)], "v string")
    got = sorted(str(r["v"]) for r in K.k_anonymous(df, "v", 5, 2).collect())
    assert got == sorted(["a"] * 6 + ["OTHER"] * 3 + ["*", "None"])


def test_class_metrics(spark):
    rows = spark.createDataFrame([("x", "x")] * 3 + [("x", "y"), ("y", "y"), ("z", "x")], "truth string, predicted string")
    found = {r["label"]: r for r in E.class_metrics(E.confusion(rows)).collect()}
    assert found["x"]["precision"] == found["x"]["recall"] == 0.75 and found["z"]["f1"] == 0


def test_append_mode_drops_late_rows(spark):
    schema = "ts timestamp, source string, confidence double"
    path, sink, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    stamp = lambda rows: spark.createDataFrame(rows, "ts string, source string, confidence double").withColumn("ts", F.to_timestamp("ts"))

    def push(rows):
        stamp(rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        W.run_available(W.windowed_metrics(stream, "ts", "source", "10 minutes", late="10 minutes"), sink, state)

    push([("2024-01-01 00:01:00", "a", 0.5), ("2024-01-01 00:05:00", "a", 1.0)])
    push([("2024-01-01 02:00:00", "a", 1.0)])
    push([("2024-01-01 00:02:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 1.0)])
    found = {str(r["window_start"]): r["decisions"] for r in spark.read.parquet(sink).collect()}
    assert found["2024-01-01 00:00:00"] == 2


def test_corrections_belong_to_their_table(spark):
    """Two tables with a column of one name: a correction counts for its own table only."""
    from colsmith.operators.profile import profile

    df = spark.createDataFrame([(float(i),) for i in range(30)], "x double")
    found = profile({"a": df, "b": df})
    one = spark.createDataFrame([(1, "a", "x", "keep_as_is", "drop_column", 0.5)], "correction_id int, table_name string, column_name string, wrong_action string, correct_action string, system_confidence double")
    assert [r["table_name"] for r in L.record_corrections(one, found).collect()] == ["a"]


def test_scale_free_rules_spare_bounded_columns(spark):
    """A column of a few balanced values stays, however long the table is."""
    from colsmith.operators.profile import profile

    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("l_quantity"))
    found = profile({"t": df})
    plain = R.rule_decisions(found).first()["action"]
    free = R.rule_decisions(found, rules=catalogue(scale_free=True)).first()["action"]
    assert plain == "drop_column" and free != "drop_column"


def test_last_bits_do_not_decide_between_equal_candidates(spark):
    ruled = spark.createDataFrame([("t", "a", "keep_as_is", 0.6, "R", ["x"]), ("t", "b", "keep_as_is", 0.9, "R", ["x"])],
                                  "table_name string, column_name string, action string, confidence double, rule string, alternatives array<string>")
    learned = spark.createDataFrame([("t", c, action, confidence, f"L_{action}") for c in "ab" for action, confidence in
                                     (("log_transform", 0.9), ("label_encode", 0.9000000000000001), ("drop_column", 0.8))],
                                    "table_name string, column_name string, action string, confidence double, rule string")
    found = {r["column_name"]: (r["action"], r["rule"], r["source"]) for r in L.merge_candidates(ruled, learned).collect()}
    assert found == {"a": ("log_transform", "L_log_transform", "learned"), "b": ("keep_as_is", "R", "symbolic")}
