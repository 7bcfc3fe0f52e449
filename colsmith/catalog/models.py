"""Queries for action models, trained on labelled documents or on profile rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.recommend import _DECIDED, NAMES, _profile
from colsmith.catalog.registry import query, r
from colsmith.catalog.shared import profile_sql
from colsmith.operators.features import meta_features
from colsmith.operators.profile import WITH_SEMANTICS
from colsmith.plans import models as M
from colsmith.plans.recommend import recommend

COLUMN_FEATURES = ["missing_ratio", "unique_ratio", "is_numeric", "skewness", "kurtosis", "outlier_ratio", "avg_length", "entropy"]
FEATURES = ["n_chars", "words", "mean_word", "digits", "blanks", "lines"]


def _rows(load):
    """Documents with simple numeric features and an action label from the quality flag."""
    text = F.col("text")
    words = F.size(F.split(F.trim(text), r"\s+"))
    docs = load("documents").select(
        "doc_id", "n_chars", words.alias("words"), (F.length(text) / words).alias("mean_word"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).alias("digits"), F.length(F.regexp_replace(text, "[^ ]", "")).alias("blanks"),
        F.size(F.split(text, "\n")).alias("lines"))
    label = F.when(F.col("quality") == 1, "keep_as_is").when(F.col("toxic") == 1, "drop_column").otherwise("text_clean")
    return load("labels").join(docs, "doc_id").withColumn("label", label).withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)


def _trained(load):
    rows = _rows(load)
    return M.train(rows.where(~F.col("test")), FEATURES), rows


@query("m1_train_classifier")
def _(load):
    model, rows = _trained(load)
    return model.score(rows.where("test")).groupBy("label", "model_action").count()


@query("m2_soft_voting")
def _(load):
    model, rows = _trained(load)
    return model.score(rows.where("test")).select("doc_id", "model_action", r("model_confidence").alias("model_confidence"))


@query("m2_boosted_vote")
def _(load):
    rows = _rows(load)
    model = M.train_boosted(rows.where(~F.col("test")), FEATURES, rounds=8, shapes=((4, 0.2), (2, 0.4)))
    return model.score(rows.where("test")).select("doc_id", "model_action", r("model_confidence").alias("model_confidence"))


# Two stand-ins for models: shares of the features of a row. SQL repeats the vote and what is measured of it.
_LABELS = ("drop_column", "keep_as_is", "parse_datetime", "text_clean")
_SCORE_PARTS = {"first": ("digits + 1.0", "blanks + 1.0", "n_chars / 6.0", "words + 1.0"), "second": ("lines * 40.0", "mean_word * 30.0", "n_chars / 9.0", "digits + 100.0")}


def _shares_sql(parts):
    whole = " + ".join(parts)
    return ", ".join(f"CAST({p} AS DOUBLE) / CAST({whole} AS DOUBLE)" for p in parts)


def _given(load):
    return _rows(load).withColumns({name: F.expr(f"array({_shares_sql(parts)})") for name, parts in _SCORE_PARTS.items()})


_ROWS_SQL = """SELECT doc_id, n_chars, len(string_split_regex(trim(text), '\\s+')) AS words, length(text) / len(string_split_regex(trim(text), '\\s+')) AS mean_word,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^ ]', '', 'g')) AS blanks, len(string_split(text, chr(10))) AS lines,
  CASE WHEN quality = 1 THEN 'keep_as_is' WHEN toxic = 1 THEN 'drop_column' ELSE 'text_clean' END AS label FROM labels JOIN documents USING (doc_id)"""
_VOTE_SQL = f"""x AS MATERIALIZED (SELECT *, {", ".join(f"[{_shares_sql(parts)}] AS {name}" for name, parts in _SCORE_PARTS.items())} FROM ({_ROWS_SQL}) d),
y AS MATERIALIZED (SELECT *, {list(_LABELS)} AS names, [{", ".join(f"(first[{i}] + second[{i}]) / 2" for i in range(1, len(_LABELS) + 1))}] AS mean FROM x),
z AS MATERIALIZED (SELECT *, list_max(mean) AS model_confidence, names[list_position(mean, list_max(mean))] AS model_action, names[list_position(first, list_max(first))] AS first_action FROM y)"""


@query("m2_vote_of_given_scores", f"WITH {_VOTE_SQL} SELECT doc_id, model_action, round(model_confidence, 6) AS model_confidence FROM z")
def _(load):
    return M.soft_vote(_given(load), ["first", "second"], list(_LABELS)).select("doc_id", "model_action", r("model_confidence").alias("model_confidence"))


@query("m4_evaluation_of_given_scores", f"""WITH {_VOTE_SQL} SELECT round(avg((label = model_action)::INT), 6) AS accuracy,
  round(avg((len(list_filter(mean, lambda v: v > mean[list_position(names, label)])) < 3)::INT), 6) AS top3_accuracy, round(avg(model_confidence), 6) AS mean_confidence, count(*) AS n FROM z""")
def _(load):
    found = M.evaluate(M.soft_vote(_given(load), ["first", "second"], list(_LABELS)))
    return found.select(*[r(c).alias(c) for c in ("accuracy", "top3_accuracy", "mean_confidence")], "n")


@query("m10_comparison_of_given_scores", f"""WITH {_VOTE_SQL} SELECT round(avg((label = model_action)::INT), 6) AS first_accuracy, round(avg((label = first_action)::INT), 6) AS second_accuracy,
  round(avg((model_action = first_action)::INT), 6) AS agreement, count(*) AS n FROM z""")
def _(load):
    rows = _given(load)
    found = M.compare(M.soft_vote(rows, ["first", "second"], list(_LABELS)), M.soft_vote(rows, ["first"], list(_LABELS)), "doc_id")
    return found.select(*[r(c).alias(c) for c in ("first_accuracy", "second_accuracy", "agreement")], "n")


@query("m3_batch_scoring")
def _(load):
    model, rows = _trained(load)
    return model.score(rows.drop("label", "test")).select("doc_id", "model_action", "model_confidence", F.explode("probabilities").alias("action", "probability"))


@query("m4_evaluation")
def _(load):
    model, rows = _trained(load)
    return M.evaluate(model.score(rows.where("test")))


@query("m5_feature_importance")
def _(load):
    return _trained(load)[0].importances(load("labels").sparkSession, 5)


@query("m6_best_action")
def _(load):
    rows = _rows(load).select("doc_id", "n_chars", "lines", "quality")
    return M.best_action(rows, "n_chars", "quality", "doc_id", M.CANDIDATES["numeric"], ["lines"])


_KIND = """CASE WHEN present = 0 THEN 'all_null' WHEN unique_count <= 1 THEN 'constant' WHEN unique_count = row_count AND contains(lower(column_name), 'id') THEN 'all_unique_id' WHEN is_temporal THEN 'datetime'
  WHEN in_words AND unique_count <= 3 THEN 'boolean' WHEN whole AND min_value >= 0 AND max_value <= 1 THEN 'boolean' WHEN is_numeric THEN 'numeric'
  WHEN unique_count / present > 0.5 AND avg_length > 30 THEN 'text' ELSE 'categorical' END"""


def _kinds_sql(*names):
    return f"(SELECT table_name, column_name, {_KIND} AS kind FROM (SELECT *, decimals = 0 AS whole, coalesce(in_boolean_set, FALSE) AS in_words FROM {profile_sql(*names, semantics=True)} p) x)"


_KINDS = _kinds_sql("messy", "customer", "events")


@query("m7_column_kinds", f"SELECT table_name, column_name, kind, CASE kind WHEN 'datetime' THEN 'parse_datetime' WHEN 'boolean' THEN 'parse_boolean' WHEN 'constant' THEN 'drop_column' WHEN 'all_null' THEN 'drop_column' WHEN 'all_unique_id' THEN 'drop_column' END AS action FROM {_KINDS} k")
def _(load):
    return M.column_kinds(_profile(load, WITH_SEMANTICS, ("messy", "customer", "events")))


@query("m8_training_rows", f"""WITH {_DECIDED} SELECT CASE WHEN kind IN ('all_null', 'constant', 'all_unique_id', 'datetime', 'boolean') THEN 'clear' ELSE kind END AS stage, action AS label,
  count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM f JOIN {_kinds_sql(*NAMES)} q USING (table_name, column_name) GROUP BY ALL""")
def _(load):
    found = _profile(load, WITH_SEMANTICS)
    rows = M.training_rows(meta_features(found), recommend(found), M.column_kinds(found))
    return M.label_distribution(rows).withColumn("mean_confidence", r("mean_confidence"))


_T = "(SELECT CASE WHEN quality = 1 THEN 'keep_as_is' ELSE 'drop_column' END AS truth, CASE WHEN toxic = 0 THEN 'keep_as_is' ELSE 'drop_column' END AS predicted FROM labels)"


@query("m9_safety_gates", f"""WITH t AS {_T}, g AS (SELECT 'drop_accuracy' AS gate, avg((predicted = 'drop_column')::INT) FILTER (truth = 'drop_column') AS value, 0.7::DOUBLE AS limit_value, TRUE AS high FROM t
UNION ALL SELECT 'keep_as_drop', avg((truth = 'keep_as_is' AND predicted = 'drop_column')::INT), 0.05, FALSE FROM t UNION ALL SELECT 'overall_accuracy', avg((truth = predicted)::INT), 0.7, TRUE FROM t
UNION ALL SELECT 'action:' || truth, avg((truth = predicted)::INT), 0.6, TRUE FROM t GROUP BY truth)
SELECT gate, round(value, 6) AS value, CASE WHEN high THEN value >= limit_value ELSE value <= limit_value END AS passed FROM g""")
def _(load):
    rows = load("labels").select(F.when(F.col("quality") == 1, "keep_as_is").otherwise("drop_column").alias("truth"),
                                 F.when(F.col("toxic") == 0, "keep_as_is").otherwise("drop_column").alias("predicted"))
    return M.safety_gates(rows).select("gate", r("value").alias("value"), "passed")


@query("m10_model_comparison")
def _(load):
    model, rows = _trained(load)
    narrow = M.train(rows.where(~F.col("test")), ["n_chars"])
    return M.compare(model.score(rows.where("test")), narrow.score(rows.where("test")), "doc_id")


_LEARNED, _SCORED = ("messy", "lineitem", "part", "supplier"), ("customer", "orders", "events", "nation", "region")


def _column_model(load):
    """Learned from the columns of some tables, to be applied to columns of others."""
    found = _profile(load, names=_LEARNED)
    labels = recommend(found).select("table_name", "column_name", F.col("action").alias("label"))
    return M.train(meta_features(found).join(labels, ["table_name", "column_name"]), COLUMN_FEATURES)


@query("m_predictions_for_recommendation")
def _(load):
    found = _profile(load, names=_SCORED)
    keys = ["table_name", "column_name"]
    predictions = _column_model(load).score(meta_features(found)).select(*keys, "model_action", "model_confidence")
    return recommend(found, predictions=predictions).select(*keys, "action", "confidence", "source")


@query("e5_ablation")
def _(load):
    orders = load("orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("finished"))
    return M.ablation(orders, ["o_totalprice", "o_orderpriority", "o_custkey"], "finished", "o_orderkey", _column_model(load))
