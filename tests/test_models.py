"""Boosted ensembles of the action model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsmith.plans import models as M


@pytest.fixture(scope="module")
def checkers(spark):
    """Three labels that no single straight line tells apart."""
    rng = np.random.default_rng(4)
    x, y = rng.random(600), rng.random(600)
    label = np.where((x > 0.5) != (y > 0.5), "scale", np.where(x > 0.5, "drop", "keep"))
    rows = [(i, float(a), float(b), float(rng.random()), str(c)) for i, (a, b, c) in enumerate(zip(x, y, label))]
    return spark.createDataFrame(rows, "id int, x double, y double, noise double, label string").persist()


def test_boosted_vote_on_unseen_rows(spark, checkers):
    model = M.train_boosted(checkers.where("id % 4 <> 0"), ["x", "y", "noise"], rounds=6, shapes=((3, 0.3), (2, 0.5)))
    scored = model.score(checkers.where("id % 4 = 0")).persist()
    assert M.evaluate(scored).first()["accuracy"] > 0.9
    assert scored.columns == [*checkers.columns, "model_confidence", "model_action", "probabilities"]
    for row in scored.collect():
        p = row["probabilities"]
        assert sum(p.values()) == pytest.approx(1.0) and set(p) == {"drop", "keep", "scale"}
        assert row["model_confidence"] == max(p.values()) == p[row["model_action"]]
    weights = {r["feature"]: r["importance"] for r in model.importances(spark, 3).collect()}
    assert weights["noise"] < min(weights["x"], weights["y"])


def test_boosted_vote_is_the_mean_of_its_members(checkers):
    model = M.train_boosted(checkers, ["x", "y"], rounds=2, shapes=((2, 0.3), (1, 0.5)))
    alone = [M.BoostedModel(model.features, model.labels, [m]) for m in model.members]
    rows = [{r["id"]: r["probabilities"] for r in m.score(checkers.where("id < 20")).collect()} for m in (model, *alone)]
    for i, p in rows[0].items():
        assert all(v == pytest.approx((rows[1][i][k] + rows[2][i][k]) / 2) for k, v in p.items())


def test_boosted_vote_on_odd_rows(spark, checkers):
    one = M.train_boosted(checkers.where("label = 'keep'"), ["x", "y"])
    row = one.score(checkers.limit(1)).first()
    assert row["model_action"] == "keep" and row["model_confidence"] == 1.0
    with pytest.raises(ValueError):
        M.train_boosted(checkers.where("false"), ["x", "y"])
    gaps = checkers.withColumn("label", F.when(F.col("id") % 3 > 0, F.col("label"))).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("x")).otherwise(float("nan")))
    model = M.train_boosted(gaps.withColumn("w", F.lit(2.0)), ["x", "y"], weight="w", rounds=1, shapes=((1, 0.3),))
    assert model.score(gaps.withColumn("y", F.lit(None).cast("double"))).where("model_action is null").count() == 0
    assert model.score(gaps.where("false")).count() == 0
