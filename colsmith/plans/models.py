"""Action models: training, soft voting, scoring, evaluation and the search for good actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import scalar as S
from colsmith.operators.features import zero
from colsmith.plans import apply, recommend
from colsmith.plans.evaluate import confusion

# Actions tried per kind of column, and the actions of the clear cases.
CANDIDATES = {
    "numeric": ("keep_as_is", "standard_scale", "minmax_scale", "robust_scale", "log_transform", "log1p_transform", "sqrt_transform", "clip_outliers"),
    "categorical": ("keep_as_is", "onehot_encode", "label_encode", "ordinal_encode", "frequency_encode", "drop_column"),
    "text": ("keep_as_is", "drop_column", "label_encode"),
}
CLEAR_CASES = {"all_null": "drop_column", "constant": "drop_column", "all_unique_id": "drop_column", "datetime": "parse_datetime",
               "boolean": "parse_boolean"}


@dataclass
class ActionModel:
    """Soft vote of a random forest and a logistic regression over the same feature columns."""

    features: list[str]
    labels: list[str]
    forest: PipelineModel
    linear: PipelineModel

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``model_action``, ``model_confidence`` and the map ``probabilities``."""
        scored = self.linear.transform(self.forest.transform(_clean(df, self.features)))
        mean = F.zip_with(vector_to_array("forest_probability"), vector_to_array("linear_probability"), lambda a, b: (a + b) / 2)
        return _voted(scored, mean, self.labels).drop("vector", *[f"{m}_{c}" for m in ("forest", "linear") for c in ("raw", "probability", "prediction")])

    def importances(self, spark, top: int = 10) -> DataFrame:
        weights = self.forest.stages[-1].featureImportances
        rows = sorted(((f, float(weights[i])) for i, f in enumerate(self.features)), key=lambda r: (-r[1], r[0]))[:top]
        return spark.createDataFrame(rows, "feature string, importance double")


def _voted(scored: DataFrame, mean: Column, labels: list[str]) -> DataFrame:
    """The likeliest label by an array of probabilities; the first one in a tie."""
    names = F.lit(labels)
    best = F.array_max("__mean")
    place = F.array_position("__mean", best)
    return scored.withColumn("__mean", mean).withColumns({
        "model_confidence": best, "model_action": F.when(best.isNotNull(), F.element_at(names, place.cast("int"))), "probabilities": F.map_from_arrays(names, F.col("__mean")),
    }).drop("__mean")


def soft_vote(df: DataFrame, scores: list[str], labels: list[str]) -> DataFrame:
    """The vote of any models whose probabilities stand in array columns, in the order of ``labels``.

    Adds the columns that ``ActionModel.score`` adds; a row where one of the arrays is null gets nulls.
    """
    mean = F.col(scores[0])
    for other in scores[1:]:
        mean = F.zip_with(mean, other, lambda a, b: a + b)
    return _voted(df, F.transform(mean, lambda v: v / len(scores)), labels)


def _clean(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def train(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 6, seed: int = 42) -> ActionModel:
    data = _clean(rows, features)
    indexer: StringIndexerModel = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(data)
    indexed = indexer.transform(data)
    assembler = VectorAssembler(inputCols=features, outputCol="vector")
    forest = RandomForestClassifier(labelCol="__label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed,
                                    rawPredictionCol="forest_raw", probabilityCol="forest_probability", predictionCol="forest_prediction")
    linear = LogisticRegression(labelCol="__label", featuresCol="vector", maxIter=30, regParam=0.01,
                                rawPredictionCol="linear_raw", probabilityCol="linear_probability", predictionCol="linear_prediction")
    vectors = assembler.transform(indexed)
    return ActionModel(list(features), list(indexer.labels), Pipeline(stages=[assembler, forest]).fit(indexed),
                       PipelineModel([linear.fit(vectors)]))


@dataclass
class BoostedModel:
    """Soft vote of boosted tree ensembles that differ in depth and step; scores like ``ActionModel``.

    Spark boosts two classes, so a member holds one ensemble for each label against the others; their
    probabilities are brought to a sum of one before members are averaged.
    """

    features: list[str]
    labels: list[str]
    members: list[list[GBTClassificationModel]]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``model_action``, ``model_confidence`` and the map ``probabilities``; null and NaN features count as 0."""
        scored = VectorAssembler(inputCols=self.features, outputCol="__vector").transform(_clean(df, self.features))
        votes, made = [], []
        for m, member in enumerate(self.members):
            chances = []
            for i, model in enumerate(member):
                name = f"__boosted_{m}_{i}"
                outputs = {model.featuresCol: "__vector", model.probabilityCol: name, model.rawPredictionCol: "", model.predictionCol: ""}
                scored = model.transform(scored, outputs)
                chances.append(F.get(vector_to_array(name), F.lit(1)))
                made.append(name)
            votes.append(_shares(F.array(*chances)) if chances else F.array(F.lit(1.0)))
        mean = votes[0]
        for other in votes[1:]:
            mean = F.zip_with(mean, other, lambda a, b: a + b)
        mean = F.transform(mean, lambda v: v / len(votes))
        return _voted(scored, mean, self.labels).drop("__vector", *made)

    def importances(self, spark, top: int = 10) -> DataFrame:
        """Mean importance of each feature over all ensembles."""
        models = [m for member in self.members for m in member]
        total = [sum(float(m.featureImportances[i]) for m in models) / max(1, len(models)) for i in range(len(self.features))]
        rows = sorted(zip(self.features, total), key=lambda r: (-r[1], r[0]))[:top]
        return spark.createDataFrame(rows, "feature string, importance double")


def _shares(chances: Column) -> Column:
    total = F.aggregate(chances, F.lit(0.0), lambda t, v: t + v)
    return F.transform(chances, lambda v: F.when(total > 0, v / total).otherwise(1.0 / F.size(chances)))


def train_boosted(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None, rounds: int = 20,
                  shapes: tuple[tuple[int, float], ...] = ((5, 0.1), (3, 0.3)), subsample: float = 0.8, seed: int = 42) -> BoostedModel:
    """One member for each (depth, step) of ``shapes``; ``subsample`` is the share of rows that a tree sees.

    Rows without a label are left out. Each round is a few distributed jobs over the prepared rows, which are kept in memory or on disk; a single label
    needs no ensemble and no rows an error, as nothing could be predicted.
    """
    columns = [*features, label, *([weight] if weight else [])]
    data = _clean(rows.where(F.col(label).isNotNull()).select(*dict.fromkeys(columns)), features)
    labels = sorted(r[0] for r in data.select(F.col(label).cast("string")).distinct().collect())
    if not labels:
        raise ValueError("no labelled rows to learn from")
    if len(labels) == 1:
        return BoostedModel(list(features), labels, [[] for _ in shapes])
    vectors = VectorAssembler(inputCols=features, outputCol="__vector").transform(data).select(
        "__vector", F.col(label).cast("string").alias("__name"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__weight")).persist()
    try:
        members = []
        for depth, step in shapes:
            boosted = GBTClassifier(featuresCol="__vector", labelCol="__own", weightCol="__weight", maxIter=rounds, maxDepth=depth, stepSize=step,
                                    subsamplingRate=subsample, featureSubsetStrategy="all", seed=seed)
            members.append([boosted.fit(vectors.withColumn("__own", (F.col("__name") == name).cast("double"))) for name in labels])
    finally:
        vectors.unpersist()
    return BoostedModel(list(features), labels, members)


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy, accuracy within the best three, and mean confidence."""
    entries = F.array_sort(F.map_entries("probabilities"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
    three = F.transform(F.slice(entries, 1, 3), lambda e: e["key"])
    return scored.agg(
        F.avg((F.col(label) == F.col("model_action")).cast("double")).alias("accuracy"),
        F.avg(F.array_contains(three, F.col(label)).cast("double")).alias("top3_accuracy"), F.avg("model_confidence").alias("mean_confidence"),
        F.count(F.lit(1)).alias("n"))


def compare(first: DataFrame, second: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Accuracy of two models on the same labelled rows, and how often they agree."""
    joined = first.select(key, label, F.col("model_action").alias("a")).join(second.select(key, F.col("model_action").alias("b")), key)
    return joined.agg(F.avg((F.col("a") == F.col(label)).cast("double")).alias("first_accuracy"), F.avg((F.col("b") == F.col(label)).cast("double")).alias("second_accuracy"),
                      F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def safety_gates(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(gate, value, limit, passed): drops must be right, keeps must not be dropped, overall must hold."""
    matrix = confusion(rows, truth, predicted)
    n, same = F.col("n"), F.col("truth") == F.col("predicted")
    total = F.sum("n")
    drops = F.sum(F.when(F.col("truth") == "drop_column", n))
    good_drops = F.sum(F.when((F.col("truth") == "drop_column") & same, n).otherwise(0))
    lost = F.sum(F.when((F.col("truth") == "keep_as_is") & (F.col("predicted") == "drop_column"), n).otherwise(0))
    facts = matrix.agg(F.coalesce(good_drops / drops, F.lit(1.0)).alias("drop_accuracy"), (lost / total).alias("keep_lost"),
                       (F.sum(F.when(same, n).otherwise(0)) / total).alias("overall"))
    gates = facts.select(F.inline(F.array(
        F.struct(F.lit("drop_accuracy").alias("gate"), F.col("drop_accuracy").alias("value"), F.lit(0.7).alias("limit"), (F.col("drop_accuracy") >= 0.7).alias("passed")),
        F.struct(F.lit("keep_as_drop").alias("gate"), F.col("keep_lost").alias("value"), F.lit(0.05).alias("limit"), (F.col("keep_lost") <= 0.05).alias("passed")),
        F.struct(F.lit("overall_accuracy").alias("gate"), F.col("overall").alias("value"), F.lit(0.7).alias("limit"), (F.col("overall") >= 0.7).alias("passed")))))
    each = matrix.groupBy("truth").agg((F.sum(F.when(same, n).otherwise(0)) / F.sum("n")).alias("value"))
    return gates.unionByName(each.select(F.concat(F.lit("action:"), F.col("truth")).alias("gate"), "value", F.lit(0.6).alias("limit"), (F.col("value") >= 0.6).alias("passed")))


def column_kinds(profile: DataFrame) -> DataFrame:
    """Clear cases first, then numeric, text or categorical; ``action`` is set for clear cases."""
    unique, present = F.col("unique_count"), F.col("present")
    words = F.coalesce(F.col("boolean_words"), F.lit(False)) & (unique <= 3)
    zero_one = F.col("is_integer") & (F.col("min_value") >= 0) & (F.col("max_value") <= 1)
    long = (S.safe_ratio(unique.cast("double"), present) > 0.5) & (zero("avg_length") > 30)
    kind = S.first_match([
        (present == 0, "all_null"), (unique <= 1, "constant"), ((unique == F.col("row_count")) & F.lower("column_name").contains("id"), "all_unique_id"),
        (F.col("is_temporal"), "datetime"), (words | F.coalesce(zero_one, F.lit(False)) | (F.col("type_name") == "boolean"), "boolean"),
        (F.col("is_numeric"), "numeric"), (long, "text")], "categorical")
    actions = F.create_map(*[F.lit(x) for pair in CLEAR_CASES.items() for x in pair])
    return profile.select("table_name", "column_name", kind.alias("kind"), actions[kind].alias("action"))


def training_rows(features: DataFrame, labels: DataFrame, kinds: DataFrame) -> DataFrame:
    """Feature rows with their label, stage (clear, numeric, categorical, text) and class weight.

    Rarer labels weigh more: total / (classes * count).
    """
    keys = ["table_name", "column_name"]
    rows = features.join(labels.select(*keys, F.col("action").alias("label"), "confidence"), keys).join(kinds.select(*keys, "kind"), keys)
    staged = rows.withColumn("stage", F.when(F.col("kind").isin(*CLEAR_CASES), "clear").otherwise(F.col("kind")))
    counts = staged.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    weights = counts.crossJoin(F.broadcast(total)).select("label", (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return staged.join(weights, "label")


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stage", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


# Search for the action that helps a model most ------------------------------------------------


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as stable numbers, so that any transformed column can be a feature."""
    made = {}
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        number = S.as_double(F.col(c), kind) if S.is_number(kind) else F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1024)).cast("double")
        made[c] = F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))
    return df.withColumns(made) if made else df


def fold_column(key: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds))


def cross_validated(df: DataFrame, features: list[str], target: str, key: str, folds: int = 3, estimator=None) -> float:
    """Mean accuracy over folds that are fixed by a hash of the key."""
    data = _numbers(df, features).withColumns({"__fold": fold_column(F.col(key), folds), "__y": F.col(target).cast("double")})
    vectors = VectorAssembler(inputCols=features, outputCol="__x").transform(data).select("__x", "__y", "__fold").persist()
    model = estimator or LogisticRegression(maxIter=20)
    model = model.copy({model.labelCol: "__y", model.featuresCol: "__x"})
    judge = (RegressionEvaluator(labelCol="__y", metricName="r2") if isinstance(model, RandomForestRegressor)
             else MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy"))
    scores = [judge.evaluate(model.fit(vectors.where(F.col("__fold") != f)).transform(vectors.where(F.col("__fold") == f))) for f in range(folds)]
    vectors.unpersist()
    return sum(scores) / folds


def _fold_score(df: DataFrame, actions: dict[str, str], features, target: str, key: str, folds: int, estimator) -> tuple[float, int]:
    """Mean score over folds; what the actions learn comes from the other folds only, like the model. ``features`` picks from the columns."""
    tagged = df.withColumn("__fold", fold_column(F.col(key), folds))
    model = estimator.copy({estimator.labelCol: "__y", estimator.featuresCol: "__x"})
    judge = MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy")
    scores, width = [], 0
    for f in range(folds):
        train, test = tagged.where(F.col("__fold") != f), tagged.where(F.col("__fold") == f)
        fitted = apply.fit(train, actions, target=target)
        sides = [fitted.transform(side) for side in (train, test)]
        names = features(sides[0])
        width = max(width, len(names))
        if not names:
            scores.append(0.0)
            continue
        made = [VectorAssembler(inputCols=names, outputCol="__x").transform(_numbers(s, names).withColumn("__y", F.col(target).cast("double"))).select("__x", "__y") for s in sides]
        scores.append(judge.evaluate(model.fit(made[0]).transform(made[1])))
    return sum(scores) / folds, width


def best_action(df: DataFrame, column: str, target: str, key: str, actions: tuple[str, ...], others: list[str] = (), folds: int = 3) -> DataFrame:
    """Cross-validated score of each candidate action for a column; the gap to the second gives the confidence."""
    scores = []
    for action in actions:
        own = lambda d: [c for c in d.columns if c == column or c.startswith(f"{column}_")] + list(others)
        scores.append((action, _fold_score(df, {column: action}, own, target, key, folds, LogisticRegression(maxIter=20))[0]))
    ranked = sorted(scores, key=lambda r: -r[1])
    confidence = min(1.0, 0.5 + 5 * (ranked[0][1] - ranked[1][1])) if len(ranked) > 1 else 0.6
    return df.sparkSession.createDataFrame(
        [(column, a, s, a == ranked[0][0], confidence if a == ranked[0][0] else None) for a, s in scores],
        "column_name string, action string, score double, is_best boolean, confidence double")


def ablation(df: DataFrame, columns: list[str], target: str, key: str, model: ActionModel | None = None, folds: int = 3,
             trees: int = 10, depth: int = 5) -> DataFrame:
    """Cross-validated score of a random forest after four ways of preparing the same table."""
    from colsmith.operators.features import meta_features
    from colsmith.operators.profile import profile

    found = profile({"table": df.select(*columns)})
    numeric = {r["column_name"]: r["is_numeric"] for r in found.select("column_name", "is_numeric").collect()}
    naive = {c: "standard_scale" if numeric[c] else "label_encode" for c in columns}
    plans = {"naive": naive, "rules": _chosen(recommend.recommend(found))}
    if model:
        predictions = model.score(meta_features(found)).select("table_name", "column_name", "model_action", "model_confidence")
        plans["model"] = {r["column_name"]: r["model_action"] for r in predictions.collect()}
        plans["hybrid"] = _chosen(recommend.hybrid_decisions(found, predictions))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42)
    rows = []
    for name, plan in plans.items():
        # Dropping every column would leave nothing to learn from, so drops are treated as keeps.
        actions = {c: plan.get(c, "keep_as_is") for c in columns}
        actions = {c: "keep_as_is" if a in ("drop_column", "remove_duplicates") else a for c, a in actions.items()}

        def chosen(d):
            names = [c for c in d.columns if c not in (target, key) and any(c == k or c.startswith(f"{k}_") for k in columns)]
            return [c for c in names if not S.is_time_type(d.schema[c].dataType.simpleString())]

        rows.append((name, *_fold_score(df, actions, chosen, target, key, folds, forest)))
    return df.sparkSession.createDataFrame(rows, "variant string, score double, features int")


def _chosen(decisions: DataFrame) -> dict[str, str]:
    return {r["column_name"]: r["action"] for r in decisions.select("column_name", "action").collect()}


