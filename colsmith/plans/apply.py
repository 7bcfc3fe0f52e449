"""Fitted transforms of many columns: one statistics job, then projections and lookups.

``fit`` gathers what every requested action needs in one aggregation, and all dictionaries and distinct counts in
another. ``Fitted.transform`` is lazy and works on batch and streaming frames alike, apart
from the order-dependent fills, which need the whole table and place its rows when they are applied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions import scalar as S
from colsmith.operators import cluster, encode, nulls, numeric, temporal, text, validate
from colsmith.operators.quantiles import exact_quantiles
from colsmith.plans.actions import CATEGORY_OF, FALLBACKS

SIMPLE = {
    "keep_as_is": lambda c, kind, p: c,
    "parse_boolean": lambda c, kind, p: S.to_flag(c),
    "parse_datetime": lambda c, kind, p: temporal.moment(c, kind),
    "parse_json": lambda c, kind, p: S.json_text(c),
    "currency_normalize": lambda c, kind, p: S.clean_currency(c),
    "percentage_to_decimal": lambda c, kind, p: S.percent_to_fraction(c),
    "text_lowercase": lambda c, kind, p: F.lower(c.cast("string")),
    "text_uppercase": lambda c, kind, p: F.upper(c.cast("string")),
    "text_clean": lambda c, kind, p: S.strip_punctuation(c),
    "phone_standardize": lambda c, kind, p: S.phone_digits(c),
    "email_validate": lambda c, kind, p: S.valid_email(c),
    "url_parse": lambda c, kind, p: S.url_location(c),
    "datetime_extract_year": lambda c, kind, p: temporal.year_number(temporal.moment(c, kind)),
    "cyclic_time_encode": lambda c, kind, p: temporal.hour_sine(temporal.moment(c, kind)),
    "hash_encode": lambda c, kind, p: S.hash_bucket(c, p.get("n_buckets", 8)),
}
DICTIONARY = ("label_encode", "binary_encode", "frequency_encode", "ordinal_encode", "onehot_encode",
              "parse_categorical")
ORDERED = ("fill_null_forward", "fill_null_backward", "fill_null_interpolate")
POWER = ("box_cox", "yeo_johnson", "power_transform")
CONDITIONAL_DROP = ("drop_if_mostly_null", "drop_if_constant", "drop_if_all_unique")


@dataclass
class ColumnStep:
    """What happens to one column, with everything learned from the data."""

    column: str
    requested: str
    action: str
    parameters: dict = field(default_factory=dict)
    statistics: dict = field(default_factory=dict)
    dictionary: encode.Dictionary | None = None
    model: object = None
    status: str = "success"
    note: str = ""


class UnfitForAction(ValueError):
    """The column cannot take the action; the fallback action is tried next."""


@dataclass
class Fitted:
    steps: list[ColumnStep]
    kinds: dict[str, str]
    target: str | None = None
    order_by: list[str] | None = None
    partition_by: list[str] = field(default_factory=list)
    refused: list[ColumnStep] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Project all simple steps at once, then run the joins and the drops."""
        projected, others = {}, []
        for step in self.steps:
            value = self._projection(step)
            if value is None:
                others.append(step)
            else:
                projected[step.column] = value
        out = df.withColumns(projected) if projected else df
        for step in others:
            out = self._rewrite(out, step)
        dropped = [s.column for s in self.steps if s.action == "drop_column"]
        return out.drop(*dropped) if dropped else out

    def number(self, column: str) -> Column:
        kind = self.kinds[column]
        return S.as_double(F.col(column), kind) if S.is_number(kind) else S.clean_number(F.col(column))

    def _projection(self, step: ColumnStep) -> Column | None:
        a, c, s, p = step.action, F.col(step.column), step.statistics, step.parameters
        if a in SIMPLE:
            return SIMPLE[a](c, self.kinds[step.column], p)
        if a in numeric.TRANSFORMS:
            if s.get("n") == 0:
                return self.number(step.column)
            return numeric.TRANSFORMS[a].apply(self.number(step.column), s, p)
        if a == "parse_numeric":
            return self.number(step.column)
        if a in ("fill_null_mean", "fill_null_median", "fill_null_mode"):
            return c if s["fill"] is None else F.coalesce(c, F.lit(s["fill"]))
        if a in POWER:
            return power_projection(self.number(step.column), a, s)
        if a == "interaction_features":
            return c
        return None

    def _rewrite(self, df: DataFrame, step: ColumnStep) -> DataFrame:
        a, c = step.action, step.column
        if a in ("label_encode", "binary_encode"):
            return encode.label_encode(df, c, step.dictionary)
        if a == "ordinal_encode":
            return encode.ordinal_encode(df, c, step.parameters.get("order"), step.dictionary)
        if a == "frequency_encode":
            return encode.frequency_encode(df, c, step.dictionary)
        if a == "target_encode" and step.parameters.get("folds"):
            return encode.target_encode_folds(df, c, self.target, F.col(step.parameters["key"]), step.parameters["folds"])
        if a == "target_encode":
            return encode.target_encode(df, c, self.target, step.dictionary, step.statistics["overall"])
        if a == "onehot_encode":
            return encode.one_hot(df, c, step.statistics["values"])
        if a == "quantile_transform":
            knots = step.statistics["knots"]
            return numeric.apply_quantile_knots(df, c, knots) if knots else df
        if a == "geo_cluster_kmeans":
            return step.model.transform(df, c)
        if a == "text_vectorize_tfidf":
            weighted = text.with_tfidf(df, c, step.model, "__vector")
            size = max(1, len(step.model.terms))
            return weighted.withColumn(c, F.aggregate("__vector", F.lit(0.0), lambda t, x: t + x) / size).drop("__vector")
        if a == "remove_duplicates":
            return remove_duplicates(df, step.parameters.get("subset"), step.parameters.get("order_by"))
        if a == "fill_null_forward":
            return nulls.fill_forward(df, c, self.order_by, self.partition_by)
        if a == "fill_null_backward":
            return nulls.fill_backward(df, c, self.order_by, self.partition_by)
        if a == "fill_null_interpolate":
            return nulls.interpolate(df, c, self.order_by, self.partition_by)
        return df

    def checked(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """The report with the outcome of the checks: ``validated``, ``score`` (share of metrics passed), ``in_range`` and ``passed``.

        Columns that both frames have are profiled in shared jobs; dropped and expanded columns are not validated.
        """
        both = [s.column for s in self.steps if s.status == "success" and s.column in after.columns and s.action != "keep_as_is"]
        report = self.report(before.sparkSession)
        if not both:
            return report.withColumns({"validated": F.lit(False), "score": F.lit(None).cast("double"), "in_range": F.lit(None).cast("boolean"), "passed": F.lit(None).cast("boolean")})
        verdict = validate.statistical_verdict(validate.statistical_metrics(before, after, both)).select(F.col("column_name").alias("column"), "score", F.col("passed").alias("__sound"))
        numbers = [c for c in both if S.is_number(self.kinds[c]) and S.is_number(after.schema[c].dataType.simpleString())]
        ranged = (validate.range_check(before, after, numbers).select(F.col("column_name").alias("column"), F.col("passed").alias("in_range"))
                  if numbers else verdict.select("column", F.lit(None).cast("boolean").alias("in_range")).limit(0))
        joined = report.join(verdict, "column", "left").join(ranged, "column", "left")
        return joined.withColumns({"validated": F.col("score").isNotNull(), "passed": F.col("__sound") & F.coalesce("in_range", F.lit(True))}).drop("__sound")

    def report(self, spark) -> DataFrame:
        rows = [(s.column, s.requested, s.action, CATEGORY_OF.get(s.action), s.status, s.note) for s in [*self.steps, *self.refused]]
        return spark.createDataFrame(
            rows, "column string, requested string, applied string, category string, status string, note string"
        )


def power_projection(c: Column, action: str, s: dict) -> Column:
    if s.get("lambda") is None:
        return c
    if action == "box_cox":
        return numeric.box_cox_value(c + s["shift"], s["lambda"])
    value = numeric.yeo_johnson_value(c, s["lambda"])
    return (value - s["mean"]) / (s["stddev_pop"] or 1.0)


def fit(
    df: DataFrame,
    decisions: dict[str, str | tuple[str, dict]],
    target: str | None = None,
    order_by: list[str] | None = None,
    partition_by: list[str] = (),
    accepted: dict[str, bool] | None = None,
) -> Fitted:
    """Learn the parameters of one action per column.

    ``decisions`` maps a column to an action name or to (action, parameters). A column that ``accepted`` maps to
    False stays as it is. ``target_encode`` with the parameters ``folds`` and ``key`` is out of fold: no row sees its own target.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    steps = []
    for column, choice in decisions.items():
        action, parameters = choice if isinstance(choice, tuple) else (choice, {})
        if accepted is not None and not accepted.get(column, True):
            steps.append(ColumnStep(column, action, "keep_as_is", status="skipped", note="not accepted"))
        elif column not in kinds:
            steps.append(ColumnStep(column, action, "keep_as_is", status="error", note="no such column"))
        elif action not in CATEGORY_OF:
            steps.append(ColumnStep(column, action, "keep_as_is", status="error", note="no such action"))
        else:
            steps.append(ColumnStep(column, action, action, dict(parameters)))
    fitted = Fitted([s for s in steps if s.status != "error"], kinds, target, order_by, list(partition_by))
    pending = list(fitted.steps)
    while pending:
        pending = _learn(df, fitted, pending)
    fitted.refused = [s for s in steps if s.status == "error"]
    return fitted


def _learn(df: DataFrame, fitted: Fitted, steps: list[ColumnStep]) -> list[ColumnStep]:
    """One round of learning; returns the steps that fell back and need another round."""
    requests: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, step in enumerate(steps):
        c = F.col(step.column)
        requests[f"{i}|present"] = F.count(c)
        if _needs_number(step.action):
            number = fitted.number(step.column)
            names = {"n", "min", *numeric.TRANSFORMS[step.action].needs} if step.action in numeric.TRANSFORMS else {"n", "min", "max", "mean", "mean_log"}
            for name in names:
                requests[f"{i}|{name}"] = numeric.STATISTICS[name](number)
        if step.action == "target_encode" and fitted.target:
            requests[f"{i}|overall"] = F.avg(fitted.target)
    row = df.agg(*[v.alias(k) for k, v in requests.items()]).first().asDict()
    aimed = [s.column for s in steps if s.action == "target_encode" and fitted.target]
    wanted = [s.column for s in steps if (s.action in DICTIONARY and not s.parameters.get("order")) or s.action in ("drop_if_constant", "drop_if_all_unique")]
    columns = list(dict.fromkeys(wanted + aimed))
    counted = encode.Counted(df, columns, target=fitted.target if aimed else None) if columns else None
    retry = []
    quantiles: dict[int, tuple[float, ...]] = {}
    for i, step in enumerate(steps):
        step.statistics = {k.split("|")[1]: v for k, v in row.items() if k.startswith(f"{i}|")}
        step.statistics["rows"] = row["rows"]
        try:
            probs = _check(df, fitted, step, counted)
            if probs:
                quantiles[i] = probs
        except UnfitForAction as reason:
            step.note = str(reason)
            if step.action in FALLBACKS and step.status != "fallback":
                step.action, step.status = FALLBACKS[step.action], "fallback"
                retry.append(step)
            else:
                step.action, step.status = "keep_as_is", "skipped"
    if quantiles:
        numbers = df.select(*[fitted.number(steps[i].column).alias(f"c{i}") for i in quantiles])
        found = exact_quantiles(
            numbers, {f"c{i}": list(p) for i, p in quantiles.items()},
            {f"c{i}": steps[i].statistics["n"] for i in quantiles},
        )
        for i, probs in quantiles.items():
            values = found[f"c{i}"]
            steps[i].statistics.update(dict(zip(probs, values)))
            if steps[i].action == "fill_null_median":
                steps[i].statistics["fill"] = values[0]
            if steps[i].action == "quantile_transform":
                steps[i].statistics["knots"] = numeric.quantile_knots(values)
    _fit_powers(df, fitted, [s for s in steps if s.action in POWER and s not in retry])
    return retry


def _needs_number(action: str) -> bool:
    return action in numeric.TRANSFORMS or action in POWER or action in (
        "parse_numeric", "fill_null_mean", "fill_null_median", "quantile_transform", "geo_cluster_kmeans")


def _check(df: DataFrame, fitted: Fitted, step: ColumnStep, counted: encode.Counted | None) -> tuple[float, ...]:
    """Fill in dictionaries and models; say which quantiles are still wanted."""
    a, c, s, p = step.action, step.column, step.statistics, step.parameters
    kind = fitted.kinds[c]
    if _needs_number(a) and not S.is_number(kind) and s["n"] <= 0.5 * s["rows"]:
        raise UnfitForAction("half of the values or fewer are numbers")
    if a in numeric.TRANSFORMS:
        step.parameters = {**numeric.TRANSFORMS[a].defaults, **p}
        return numeric.TRANSFORMS[a].probs(step.parameters) if s["n"] else ()
    if a == "fill_null_mean":
        s["fill"] = s["mean"]
    elif a == "fill_null_median":
        s["fill"] = None
        return (0.5,) if s["n"] else ()
    elif a == "fill_null_mode":
        s["fill"] = nulls.column_mode(df, c)
    elif a == "quantile_transform":
        s["knots"] = []
        if s["n"] < 2:
            return ()
        levels = max(2, min(s["n"] // 2, p.get("n_quantiles", 1000)))
        return tuple(i / (levels - 1) for i in range(levels))
    elif a in DICTIONARY and not p.get("order"):
        limit = p.get("max_categories", encode.ONE_HOT_LIMIT)
        if a == "onehot_encode" and counted.size(c) > limit:
            raise UnfitForAction(f"more than {limit} values")
        step.dictionary = counted.dictionary(c)
        if a == "onehot_encode":
            s["values"] = step.dictionary.values()
    elif a == "target_encode":
        if not fitted.target:
            raise UnfitForAction("no target column")
        step.dictionary = counted.means(c)
    elif a in CONDITIONAL_DROP:
        _decide_drop(step, counted)
    elif a in ORDERED and not fitted.order_by:
        raise UnfitForAction("needs an order_by")
    elif a == "geo_cluster_kmeans":
        if not S.is_number(kind):
            raise UnfitForAction("not a number column")
        step.model = cluster.fit_geo_clusters(df, [c], p.get("n_clusters", 10), p.get("seed", 42))
    elif a == "text_vectorize_tfidf":
        step.model = text.fit_vocabulary(df, c, p.get("max_features", 100))
        if not step.model.terms:
            raise UnfitForAction("no terms")
    return ()


def _decide_drop(step: ColumnStep, counted: encode.Counted | None) -> None:
    s, c = step.statistics, step.column
    if step.action == "drop_if_mostly_null":
        drop = s["rows"] > 0 and 1 - s["present"] / s["rows"] > step.parameters.get("threshold", 0.6)
    else:
        distinct = counted.size(c)
        s["distinct"] = distinct
        drop = distinct == 1 if step.action == "drop_if_constant" else distinct == s["rows"]
    step.note = "dropped" if drop else "kept"
    step.action = "drop_column" if drop else "keep_as_is"


def _fit_powers(df: DataFrame, fitted: Fitted, steps: list[ColumnStep]) -> None:
    requests, given, moved = {}, {}, {}
    shifted = df
    for i, step in enumerate(steps):
        s = step.statistics
        s["shift"] = 0.0
        if not s["n"] or s["min"] == s["max"]:
            s["lambda"] = None
            continue
        if "lambda" in step.parameters:
            given[i] = float(step.parameters["lambda"])
        box = step.action == "box_cox"
        if box and s["min"] <= 0:
            s["shift"] = abs(s["min"]) + 1
            moved[i] = F.avg(F.ln(fitted.number(step.column) + s["shift"]))
        alias = f"w{i}"
        requests[alias] = (F.col(alias), "box_cox" if box else "yeo_johnson", s["mean_log"] or 0.0)
        shifted = shifted.withColumn(alias, fitted.number(step.column) + s["shift"])
    if not requests:
        return
    if moved:  # means of the logarithms of all shifted columns
        for key, mean in df.agg(*[m.alias(f"w{i}") for i, m in moved.items()]).first().asDict().items():
            requests[key] = (*requests[key][:2], mean or 0.0)
            steps[int(key[1:])].statistics["mean_log"] = mean
    narrow = shifted.select(*requests)
    free = {a: r for a, r in requests.items() if int(a[1:]) not in given}
    found = numeric.fit_power(narrow, free) if free else {}
    found.update({f"w{i}": lam for i, lam in given.items()})
    moments = []
    for alias, lam in found.items():
        if requests[alias][1] == "yeo_johnson":
            value = numeric.yeo_johnson_value(F.col(alias), lam)
            moments += [F.avg(value).alias(f"{alias}_m"), F.stddev_pop(value).alias(f"{alias}_s")]
    row = narrow.agg(*moments).first() if moments else None
    for i, step in enumerate(steps):
        alias = f"w{i}"
        if alias in found:
            step.statistics["lambda"] = found[alias]
            if requests[alias][1] == "yeo_johnson":
                step.statistics["mean"], step.statistics["stddev_pop"] = row[f"{alias}_m"], row[f"{alias}_s"]


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """One of each set of equal rows; with ``subset``, the first row in ``order_by`` of each of its values.

    Without an order there is no telling which row of a subset stays, so that is refused.
    """
    if not subset:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("duplicates over a subset of columns need an order_by")
    place = F.row_number().over(W.partitionBy(*subset).orderBy(*order_by))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Product columns ``a_x_b`` of the requested pairs."""
    return df.withColumns({f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in pairs})
