"""Scaling, power, quantile, outlier, binning and polynomial transforms of one number column.

Each entry names the statistics it needs and gives the projection that uses them, so that
one aggregation can serve all columns of a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS: dict[str, Callable[[Column], Column]] = {
    "n": F.count,
    "mean": F.avg,
    "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "max_abs": lambda c: F.max(F.abs(c)),
    "sum_abs": lambda c: F.sum(F.abs(c)),
    "sum_squares": lambda c: F.sum(c * c),
    "mean_log": lambda c: F.avg(F.when(c > 0, F.ln(c))),
}


@dataclass(frozen=True)
class NumberTransform:
    apply: Callable[[Column, dict, dict], Column]
    needs: tuple[str, ...] = ()
    quantiles: tuple[float, ...] | Callable[[dict], tuple[float, ...]] = ()
    defaults: dict = field(default_factory=dict)

    def probs(self, parameters: dict) -> tuple[float, ...]:
        return self.quantiles(parameters) if callable(self.quantiles) else self.quantiles


def _divisor(value) -> float:
    return float(value) if value else 1.0


def _standard(c, s, p):
    return (c - s["mean"]) / _divisor(s["stddev_pop"])


def _minmax(c, s, p):
    return (c - s["min"]) / _divisor(s["max"] - s["min"])


def _robust(c, s, p):
    return (c - s[0.5]) / _divisor(s[0.75] - s[0.25])


def _log(c, s, p):
    if s["min"] <= 0:
        return F.log1p(F.greatest(c, F.lit(0.0)))
    return F.ln(c)


def _sqrt(c, s, p):
    return F.sqrt(F.abs(c)) if s["min"] < 0 else F.sqrt(c)


def fences(s, width=1.5) -> tuple[float, float]:
    spread = s[0.75] - s[0.25]
    return s[0.25] - width * spread, s[0.75] + width * spread


def _clip(c, low, high):
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def _sigma_bounds(s):
    spread = s["stddev_samp"] or 0.0
    return s["mean"] - 3 * spread, s["mean"] + 3 * spread


def _equal_width(c, s, p):
    low, width = s["min"], (s["max"] - s["min"]) / p["n_bins"]
    if width == 0:
        return F.when(c.isNotNull(), F.lit(float((p["n_bins"] - 1) // 2)))
    place = F.ceil((c - low) / width) - 1
    return F.greatest(F.lit(0), F.least(place, F.lit(p["n_bins"] - 1))).cast("double")


def _below(c, edges):
    """Bin number of right-closed bins; the first bin takes its lower edge too."""
    number = F.lit(0)
    for e in edges[1:-1]:
        number = number + (c > e).cast("int")
    inside = c.between(edges[0], edges[-1])
    return F.when(inside, number.cast("double"))


def _equal_freq(c, s, p):
    edges = sorted({s[q] for q in freq_probs(p)})
    return _below(c, edges) if len(edges) > 1 else F.when(c.isNotNull(), F.lit(0.0))


def freq_probs(p) -> tuple[float, ...]:
    return tuple(i / p["n_bins"] for i in range(p["n_bins"] + 1))


QUARTILES = (0.25, 0.5, 0.75)

TRANSFORMS: dict[str, NumberTransform] = {
    "standard_scale": NumberTransform(_standard, ("mean", "stddev_pop")),
    "minmax_scale": NumberTransform(_minmax, ("min", "max")),
    "robust_scale": NumberTransform(_robust, quantiles=QUARTILES),
    "maxabs_scale": NumberTransform(lambda c, s, p: c / _divisor(s["max_abs"]), ("max_abs",)),
    "normalize_l1": NumberTransform(lambda c, s, p: c / _divisor(s["sum_abs"]), ("sum_abs",)),
    "normalize_l2": NumberTransform(
        lambda c, s, p: c / _divisor(math.sqrt(s["sum_squares"] or 0)), ("sum_squares",)
    ),
    "log_transform": NumberTransform(_log, ("min",)),
    "log1p_transform": NumberTransform(lambda c, s, p: F.log1p(F.greatest(c, F.lit(-1 + 1e-10)))),
    "sqrt_transform": NumberTransform(_sqrt, ("min",)),
    "clip_outliers": NumberTransform(lambda c, s, p: _clip(c, *fences(s)), quantiles=QUARTILES),
    "winsorize": NumberTransform(
        lambda c, s, p: _clip(c, s[p["lower"]], s[p["upper"]]),
        quantiles=lambda p: (p["lower"], p["upper"]), defaults={"lower": 0.05, "upper": 0.95},
    ),
    "cap_floor_outliers": NumberTransform(
        lambda c, s, p: _clip(c, *_sigma_bounds(s)), ("mean", "stddev_samp")
    ),
    "remove_outliers": NumberTransform(
        lambda c, s, p: F.when(c.between(*fences(s)), c), quantiles=QUARTILES
    ),
    "binning_equal_width": NumberTransform(_equal_width, ("min", "max"), defaults={"n_bins": 5}),
    "binning_equal_freq": NumberTransform(_equal_freq, quantiles=freq_probs, defaults={"n_bins": 5}),
    "binning_custom": NumberTransform(
        lambda c, s, p: _below(c, p["bins"]), defaults={"bins": (0, 25, 50, 75, 100)}
    ),
    "polynomial_features": NumberTransform(
        lambda c, s, p: F.pow(c, F.lit(p["degree"])), defaults={"degree": 2}
    ),
}

# Power transforms -------------------------------------------------------------------------


def box_cox_value(c: Column, lam: float) -> Column:
    return F.ln(c) if lam == 0 else (F.pow(c, F.lit(lam)) - 1) / lam


def yeo_johnson_value(c: Column, lam: float) -> Column:
    up = F.log1p(c) if lam == 0 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if lam == 2 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


# (number of points each side, spacing) of the three passes.
_PASSES = ((10, 0.5), (4, 0.08), (2, 0.01))


def _vertex(points: list[tuple[float, float]]) -> float:
    """Maximum of the parabola through the best point and its neighbours."""
    best = max(range(len(points)), key=lambda i: points[i][1])
    if best in (0, len(points) - 1):
        return points[best][0]
    (x0, y0), (x1, y1), (_, y2) = points[best - 1: best + 2]
    bend = y0 - 2 * y1 + y2
    if not math.isfinite(bend) or bend == 0:
        return x1
    return x1 + (x1 - x0) * (y0 - y2) / (2 * bend)


def fit_power(df: DataFrame, requests: dict[str, tuple[Column, str, float]]) -> dict[str, float]:
    """Maximum-likelihood exponents of several columns in three shared passes.

    ``requests`` maps an alias to (shifted column, method, mean log for Box-Cox). Each pass
    evaluates a grid of exponents as plain aggregates; the likelihood is smooth, so a
    parabola through the best points gives the centre of the next, finer grid.
    """
    centres = dict.fromkeys(requests, 0.0)
    for arms, step in _PASSES:
        parts, grids = [], {}
        for alias, (c, method, mean_log) in requests.items():
            grids[alias] = [centres[alias] + step * i for i in range(-arms, arms + 1)]
            for i, lam in enumerate(grids[alias]):
                if method == "box_cox":
                    scaled = c / math.exp(mean_log)  # unit geometric mean: only the variance is left
                    value = F.ln(scaled) if lam == 0 else F.pow(scaled, F.lit(lam)) / lam
                else:
                    value = yeo_johnson_value(c, lam)
                parts.append(F.var_pop(value).alias(f"{alias}_{i}"))
            if method != "box_cox":
                parts.append(F.avg(F.signum(c) * F.log1p(F.abs(c))).alias(f"{alias}_jac"))
        row = df.agg(*parts).first()
        for alias, (_, method, _) in requests.items():
            jacobian = 0.0 if method == "box_cox" else row[f"{alias}_jac"] or 0.0
            points = []
            for i, lam in enumerate(grids[alias]):
                var = row[f"{alias}_{i}"]
                if var and math.isfinite(var):
                    points.append((lam, -0.5 * math.log(var) + (lam - 1) * jacobian))
            centres[alias] = _vertex(points) if points else 1.0
    return centres


# Quantile transform -----------------------------------------------------------------------


def quantile_knots(references: list[float]) -> list[tuple[float, float, float]]:
    """(value, first level, last level) of each distinct reference value."""
    top = len(references) - 1
    knots: list[tuple[float, float, float]] = []
    for i, v in enumerate(references):
        level = i / top
        if knots and knots[-1][0] == v:
            knots[-1] = (v, knots[-1][1], level)
        else:
            knots.append((v, level, level))
    return knots


def apply_quantile_knots(df: DataFrame, column: str, knots: list[tuple[float, float, float]]) -> DataFrame:
    """Piecewise-linear map of a column to uniform levels; ties take the middle level."""
    c = F.col(column).cast("double")
    low, high = knots[0][0], knots[-1][0]
    if low == high:
        return df.withColumn(column, F.when(c.isNotNull(), (c > low).cast("double")))
    placed = Bucketizer(
        splits=[-math.inf, *[k[0] for k in knots], math.inf],
        inputCol="__value", outputCol="__place", handleInvalid="keep",
    ).transform(df.withColumn("__value", c))
    at = F.col("__place").cast("int")

    def levels(position: int, shift: int) -> Column:
        return F.get(F.lit([k[position] for k in knots]), at - 1 + shift)

    v0, v1 = levels(0, 0), levels(0, 1)
    between = levels(2, 0) + (c - v0) / (v1 - v0) * (levels(1, 1) - levels(2, 0))
    mapped = (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(c <= low, 0.0)
        .when(c >= high, 1.0)
        .when(c == v0, (levels(1, 0) + levels(2, 0)) / 2)
        .otherwise(between)
    )
    return placed.withColumn(column, mapped).drop("__value", "__place")
