"""Is a transformed column statistically sound? Before and after, as one row per metric."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.operators import profile as P
from colsmith.operators.features import named
from colsmith.operators.ordering import SEGMENT, SEGMENT_ROWS, with_segments

CV_GAIN = 0.1
OUTLIER_GAIN = 0.05
INFORMATION_FLOOR = 0.80
RANGE_GROWTH = 0.20
PASS_SHARE = 0.60


# Coefficients of the rational approximations of the complementary error function
# by W. J. Cody (1969), highest power first, for arguments below 0.46875, up to 4, and above.
_ERF_TOP = (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03)
_ERF_BOTTOM = (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_MID_TOP = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02,
            8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03)
_MID_BOTTOM = (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
               4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_FAR_TOP = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_FAR_BOTTOM = (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    value = F.lit(powers[0])
    for p in powers[1:]:
        value = value * x + p
    return value


def log_normal_tail(z: Column) -> Column:
    """Log of the standard normal distribution function, exact to rounding however far out.

    Spark SQL has no error function. With y = |z| / sqrt(2), erfc(y) is exp(-y^2) times a ratio of polynomials, and its
    logarithm is taken of the two factors apart, so nothing underflows.
    """
    y = F.abs(z) / math.sqrt(2)
    square = y * y
    near = 1 - y * _polynomial(square, _ERF_TOP) / _polynomial(square, _ERF_BOTTOM)
    middle = _polynomial(y, _MID_TOP) / _polynomial(y, _MID_BOTTOM)
    inverse = 1 / square
    far = (1 / math.sqrt(math.pi) - inverse * _polynomial(inverse, _FAR_TOP) / _polynomial(inverse, _FAR_BOTTOM)) / y
    log_erfc = F.when(y <= 0.46875, F.ln(near)).when(y <= 4, F.ln(middle) - square).otherwise(F.ln(far) - square)
    return F.when(z <= 0, log_erfc - math.log(2)).otherwise(F.log1p(-F.exp(log_erfc) / 2))


def anderson_darlings(columns: dict[str, tuple[DataFrame, str]], segment_rows: int = SEGMENT_ROWS) -> dict[str, float | None]:
    """Anderson-Darling statistics for normality of any number of columns; None below eight values or without spread.

    Columns of one frame are put in long form in one scan, and all columns share the same few jobs: moments, value counts cut by range of (column, value), sums of the
    segments, and the terms. A segment is a partition of that order, so it may hold many short columns or a stretch of a long one, and every column's ranks go on
    from the segments before. Equal values share their run of ranks in closed form, so neither ties nor length put everything into one task.
    """
    if not columns:
        return {}
    names, by_frame = list(columns), {}
    for k, (df, c) in enumerate(columns.values()):
        by_frame.setdefault(id(df), (df, []))[1].append(F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("double").alias("x")))
    cells = reduce(DataFrame.unionByName, [df.select(F.inline(F.array(*own))) for df, own in by_frame.values()]).where(F.col("x").isNotNull() & ~F.isnan("x"))
    moments = {r["k"]: r for r in cells.groupBy("k").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).collect()}
    known = {k: r for k, r in moments.items() if r["n"] >= 8 and r["sd"]}
    if not known:
        return dict.fromkeys(names)
    counted = cells.where(F.col("k").isin(*known)).groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
    cut, _ = with_segments(counted, ["k", "x"], segment_rows)
    sums = cut.groupBy("k", SEGMENT).agg(F.sum("c").alias("t"))  # one row a column and segment it reaches into
    before = F.coalesce(F.sum("t").over(W.partitionBy("k").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("k", SEGMENT, before.alias("offset")))
    inside = F.sum("c").over(W.partitionBy("k", SEGMENT).orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    of = F.broadcast(cells.sparkSession.createDataFrame([(k, r["n"], r["m"], r["sd"]) for k, r in known.items()], "k int, n bigint, m double, sd double"))
    ranked = cut.withColumn("inside", inside).join(starts, ["k", SEGMENT]).join(of, "k").withColumn("last", (F.col("offset") + F.col("inside")).cast("double"))
    ranked = ranked.withColumn("first", F.col("last") - F.col("c") + 1).withColumn("z", (F.col("x") - F.col("m")) / F.col("sd"))
    up = F.pow("last", F.lit(2)) - F.pow(F.col("first") - 1, F.lit(2))
    down = F.pow(F.col("n") - F.col("first") + 1, F.lit(2)) - F.pow(F.col("n") - F.col("last"), F.lit(2))
    terms = ranked.groupBy("k").agg(F.sum(up * log_normal_tail(F.col("z")) + down * log_normal_tail(-F.col("z"))).alias("t"))
    found = {r["k"]: -known[r["k"]]["n"] - r["t"] / known[r["k"]]["n"] for r in terms.collect()}
    return {name: found.get(k) for k, name in enumerate(names)}


def anderson_darling(df: DataFrame, column: str, segment_rows: int = SEGMENT_ROWS) -> float | None:
    """The statistic of one column."""
    return anderson_darlings({column: (df, column)}, segment_rows)[column]


def _row(column, metric, before, after, gain, passed):
    return (column, metric, float(before), float(after), float(gain), bool(passed))


SCHEMA = "column_name string, metric string, before double, after double, improvement double, passed boolean"


def statistical_metrics(before: DataFrame, after: DataFrame, columns: list[str], normality: bool = True) -> DataFrame:
    """Normality, variance, outliers and information of each column; text only gets the last.

    Both frames are profiled in shared jobs, and the normality statistics of all columns before and after are computed together.
    """
    pair = {"before": before.select(*columns), "after": after.select(*columns)}
    rows = P.profile(pair).select("table_name", "column_name", "is_numeric", "present", "mean", "std", "outlier_pct", "entropy_bits").collect()
    found = {(r["table_name"], r["column_name"]): r for r in rows}
    out = []
    numbers = [c for c in columns if all(found[t, c]["is_numeric"] and found[t, c]["present"] >= 8 for t in pair)] if normality else []
    normal = anderson_darlings({(t, c): (df, c) for t, df in pair.items() for c in numbers})
    for c in columns:
        b, a = found["before", c], found["after", c]
        if b["is_numeric"] and a["is_numeric"]:
            if c in numbers:
                x, y = normal["before", c], normal["after", c]
                if x is not None and y is not None:
                    out.append(_row(c, "normality", x, y, x - y, y < x))
            cv = [abs(r["std"] / r["mean"]) if r["std"] is not None and abs(r["mean"]) >= 1e-10 else 0.0 for r in (b, a)]
            out.append(_row(c, "variance_stabilization", cv[0], cv[1], cv[0] - cv[1], cv[0] - cv[1] >= CV_GAIN))
            tails = [r["outlier_pct"] if r["present"] >= 4 else 0.0 for r in (b, a)]
            out.append(_row(c, "outlier_reduction", tails[0], tails[1], tails[0] - tails[1], tails[0] - tails[1] >= OUTLIER_GAIN))
        kept = a["entropy_bits"] / b["entropy_bits"] if b["entropy_bits"] > 0 else 1.0
        out.append(_row(c, "information_preservation", b["entropy_bits"], a["entropy_bits"], kept - 1, kept >= INFORMATION_FLOOR))
    return before.sparkSession.createDataFrame(out, SCHEMA)


def statistical_verdict(metrics: DataFrame, floor: float = PASS_SHARE) -> DataFrame:
    share = F.avg(F.col("passed").cast("double"))
    return metrics.groupBy("column_name").agg(share.alias("score"), F.count(F.lit(1)).alias("metrics")).withColumn("passed", F.col("score") >= floor)


def range_check(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The value range must not grow by more than a fifth."""
    def span(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[(F.max(c).cast("double") - F.min(c).cast("double")).alias(c) for c in columns]).select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias(name)) for c in columns])))

    both = span(before, "before").join(span(after, "after"), "column_name")
    growth = F.when(F.col("before") > 0, F.col("after") / F.col("before")).otherwise(F.lit(1.0))
    return both.select("column_name", F.lit("range_preservation").alias("metric"), F.coalesce("before", F.lit(0.0)).alias("before"),
                       F.coalesce("after", F.lit(0.0)).alias("after"), F.coalesce(1 - growth, F.lit(0.0)).alias("improvement"),
                       F.coalesce(growth <= 1 + RANGE_GROWTH, F.lit(True)).alias("passed"))


def semantic_issues(decisions: DataFrame, profile: DataFrame) -> DataFrame:
    """Actions that make no sense for the column they are meant for."""
    joined = decisions.select("table_name", "column_name", "action").join(profile, ["table_name", "column_name"])
    a = F.col("action")
    scaled = F.col("is_numeric") & (F.abs("mean") < 0.1) & (F.abs(F.col("std") - 1) < 0.2)

    def issue(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), text)

    issues = F.array_compact(F.array(
        issue(a.contains("onehot") & (F.col("unique_count") > 50), "one-hot encoding of too many values"),
        issue(a.contains("log") & F.col("is_numeric") & (F.col("min_value") <= 0), "log of non-positive values"),
        issue(a.contains("scale") & scaled, "scaling of scaled data"),
        issue(a.contains("drop") & named("id", "key", "target", "label", "class"), "dropping an important column"),
    ))
    return joined.select("table_name", "column_name", "action", issues.alias("issues"), (F.size(issues) == 0).alias("passed"))


def consistency_verdict(*checks: DataFrame) -> DataFrame:
    """A column is consistent when every check of it passed."""
    rows = checks[0].select("column_name", "passed")
    for c in checks[1:]:
        rows = rows.unionByName(c.select("column_name", "passed"))
    return rows.groupBy("column_name").agg(F.bool_and("passed").alias("consistent"))


def transform_report(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts over the columns of one run: all, processed, validated and passed."""
    joined = steps.join(verdicts.select(F.col("column_name").alias("column"), "passed"), "column", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("success", "fallback")).alias("processed"),
        F.count("passed").alias("validated"), F.count_if("passed").alias("passed"))
