"""Exact quantiles and value-to-bucket edges that hold for columns of any length.

Spark's ``percentile`` keeps every distinct value of a column in one task, which is fine
for a few million rows and impossible for a trillion. Short columns use it; long columns
are narrowed first: an approximate quantile gives a bracket, a count proves that the wanted
ranks lie inside it, and only the rows of the last bracket are ordered. Where the values are
counted already, counts in equal steps take the place of the approximate quantile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.operators import packed

DIRECT_ROWS = 2_000_000
ACCURACY = 10_000
STEPS = 1024  # between the least and the greatest value of a column, to find where its ranks lie
MANY = 16  # above this many quantiles of one long column, order its distinct values once


@dataclass
class _Bracket:
    column: str
    prob: float
    low_rank: int
    high_rank: int
    fraction: float
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    slack: float = 3.0 / ACCURACY

    def condition(self) -> Column:
        value = F.col(self.column)
        if self.low is None:
            return value.isNotNull()
        return value.between(self.low, self.high)

    def holds(self, below: int, inside: int) -> bool:
        return below <= self.low_rank and self.high_rank < below + inside


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    counts: dict[str, int] | None = None,
    direct_rows: int = DIRECT_ROWS,
    held: tuple[DataFrame, dict[str, tuple]] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns, nulls left out.

    ``counts`` are the non-null counts if the caller already has them. ``held`` are the packed counts of the values, with the number, the
    kind, the least and the greatest value of each column; then no row is read, and columns whose values lie too close together are left out.
    """
    if not wanted:
        return {}
    if held and counts:
        return stepped_quantiles(*held, wanted, counts, direct_rows)
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    if counts is None:
        row = numeric.agg(*[F.count(c).alias(c) for c in wanted]).first()
        counts = {c: row[c] for c in wanted}

    result: dict[str, list[float | None]] = {c: [None] * len(p) for c, p in wanted.items()}
    short = [c for c in wanted if 0 < counts[c] <= direct_rows]
    if short:
        row = numeric.agg(
            *[F.percentile(c, [float(p) for p in wanted[c]]).alias(c) for c in short]
        ).first()
        for c in short:
            result[c] = list(row[c])

    brackets = []
    for c in wanted:
        if counts[c] <= direct_rows:
            continue
        if len(wanted[c]) > MANY:
            result[c] = _sorted_quantiles(numeric, c, wanted[c], counts[c], direct_rows)
            continue
        for p in wanted[c]:
            position = (counts[c] - 1) * p
            low = int(math.floor(position))
            high = min(low + 1, counts[c] - 1)
            brackets.append(_Bracket(c, p, low, high, position - low, inside=counts[c]))
    if brackets:
        values = _order_statistics(numeric, brackets, direct_rows)
        for b, (lo, hi) in zip(brackets, values):
            result[b.column][wanted[b.column].index(b.prob)] = lo + (hi - lo) * b.fraction
    return result


def stepped_quantiles(values: DataFrame, ends: dict[str, tuple], wanted: dict[str, list[float]], counts: dict[str, int], direct_rows: int) -> dict[str, list[float]]:
    """Quantiles from packed counts of the values, of columns that spread; ``ends`` has the number of each column, whether it holds doubles, its least and greatest value.

    Counts in equal steps from the least to the greatest value tell which steps hold the wanted ranks; only the values there are ordered.
    """
    found = {c: [e[2]] * len(wanted[c]) for c, e in ends.items() if counts[c] and None not in e and e[2] == e[3]}
    wide = {c: e for c, e in ends.items() if counts[c] and None not in e and 0 < e[3] - e[2] < math.inf}
    if not wide:
        return found
    spark, names = values.sparkSession, {e[0]: c for c, e in wide.items()}
    sizes = {k: (real, low, high - low) for k, real, low, high in wide.values()}
    steps: dict[str, list] = {c: [] for c in wide}
    for r in packed.step_counts(values, sizes, STEPS).collect():
        steps[names[r["k"]]].append((r["step"], r["n"], r["size"]))
    asked, fractions = [], {}
    for c, (k, *_) in wide.items():
        own = []
        held = sorted(steps[c])
        for i, p in enumerate(wanted[c]):
            position = (counts[c] - 1) * p
            low = int(math.floor(position))
            high, before, inside = min(low + 1, counts[c] - 1), 0, []
            for at, n, size in held:
                if before + n > low and before <= high:
                    inside.append((at, before, size))
                before += n
            fractions[k, i] = position - low
            if sum(size for _, _, size in inside) <= direct_rows:
                own.append((k, i, inside[0][0], inside[-1][0], low - inside[0][1], high - inside[0][1]))
        asked += own if len(own) == len(wanted[c]) else []
    if not asked:
        return found
    side = spark.createDataFrame([(k, i, low, high) for k, i, _, _, low, high in asked], "k int, i int, low bigint, high bigint")
    stretches: dict[int, list] = {}
    for k, i, first, last, _, _ in asked:
        stretches.setdefault(k, []).append((i, first, last))
    running = W.partitionBy("k", "i").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    upto = packed.step_values(values, sizes, STEPS, stretches).withColumn("upto", F.sum("n").over(running)).join(F.broadcast(side), ["k", "i"])

    def at_rank(rank: str) -> Column:
        return F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("x")))

    found |= {c: [None] * len(wanted[c]) for c in {names[a[0]] for a in asked}}
    for r in upto.groupBy("k", "i").agg(at_rank("low").alias("lo"), at_rank("high").alias("hi")).collect():
        found[names[r["k"]]][r["i"]] = r["lo"] + (r["hi"] - r["lo"]) * fractions[r["k"], r["i"]]
    return found


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> None:
    """One narrowing round: approximate cut points, then counts that prove them."""
    probs, places = {}, []  # brackets over the same values share one summary of them
    for b in brackets:
        centre = (b.low_rank - b.below + 0.5) / b.inside
        asked = probs.setdefault((b.column, b.low, b.high), (b, []))[1]
        places.append(((b.column, b.low, b.high), len(asked)))
        asked += [max(0.0, centre - b.slack), min(1.0, centre + b.slack)]
    row = df.agg(*[F.percentile_approx(F.when(b.condition(), F.col(b.column)), asked, ACCURACY).alias(f"q{j}")
                   for j, (b, asked) in enumerate(probs.values())]).first()
    order = {key: j for j, key in enumerate(probs)}
    found = [row[f"q{order[key]}"][at:at + 2] for key, at in places]
    tests = []
    for i, b in enumerate(brackets):
        lo, hi = found[i]
        value = F.col(b.column)
        tests.append(F.count_if(value < lo).alias(f"below{i}"))
        tests.append(F.count_if(value.between(lo, hi)).alias(f"inside{i}"))
    proof = df.agg(*tests).first()
    for i, b in enumerate(brackets):
        below, inside = proof[f"below{i}"], proof[f"inside{i}"]
        if b.holds(below, inside) and inside < b.inside:
            b.low, b.high = found[i]
            b.below, b.inside = below, inside
        else:
            b.slack *= 8


def _order_statistics(df: DataFrame, brackets: list[_Bracket], direct_rows: int):
    """The two neighbouring order statistics of every bracket."""
    while True:
        open_brackets = [
            b for b in brackets
            if b.inside > direct_rows and b.slack < 1 and (b.low is None or b.low < b.high)
        ]
        if not open_brackets:
            break
        _narrow(df, open_brackets)
    entries = [
        F.when(b.condition(), F.struct(F.lit(i).alias("bracket"), F.col(b.column).alias("value")))
        for i, b in enumerate(brackets)
    ]
    counted = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.bracket", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = W.partitionBy("bracket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("n").over(running))
    first = F.create_map(*[x for i, b in enumerate(brackets)
                           for x in (F.lit(i), F.lit(b.low_rank - b.below))])[F.col("bracket")]
    second = F.create_map(*[x for i, b in enumerate(brackets)
                            for x in (F.lit(i), F.lit(b.high_rank - b.below))])[F.col("bracket")]

    def covers(rank: Column) -> Column:
        return (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)

    rows = (
        upto.groupBy("bracket")
        .agg(
            F.max(F.when(covers(first), F.col("value"))).alias("lo"),
            F.max(F.when(covers(second), F.col("value"))).alias("hi"),
        )
        .collect()
    )
    found = {r["bracket"]: (r["lo"], r["hi"]) for r in rows}
    return [found[i] for i in range(len(brackets))]


def _sorted_quantiles(df: DataFrame, column: str, probs: list[float], n: int, segment_rows: int):
    """Many quantiles of one long column from its value counts, ordered segment by segment."""
    from colsmith.operators.ordering import SEGMENT, with_segments

    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    cut, _ = with_segments(counted, ["value"], segment_rows)
    totals = {r[SEGMENT]: r["t"] for r in cut.groupBy(SEGMENT).agg(F.sum("n").alias("t")).collect()}
    ranks = set()
    for p in probs:
        low = int(math.floor((n - 1) * p))
        ranks |= {low, min(low + 1, n - 1)}
    wanted, start = [], 0
    for segment in sorted(totals):
        wanted += [(segment, r - start, r) for r in ranks if start <= r < start + totals[segment]]
        start += totals[segment]
    side = F.broadcast(df.sparkSession.createDataFrame(wanted, f"{SEGMENT} int, local bigint, rank bigint"))
    frame = W.partitionBy(SEGMENT).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    upto = cut.withColumn("upto", F.sum("n").over(frame))
    hits = upto.join(side, SEGMENT).where(
        (F.col("upto") > F.col("local")) & (F.col("upto") - F.col("n") <= F.col("local")))
    found = {r["rank"]: r["value"] for r in hits.select("rank", "value").collect()}
    values = []
    for p in probs:
        position = (n - 1) * p
        low = int(math.floor(position))
        lo, hi = found[low], found[min(low + 1, n - 1)]
        values.append(lo + (hi - lo) * (position - low))
    return values


def range_edges(df: DataFrame, key: Column, buckets: int) -> list[float]:
    """Interior cut points that split a numeric key into buckets of about equal size."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    accuracy = max(ACCURACY, 20 * buckets)
    cuts = df.agg(F.percentile_approx(key, probs, accuracy).alias("q")).first()["q"] or []
    return sorted({float(v) for v in cuts})
