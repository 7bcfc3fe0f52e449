"""Category encoders: a dictionary per column, then a lookup join.

Dictionaries of up to ``BROADCAST_ROWS`` entries are fetched once and broadcast; larger ones
are checkpointed and joined by shuffle, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import scalar as S
from colsmith.operators.ordering import ranked_dictionary
from colsmith.session import BROADCAST_ROWS, checkpoint

ONE_HOT_LIMIT = 50


@dataclass
class Dictionary:
    """Distinct values with a number each; ``size`` is exact up to the broadcast bound."""

    table: DataFrame  # (value, <number columns>)
    size: int
    small: bool

    def values(self) -> list[str]:
        return [r["value"] for r in self.table.orderBy("value").collect()] if self.small else []

    def lookup(self, df: DataFrame, column: str, number: str, out: str) -> DataFrame:
        side = self.table.select(F.col("value").alias("__value"), F.col(number).alias("__number"))
        side = F.broadcast(side) if self.small else side
        joined = df.join(side, df[column].cast("string") == side["__value"], "left")
        if out == column:
            return joined.withColumn(column, F.col("__number")).drop("__value", "__number")
        return joined.withColumnRenamed("__number", out).drop("__value")


def _settle(counts: DataFrame, limit: int) -> Dictionary:
    """Fetch a small dictionary, or pin a large one in the checkpoint folder."""
    head = counts.limit(limit + 1).collect()
    if len(head) <= limit:
        return Dictionary(counts.sparkSession.createDataFrame(head, counts.schema), len(head), True)
    fixed = checkpoint(counts)
    return Dictionary(fixed, fixed.count(), False)


def count_dictionary(df: DataFrame, column: str, limit: int = BROADCAST_ROWS) -> Dictionary:
    """(value, n, share of the non-null rows, code by value order)."""
    value = F.col(column).cast("string").alias("value")
    counts = df.where(F.col(column).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    base = _settle(counts, limit)
    total = base.table.agg(F.sum("n").alias("t")).first()["t"] or 0
    shared = base.table.withColumn("share", F.col("n") / F.lit(float(total or 1)))
    coded = ranked_dictionary(shared, "value", "code", limit, base.size)
    return Dictionary(coded, base.size, base.small)


class Counted:
    """Value counts of several columns from one job, with the target's mean beside each if one is named; dictionaries are made from them on demand."""

    def __init__(self, df: DataFrame, columns: list[str], limit: int = BROADCAST_ROWS, target: str | None = None):
        cells = [F.struct(F.lit(i).alias("k"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]
        aim = [F.col(f"`{target}`").alias("aim")] if target else []
        long = df.select(*aim, F.inline(F.array(*cells))).where(F.col("value").isNotNull())
        means = [F.avg("aim").alias("mean")] if target else []
        self._counts = checkpoint(long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"), *means))
        self._place, self._limit = {c: i for i, c in enumerate(columns)}, limit
        self._facts = {r["k"]: r for r in self._counts.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).collect()}

    def size(self, column: str) -> int:
        """Distinct non-null values."""
        found = self._facts.get(self._place[column])
        return found["size"] if found else 0

    def dictionary(self, column: str) -> Dictionary:
        k, size = self._place[column], self.size(column)
        total = float(self._facts[k]["total"]) if size else 1.0
        own = self._counts.where(F.col("k") == k).select("value", "n", (F.col("n") / F.lit(total)).alias("share"))
        if size > self._limit:
            return Dictionary(ranked_dictionary(own, "value", "code", self._limit, size), size, False)
        rows = sorted(own.collect(), key=lambda r: r["value"])
        table = own.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], "value string, n long, share double, code long")
        return Dictionary(table, size, True)

    def means(self, column: str) -> Dictionary:
        """Mean target per value."""
        own, size = self._counts.where(F.col("k") == self._place[column]).select("value", "mean"), self.size(column)
        if size > self._limit:
            return Dictionary(own, size, False)
        return Dictionary(own.sparkSession.createDataFrame(own.collect(), own.schema), size, True)


def target_dictionary(df: DataFrame, column: str, target: str, limit: int = BROADCAST_ROWS) -> Dictionary:
    value = F.col(column).cast("string").alias("value")
    means = df.where(F.col(column).isNotNull()).groupBy(value).agg(F.avg(target).alias("mean"))
    return _settle(means, limit)


def label_encode(df: DataFrame, column: str, dictionary: Dictionary | None = None, out: str | None = None):
    d = dictionary or count_dictionary(df, column)
    return d.lookup(df, column, "code", out or column)


def ordinal_encode(df: DataFrame, column: str, order: list[str] | None = None,
                   dictionary: Dictionary | None = None, out: str | None = None):
    """Codes by sorted or given order; unknown and null values get -1."""
    out = out or column
    if order:
        pairs = [x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]
        code = F.create_map(*pairs)[F.col(column).cast("string")].cast("bigint")
        return df.withColumn(out, F.coalesce(code, F.lit(-1).cast("bigint")))
    d = dictionary or count_dictionary(df, column)
    coded = d.lookup(df, column, "code", out)
    return coded.withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("bigint")))


def frequency_encode(df: DataFrame, column: str, dictionary: Dictionary | None = None, out: str | None = None):
    out = out or column
    d = dictionary or count_dictionary(df, column)
    coded = d.lookup(df, column, "share", out)
    return coded.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def one_hot(df: DataFrame, column: str, values: list[str], keep: bool = False) -> DataFrame:
    """One 0/1 column per value, named ``<column>_<value>``; nulls give zeros."""
    text = F.col(column).cast("string")
    flags = [F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]
    others = [F.col(f"`{c}`") for c in df.columns if keep or c != column]
    return df.select(*others, *flags)


def target_encode(df: DataFrame, column: str, target: str, dictionary: Dictionary | None = None,
                  overall: float | None = None, out: str | None = None) -> DataFrame:
    """Mean target per category; values without one get the overall mean."""
    out = out or column
    if overall is None:
        overall = df.agg(F.avg(target).alias("m")).first()["m"]
    d = dictionary or target_dictionary(df, column, target)
    coded = d.lookup(df, column, "mean", out)
    return coded.withColumn(out, F.coalesce(F.col(out), F.lit(overall)))


def target_encode_folds(df: DataFrame, column: str, target: str, key: Column, folds: int = 5,
                        out: str | None = None) -> DataFrame:
    """Out-of-fold target means: a row never sees the target values of its own fold.

    Sums per (category, fold) are pre-aggregated, so the join side has at most
    ``folds`` rows per category.
    """
    out = out or column
    tagged = df.withColumn("__fold", S.stable_bucket(key, folds))
    value = F.col(column).cast("string")
    cells = tagged.groupBy(value.alias("__value"), F.col("__fold").alias("__f")).agg(
        F.sum(target).alias("__s"), F.count(target).alias("__c")
    )
    totals = cells.groupBy("__value").agg(F.sum("__s").alias("__ts"), F.sum("__c").alias("__tc"))
    outside = cells.join(totals, "__value").select(
        "__value", "__f", ((F.col("__ts") - F.col("__s")) / F.nullif(F.col("__tc") - F.col("__c"), F.lit(0))).alias("__m")
    )
    overall = df.agg(F.avg(target).alias("m")).first()["m"]
    joined = tagged.join(
        outside, (value == outside["__value"]) & (F.col("__fold") == outside["__f"]), "left"
    )
    return joined.withColumn(out, F.coalesce(F.col("__m"), F.lit(overall))).drop("__value", "__f", "__m", "__fold")
