"""Order-dependent building blocks that stay distributed.

A window over a whole table, or over one very large key, would sort everything in one task.
Here the order key is cut into range segments of bounded size first; windows run inside a
segment and a small per-segment summary carries state across the borders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.session import checkpoint

SEGMENT_ROWS = 4_000_000
SEGMENT = "__segment"


def with_segments(
    df: DataFrame, order_by: list[str], segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, bool]:
    """Add a segment number that grows with the whole tuple of order columns.

    Rows with equal tuples have no order of their own, so a random number splits them, too, and no
    segment is much larger than ``segment_rows``. The flag tells whether everything fits into one segment.
    """
    pieces = math.ceil(df.count() / segment_rows)
    if pieces <= 1:
        return df.withColumn(SEGMENT, F.lit(0)), True
    spread = df.withColumn("__tie", F.rand(11)).repartitionByRange(pieces, *order_by, "__tie").drop("__tie")
    # Partition numbers must not move between the uses that follow.
    return checkpoint(spread.withColumn(SEGMENT, F.spark_partition_id())), False


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"__r_{k}"])
    return condition


def _join_summary(df: DataFrame, summary: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    renamed = summary.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *keep)
    return df.join(renamed, _null_safe(df, renamed, keys), "left").drop(*[f"__r_{k}" for k in keys])


def with_position(
    df: DataFrame, order_by: list[str], partition_by: list[str] = (), out: str = "position",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Row number from 1 per partition, without a single-task sort."""
    parts = list(partition_by)
    cut, single = (df, False) if SEGMENT in df.columns else with_segments(df, order_by, segment_rows)
    keys = [*parts, SEGMENT]
    local = cut.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)).cast("bigint"))
    if single:
        return local.drop(SEGMENT)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    before = W.partitionBy(*parts).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    joined = _join_summary(local, offsets, keys, ["__offset"])
    return joined.withColumn(out, F.col(out) + F.col("__offset")).drop("__offset", SEGMENT)


def seen(
    df: DataFrame, value: Column, order_by: list[str], out: str, partition_by: list[str] = (),
    backward: bool = False, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Last non-null value up to the row (or the next one from the row on, ``backward``)."""
    parts = list(partition_by)
    tagged = df.withColumn("__value", value)
    cut, single = with_segments(tagged, order_by, segment_rows)
    keys = [*parts, SEGMENT]
    frame = W.partitionBy(*keys).orderBy(*order_by)
    if backward:
        local = F.first("__value", ignorenulls=True).over(frame.rowsBetween(0, W.unboundedFollowing))
    else:
        local = F.last("__value", ignorenulls=True).over(frame.rowsBetween(W.unboundedPreceding, 0))
    filled = cut.withColumn(out, local)
    if single:
        return filled.drop("__value", SEGMENT)
    position = F.struct(*order_by)
    pick = F.min_by if backward else F.max_by
    edge = cut.where(F.col("__value").isNotNull()).groupBy(*keys).agg(
        pick("__value", position).alias("__edge")
    )
    # Every (partition, segment) pair needs a row to receive the carried value.
    grid = cut.select(*keys).distinct()
    edge = _join_summary(grid, edge, keys, ["__edge"])
    across = W.partitionBy(*parts).orderBy(SEGMENT)
    if backward:
        carried = F.first("__edge", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing))
    else:
        carried = F.last("__edge", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1))
    joined = _join_summary(filled, edge.withColumn("__carry", carried), keys, ["__carry"])
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("__carry"))).drop("__value", "__carry", SEGMENT)


def with_lags(
    df: DataFrame, value: str, lags: list[int], order_by: list[str], partition_by: list[str] = (),
    chunk_rows: int = SEGMENT_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Columns ``lag_<k>`` and ``position``; chunks of rows overlap by the longest lag."""
    parts = list(partition_by)
    placed = with_position(df, order_by, parts, "position", segment_rows)
    longest = max(lags)
    chunk = F.floor((F.col("position") - 1) / chunk_rows)
    tail = (F.col("position") - 1) % chunk_rows >= chunk_rows - longest
    copies = placed.withColumn("__home", chunk).withColumn(
        "__chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    frame = W.partitionBy(*parts, "__chunk").orderBy("position")
    for k in lags:
        copies = copies.withColumn(f"lag_{k}", F.lag(value, k).over(frame))
    return copies.where(F.col("__home") == F.col("__chunk")).drop("__home", "__chunk")


def ranked_dictionary(values: DataFrame, key: str, out: str, small: int, size: int) -> DataFrame:
    """Codes 0..k-1 by value order for a table of distinct values."""
    if size <= small:
        return values.withColumn(out, F.row_number().over(W.orderBy(key)).cast("bigint") - 1)
    placed = with_position(values, [key], [], out, min(SEGMENT_ROWS, small))
    return placed.withColumn(out, F.col(out) - 1)
