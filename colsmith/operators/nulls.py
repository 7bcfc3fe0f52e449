"""Filling of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.operators.ordering import SEGMENT_ROWS, seen, with_position


def column_mode(df: DataFrame, column: str):
    """Most frequent non-null value, the smallest one among ties."""
    top = (
        df.where(F.col(column).isNotNull()).groupBy(column).count()
        .orderBy(F.desc("count"), F.asc(column)).limit(1).collect()
    )
    return top[0][column] if top else None


def fill_forward(df: DataFrame, column: str, order_by: list[str], partition_by: list[str] = (),
                 segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    return seen(df, F.col(column), order_by, column, partition_by, False, segment_rows)


def fill_backward(df: DataFrame, column: str, order_by: list[str], partition_by: list[str] = (),
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    return seen(df, F.col(column), order_by, column, partition_by, True, segment_rows)


def interpolate(df: DataFrame, column: str, order_by: list[str], partition_by: list[str] = (),
                segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Linear by row position; leading nulls stay, trailing ones repeat the last value."""
    placed = with_position(df, order_by, partition_by, "__pos", segment_rows)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("__pos").alias("pos"), F.col(column).cast("double").alias("v")))
    both = seen(placed, known, order_by, "__prev", partition_by, False, segment_rows)
    both = seen(both, known, order_by, "__next", partition_by, True, segment_rows)
    prev, after = F.col("__prev"), F.col("__next")
    slope = (after["v"] - prev["v"]) / (after["pos"] - prev["pos"])
    filled = (
        F.when(F.col(column).isNotNull(), F.col(column).cast("double"))
        .when(after.isNull(), prev["v"])
        .when(prev.isNotNull(), prev["v"] + slope * (F.col("__pos") - prev["pos"]))
    )
    return both.withColumn(column, filled).drop("__pos", "__prev", "__next")
