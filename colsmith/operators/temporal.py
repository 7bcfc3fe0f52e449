"""Date parts and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsmith.functions import scalar as S


def moment(c: Column, type_name: str) -> Column:
    return c if S.is_time_type(type_name) else S.to_time(c)


def year_number(c: Column) -> Column:
    return F.year(c).cast("double")


def hour_sine(c: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.hour(c) / 24)


def cycles(c: Column, prefix: str) -> list[Column]:
    """Sine and cosine of the hour of the day and of the month of the year."""
    hour = F.lit(2 * math.pi) * F.hour(c) / 24
    month = F.lit(2 * math.pi) * (F.month(c) - 1) / 12
    return [
        F.sin(hour).alias(f"{prefix}_hour_sin"), F.cos(hour).alias(f"{prefix}_hour_cos"),
        F.sin(month).alias(f"{prefix}_month_sin"), F.cos(month).alias(f"{prefix}_month_cos"),
    ]


PARTS = ("year", "month", "day", "dayofweek", "hour", "minute", "quarter")


def components(c: Column, prefix: str, wanted: tuple[str, ...] = PARTS) -> list[Column]:
    """Calendar parts; Monday is day 0 of the week."""
    parts = {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "dayofweek": F.weekday(c),
        "hour": F.hour(c), "minute": F.minute(c), "quarter": F.quarter(c),
    }
    return [parts[name].alias(f"{prefix}_{name}") for name in wanted]
