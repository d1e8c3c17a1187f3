"""Percentages, rates and other guarded arithmetic used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    value = F.coalesce(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def rate(count: Column, seconds: Column) -> Column:
    """Events per second; 0 when the duration is not positive."""
    return F.when(seconds > 0, count.cast("double") / seconds.cast("double")).otherwise(F.lit(0.0))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
