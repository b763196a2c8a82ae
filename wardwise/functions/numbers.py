"""Roundings and clamps; each rounding is a different one on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def half_even(x: Column) -> Column:
    return F.rint(x)


def one_decimal(x: Column) -> Column:
    return F.floor(x * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, which ``least`` and ``greatest`` alone would skip."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def tsubo_to_sqm(price: Column) -> Column:
    from wardwise import config

    return half_up(price / F.lit(config.TSUBO_SQM))


def in_range(x: Column, bounds: tuple[float, float]) -> Column:
    return x.between(*bounds)


def lower_confidence(c: Column, steps: Column | int = 1) -> Column:
    """Confidence as 0 (low) to 2 (high)."""
    return F.greatest(c - steps, F.lit(0))


def confidence_name(c: Column) -> Column:
    return F.when(c == 2, "high").when(c == 1, "medium").otherwise("low")


def yen(x: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(x, 0))
