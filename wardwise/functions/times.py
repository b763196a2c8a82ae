"""Times of timetables, periods and opening hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardwise import config


def gtfs_minutes(text: Column) -> Column:
    """Minutes of HH:MM:SS; hours may pass 24; anything else is null."""
    good = text.rlike("^\\s*\\d{1,2}:[0-5]\\d:[0-5]\\d\\s*$")
    p = F.split(F.trim(text), ":")
    return F.when(good, F.get(p, F.lit(0)).try_cast("double") * 60 + F.get(p, F.lit(1)).try_cast("double") + F.get(p, F.lit(2)).try_cast("double") / 60)


def is_peak(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(1440.0))
    return (m >= config.PEAK_START_MIN) & (m < config.PEAK_END_MIN)


def period(minutes: Column) -> Column:
    return F.when(is_peak(minutes), "peak").otherwise("offpeak")


def clock_minutes(text: Column) -> Column:
    """Minutes of HH:MM."""
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).try_cast("double") * 60 + F.get(p, F.lit(1)).try_cast("double")


def late_night(hours: Column) -> Column:
    """Open all day or until 23:00 or later, and not marked as off; null stays null."""
    return ~hours.rlike("(?i)\\boff\\b") & ((hours == "24/7") | hours.rlike("-2[3-9]:[0-5][0-9]"))


def year_of(stat_period: Column) -> Column:
    return F.substring(stat_period, 1, 4).try_cast("int")


def is_workday(yyyymmdd: Column) -> Column:
    return F.weekday(F.try_to_timestamp(yyyymmdd, F.lit("yyyyMMdd"))) < 5
