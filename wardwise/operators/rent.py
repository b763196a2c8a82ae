"""Land-price multiplier, choice of the rent statistic and the rent estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.numbers import clamp, half_up, lower_confidence
from wardwise.functions.times import year_of


def usable_medians(near_median: Column, ward_median: Column, points: Column) -> Column:
    return F.coalesce((points >= config.MIN_LAND_POINTS) & (near_median > 0) & (ward_median > 0), F.lit(False))


def multiplier(near_median: Column, ward_median: Column, points: Column) -> Column:
    ratio = F.pow(near_median / ward_median, F.lit(config.MULTIPLIER_POWER))
    return F.when(usable_medians(near_median, ward_median, points), clamp(ratio, config.MULTIPLIER_MIN, config.MULTIPLIER_MAX)).otherwise(F.lit(1.0))


def rent_choice(stats: DataFrame, as_of_year: int) -> DataFrame:
    """Of each ward's statistics (ward, source, period, rent_per_sqm, fee): the newest of one source if recent, else of the other.

    ``base_confidence`` is 0 to 2. Wards with neither are left out.
    """
    newest = stats.groupBy("ward", "source").agg(F.max(F.struct("period", "rent_per_sqm", "fee")).alias("m")).select("ward", "source", "m.*")
    age = F.lit(as_of_year) - year_of(F.col("period"))
    fits = (F.col("source") == "estat") | ((F.col("source") == "reins") & (age <= config.RECENT_YEARS))
    first = F.when(F.col("source") == "reins", 1).otherwise(0)
    best = newest.where(fits).groupBy("ward").agg(F.max(F.struct(first.alias("p"), "source", "period", "rent_per_sqm", "fee")).alias("m")).select("ward", "m.source", "m.period", "m.rent_per_sqm", "m.fee")
    base = F.when(F.col("source") == "reins", 2).when(age > config.OLD_YEARS, 0).otherwise(1)
    return best.withColumn("base_confidence", base)


def layouts(spark) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in config.LAYOUTS.items()], "layout string, min_sqm double, max_sqm double, mid_sqm double")


def estimates(areas: DataFrame, as_of_year: int) -> DataFrame:
    """Low, middle and high rent for each layout. areas: any columns with rent_per_sqm, fee, multiplier, fallback, base_confidence, period."""
    a = areas.crossJoin(F.broadcast(layouts(areas.sparkSession)))

    def rent(sqm: str, factor: float) -> Column:
        return half_up(F.col("rent_per_sqm") * F.col(sqm) * F.lit(factor) * F.col("multiplier") + F.col("fee"))

    steps = F.col("fallback").cast("int") + (F.lit(as_of_year) - year_of(F.col("period")) > config.RECENT_YEARS).cast("int")
    middle = half_up(F.col("rent_per_sqm") * F.col("mid_sqm") * F.col("multiplier") + F.col("fee"))
    return a.withColumn("low_yen", rent("min_sqm", config.LOW_FACTOR)).withColumn("median_yen", middle).withColumn("high_yen", rent("max_sqm", config.HIGH_FACTOR)).withColumn("confidence", lower_confidence(F.col("base_confidence"), steps))
