"""Per-station and per-locality metrics: counts, shares, normalised scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.numbers import clamp
from wardwise.functions.times import late_night


def amenity_aggregates() -> tuple[dict[str, Column], dict[str, Column]]:
    """Counts over points with category, cuisine and opening_hours, for ``near_by_place``: those of a place are added up; cuisines
    are a set at each place, whose union is counted."""
    kinds = ("supermarket", "grocery", "convenience", "restaurant", "cafe", "bar", "health")
    here = {f"n_{k}": F.count_if(F.col("category") == k) for k in kinds}
    food = F.col("category").isin(*config.FOOD)
    over = {n: F.sum(n) for n in here}
    here |= {"cuisines": F.collect_set(F.when(food, F.col("cuisine"))), "n_late": F.count_if(food & late_night(F.col("opening_hours")))}
    return here, over | {"n_cuisines": F.size(F.array_distinct(F.flatten(F.collect_list("cuisines")))).cast("long"), "n_late": F.sum("n_late")}


def shop_score(supermarket: Column, grocery: Column, convenience: Column) -> Column:
    w = config.SHOP_WEIGHTS
    return supermarket * w["supermarket"] + grocery * w["grocery"] + convenience * w["convenience"]


def min_max(df: DataFrame, columns: list[str], prefix: str = "norm_") -> DataFrame:
    """Each column on 0 to 100 between its least and largest value; a constant one is 50; nulls stay."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        norm = F.when(hi == lo, F.lit(50.0)).otherwise(clamp(F.lit(100.0) * (F.col(c) - lo) / (hi - lo), 0.0, 100.0))
        out = out.withColumn(prefix + c, F.when(F.col(c).isNotNull(), norm))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def sufficiency(x: Column, target: float) -> Column:
    return F.least(F.lit(100.0), F.lit(100.0) * F.log1p(x) / F.log1p(F.lit(target)))


def quietness(residential: Column, exposure: Column, nightlife: Column) -> Column:
    """nightlife: its density on 0 to 1."""
    a, b, c = config.QUIET_WEIGHTS
    return F.lit(a) * residential + F.lit(b) * (1 - exposure) + F.lit(c) * (1 - nightlife)


def locality_quietness(residential: Column, exposure: Column, bars: Column) -> Column:
    return F.lit(100.0) * quietness(residential, exposure, F.least(F.lit(1.0), F.log1p(bars) / F.log1p(F.lit(config.NIGHTLIFE_TARGET))))


def median_of_sorted(values: Column) -> Column:
    """Median of an array of numbers in order, null of an empty one; between the two in the middle as ``percentile``."""
    n = F.size(values)
    at = lambda k: F.get(values, F.floor(k).cast("int"))
    return F.when(n % 2 == 1, at(n / 2)).when(n > 0, 0.5 * at(n / 2 - 1) + 0.5 * at(n / 2))


def medians_of_medians(points: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Median of each inner group's median, and of the inner groups' counts."""
    inside = points.groupBy(outer, inner).agg(F.percentile(value, 0.5).alias("m"), F.count(value).alias("n"))
    return inside.groupBy(outer).agg(F.percentile("m", 0.5).alias("median"), F.percentile("n", 0.5).alias("median_count"))
