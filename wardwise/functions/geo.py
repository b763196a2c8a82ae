"""Distances, grid cells and lattices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPHERE_M = 6371000.0
WGS84_A, WGS84_E2 = 6378137.0, 0.0066943799901413165
M_PER_DEGREE = 110574.0  # least metres of a degree of latitude
GOLDEN_ANGLE = 2.399963229728653


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * SPHERE_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_dist_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the spheroid, for short ways: its two radii at the mean latitude."""
    mid = F.radians((lat1 + lat2) / 2)
    w = F.lit(1.0) - F.lit(WGS84_E2) * F.pow(F.sin(mid), 2)
    north = F.lit(WGS84_A * (1 - WGS84_E2)) / F.pow(w, 1.5) * F.radians(lat2 - lat1)
    east = F.lit(WGS84_A) / F.sqrt(w) * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


def lat_step(radius_m: float) -> float:
    """Degrees of latitude that are at least the radius."""
    return radius_m / M_PER_DEGREE * 1.01


def lon_step(radius_m: float, lat: Column) -> Column:
    """Degrees of longitude that are at least the radius up to that latitude, north or south; a whole turn near the poles."""
    k = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat))))
    return F.when(k > lat_step(radius_m) / 360, F.lit(lat_step(radius_m)) / k).otherwise(F.lit(360.0))


def row_step(radius_m: float, row: Column) -> Column:
    """Width in degrees of the cells of a row of cells, by the row's own latitudes and a row's height more."""
    step = lat_step(radius_m)
    return lon_step(radius_m, F.greatest(F.abs(row * step), F.abs((row + 1) * step)) + F.lit(step))


def cell(value: Column, step: float) -> Column:
    return F.floor(value / F.lit(step))


def lattice_offsets(n: int) -> Column:
    """n points of a unit disc with equal areas: array of (i, north, east)."""

    def point(i: Column) -> Column:
        r = F.sqrt((i.cast("double") + F.lit(0.5)) / F.lit(float(n)))
        t = i.cast("double") * F.lit(GOLDEN_ANGLE)
        return F.struct(i.alias("i"), (r * F.sin(t)).alias("north"), (r * F.cos(t)).alias("east"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def walk_minutes(metres: Column) -> Column:
    from wardwise import config

    return F.ceil(metres * F.lit(config.DETOUR) / F.lit(config.WALK_M_PER_MIN)).cast("double")
