"""Timetable feeds: files with given schemas, weekday services, wanted trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.functions.geo import haversine_m
from wardwise.functions.text import station_key
from wardwise.functions.times import gtfs_minutes, is_workday
from wardwise.operators.spatial import near

FILES = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string",
    "routes": "route_id string, route_short_name string, route_long_name string",
    "trips": "trip_id string, route_id string, service_id string",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
}
OPTIONAL = ("calendar", "calendar_dates")


def feed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file of a feed by its columns' names, whatever their order; optional ones may be missing."""
    from pyspark.errors import AnalysisException

    schema = spark.createDataFrame([], FILES[name]).schema
    try:
        raw = spark.read.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
    except AnalysisException:
        if name in OPTIONAL:
            return spark.createDataFrame([], schema)
        raise
    there = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{there[f.name]}`") if f.name in there else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema])


def weekday_services(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """Services of every weekday Monday to Friday, and those that only the added dates know, if on workdays."""
    days = [F.col(d) == 1 for d in ("monday", "tuesday", "wednesday", "thursday", "friday")]
    all_days = days[0]
    for d in days[1:]:
        all_days = all_days & d
    added = dates.where(F.col("exception_type") == 1).where(is_workday(F.col("date"))).select("service_id").distinct().join(calendar, "service_id", "left_anti")
    return calendar.where(all_days).select("service_id").unionByName(added).distinct()


def wanted_times(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop times of those trips, in minutes; times that cannot be read stay null."""
    t = stop_times.join(trips.select("trip_id").distinct(), "trip_id", "left_semi")
    return t.select("trip_id", F.col("stop_id").alias("stop"), "stop_sequence", gtfs_minutes(F.col("arrival_time")).alias("arrival"), gtfs_minutes(F.col("departure_time")).alias("departure"))


def matched_stops(stops: DataFrame, stations: DataFrame, known: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """The station of each stop: known before, else of the same name and nearest within the radius; platforms follow their parent."""
    top = stops.select("stop_id", F.coalesce(F.nullif("parent_station", F.lit("")), "stop_id").alias("top_id"))
    s = stops.join(top.select("top_id").distinct().withColumnRenamed("top_id", "stop_id"), "stop_id", "left_semi")
    a = s.select(F.col("stop_id").alias("anchor_id"), station_key(F.col("stop_name")).alias("key"), F.col("stop_lon").alias("alon"), F.col("stop_lat").alias("alat")).where("alon is not null and alat is not null")
    p = stations.select(F.col("id").alias("station"), F.col("name_key"), "lon", "lat")
    close = near(a, p, radius_m * 1.01, haversine_m).where((F.col("key") == F.col("name_key")) & (F.col("dist_m") <= radius_m)).groupBy("anchor_id").agg(F.min(F.struct("dist_m", "station"))["station"].alias("near"))
    own = s.select(F.col("stop_id").alias("top_id")).join(known.select(F.col("source_id").alias("top_id"), F.col("station").alias("known")), "top_id", "left").join(close.withColumnRenamed("anchor_id", "top_id"), "top_id", "left")
    return top.join(own.select("top_id", F.coalesce("known", "near").alias("station")), "top_id", "left").select("stop_id", "station")


def mapped_routes(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """The line of each route: the same id, else the first line that shares a name. lines: line, names."""
    by_id = lines.select(F.col("line").alias("route_id"), F.col("line").alias("by_id"))
    names = F.filter(F.array_distinct(F.array(F.lower(F.trim("route_short_name")), F.lower(F.trim("route_long_name")))), lambda x: x.isNotNull() & (x != ""))
    listed = lines.select("line", F.explode(F.transform("names", lambda x: F.lower(F.trim(x)))).alias("n"))
    by_name = routes.select("route_id", F.explode(names).alias("n")).join(listed, "n").groupBy("route_id").agg(F.min("line").alias("by_name"))
    return routes.select("route_id").join(by_id, "route_id", "left").join(by_name, "route_id", "left").select("route_id", F.coalesce("by_id", "by_name").alias("line"))
