"""Queries that write the given tables as the files of open-data feeds and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardwise.sources import maps, tabular, timetable
from wardwise.sources.shared import shared_folder

from . import adapters as A
from . import queries as Q

BLOCK = 1000  # features of a file


def _folder(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def stations_read(s, d):
    """Stations written as GeoJSON collections, of the city only, as they are read."""
    st = A.stations(s, d).select(F.col("id").cast("string").alias("id"), "name", "lon", "lat", F.floor(F.col("id") / BLOCK).alias("b"))
    path = _folder(s, "geojson")
    maps.in_collections(maps.as_features(st, maps.point_geometry(F.col("lon"), F.col("lat")), "id", "name", also=("b",)), F.col("b")).write.partitionBy("block").text(path)
    rows = maps.station_rows(maps.features(s, path))
    return Q._round(rows.where(maps.in_city(F.col("lon"), F.col("lat"))).select("id", "name", "lon", "lat"), "lon", "lat")


def map_elements_read(s, d):
    """Customers as shops, the wards' diagonals as roads and the wards as parks, written as map elements and classified."""
    seg = F.col("c_mktsegment")
    k = F.col("c_custkey")
    tag = lambda *kv: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]), lambda _, v: v.isNotNull())
    place = tag("name", F.col("c_name"), "shop", F.when(seg == "AUTOMOBILE", "supermarket").when(seg == "BUILDING", "bakery"), "amenity", F.when(seg == "MACHINERY", "cafe").when(seg == "HOUSEHOLD", "pharmacy"))
    vertex = lambda x, y: F.struct(y.alias("lat"), x.alias("lon"))
    none = F.lit(None)
    geometry = "array<struct<lat: double, lon: double>>"
    nodes = A.table(s, d, "customer").select(F.lit("node").alias("type"), k.alias("id"), F.when(k % 9 != 0, A.lat_of(k)).alias("lat"), F.when(k % 9 != 0, A.lon_of(k)).alias("lon"), none.cast(geometry).alias("geometry"), place.alias("tags"))
    lines = Q._grid_lines(s, d).select(F.lit("way").alias("type"), F.col("line_id").cast("long").alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.array(vertex(F.col("x1"), F.col("y1")), vertex(F.col("x2"), F.col("y2"))).cast(geometry).alias("geometry"), tag("highway", "primary").alias("tags"))
    parks = A.ward_rings(s, d).select(F.lit("way").alias("type"), F.col("region_id").cast("long").alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.transform("ring", lambda p: vertex(p["lon"], p["lat"])).cast(geometry).alias("geometry"), tag("leisure", "park").alias("tags"))
    every = nodes.unionByName(lines).unionByName(parks)
    blocks = every.groupBy(F.floor(F.col("id") / BLOCK).cast("string").alias("block")).agg(F.array_join(F.collect_list(F.to_json(F.struct("type", "id", "lat", "lon", "geometry", "tags"))), ",").alias("e"))
    path = _folder(s, "elements")
    blocks.select("block", F.concat(F.lit('{"osm3s":{"timestamp_osm_base":"2003-01-01T00:00:00Z"},"elements":['), "e", F.lit("]}")).alias("value")).write.partitionBy("block").text(path)
    classes = maps.elements(s, path)
    good, bad = maps.map_pois(classes)
    row = lambda df, kind, key, category, x, y: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(category).alias("category"), F.round(x, 6).alias("lon"), F.round(y, 6).alias("lat"))
    greens = maps.map_greens(classes).withColumn("c", F.get("ring", F.lit(2)))
    parts = [row(good, "poi", "osm_id", "category", F.col("lon"), F.col("lat")), row(bad, "unplaced", "osm_id", "category", F.col("lon"), F.col("lat")), row(maps.map_roads(classes), "road", "line_id", "road_class", F.col("x2"), F.col("y2")), row(greens, "green", "region_id", "leisure_class", F.col("c.lon"), F.col("c.lat"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def rents_read(s, d):
    """Quarterly rents written as a CSV with thousands marks, wards by code or only by name, and read with the reason why a row cannot be used."""
    n = A.table(s, d, "nation").select(F.col("n_nationkey").alias("ward"), "n_name")
    r = A.rent_stats(s, d).where("source = 'reins'").join(n, "ward")
    w = F.col("ward")
    rows = r.select(
        F.when(w % 3 != 0, (w + 13101).cast("string")).alias("地域コード"),
        F.when(w % 6 != 3, F.col("n_name")).otherwise("elsewhere").alias("area"),
        F.format_number("rent_per_sqm", 0).alias("rent_per_sqm_yen"),
        F.format_number("fee", 0).alias("management_fee_yen"),
        F.col("period").alias("year"),
        (w % 5).cast("string").alias("quarter"),
    )
    path = _folder(s, "rents")
    rows.write.csv(path, header=True, quote='"', escape='"')
    wards = n.select((F.col("ward") + 13101).cast("string").alias("ward_code"), F.col("n_name").alias("name"))
    got = tabular.quarterly_rents(tabular.as_tags(tabular.delimited(s, path)), wards)
    return got.select("ward_code", "area", "period", F.round("rent_per_sqm_yen", 6).alias("rent"), F.round("management_fee_yen", 6).alias("fee"), "reason")


def feed_read(s, d):
    """Trips of the events written as a timetable feed; stop times of the trips on weekday services, as read."""
    folder = _folder(s, "feed")
    e = A.table(s, d, "events").withColumn("trip_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")))
    w = Window.partitionBy("trip_id").orderBy("ts", "event_id")
    clock = F.date_format("ts", "HH:mm:ss")
    out = lambda df, name: df.write.csv(f"{folder}/{name}.txt", header=True)
    out(e.select(clock.alias("departure_time"), "trip_id", clock.alias("arrival_time"), F.col("event_type").alias("stop_id"), F.row_number().over(w).alias("stop_sequence")), "stop_times")
    service = F.get(F.array(F.lit("work"), F.lit("weekend"), F.lit("added")), (F.col("user_id") % 3).cast("int"))
    out(e.select("trip_id", (F.col("user_id") % 10).alias("route_id"), service.alias("service_id")).distinct(), "trips")
    # The feed's calendar: a service of workdays, one of weekends, one that is only on added dates.
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    out(s.createDataFrame([("work", 1, 1, 1, 1, 1, 0, 0), ("weekend", 0, 0, 0, 0, 0, 1, 1)], "service_id string, " + ", ".join(f"{x} int" for x in days)), "calendar")
    out(s.createDataFrame([("added", "20030106", 1), ("weekend", "20030107", 1)], "service_id string, date string, exception_type int"), "calendar_dates")
    services = timetable.weekday_services(timetable.feed(s, folder, "calendar"), timetable.feed(s, folder, "calendar_dates"))
    trips = timetable.feed(s, folder, "trips").join(services, "service_id", "left_semi")
    times = timetable.wanted_times(timetable.feed(s, folder, "stop_times"), trips)
    return times.select("trip_id", "stop", F.col("stop_sequence").cast("long").alias("seq"), F.round("arrival", 6).alias("arrival"))


QUERIES = {f.__name__: f for f in (stations_read, map_elements_read, rents_read, feed_read)}
