"""Nested answers: cards of localities and named paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polygons(rings: DataFrame) -> DataFrame:
    """Regions as GeoJSON text; each ring is closed. rings: region_id, part, ring, and ring_no where there are holes."""
    number = F.col("ring_no") if "ring_no" in rings.columns else F.lit(0)
    corners = F.transform("ring", lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    closed = F.when(F.get(corners, F.lit(0)) == F.element_at(corners, -1), corners).otherwise(F.concat(corners, F.slice(corners, 1, 1)))
    parts = rings.groupBy("region_id", "part").agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), closed.alias("c")))).alias("r"))
    whole = parts.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("part", F.col("r.c").alias("c")))).alias("p"))
    return whole.select("region_id", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("p.c").alias("coordinates"))).alias("polygon"))


def locality_cards(localities: DataFrame, wards: DataFrame, rings: DataFrame, walks: DataFrame, stations: DataFrame) -> DataFrame:
    """A locality with its polygon, its ward's name and its stations by the least walk from any sample.

    localities: locality, name, ward, lon, lat; wards: ward, ward_name; walks: locality, sample, station, walk_min;
    stations: station, station_name. What is not known is null, no stations are an empty list.
    """
    least = walks.groupBy("locality", "station").agg(F.min("walk_min").alias("walk_min")).join(stations, "station", "left")
    listed = least.groupBy("locality").agg(F.array_sort(F.collect_list(F.struct("walk_min", "station", "station_name"))).alias("near"))
    card = localities.join(wards, "ward", "left").join(polygons(rings).withColumnRenamed("region_id", "locality"), "locality", "left").join(listed, "locality", "left")
    return card.select("locality", "name", "ward", "ward_name", "lon", "lat", "polygon", F.coalesce("near", F.array().cast(listed.schema["near"].dataType)).alias("near"))


def named_paths(paths: DataFrame, keys: Sequence[str], stations: DataFrame, lines: DataFrame) -> DataFrame:
    """Paths with the names of their nodes and lines; ids stand where no name is known, ways without line have none.

    paths: keys and path (array of node, line); stations: node, node_name; lines: line, line_name.
    """
    hops = paths.select(*keys, F.posexplode("path").alias("pos", "hop")).select(*keys, "pos", "hop.node", "hop.line")
    named = hops.join(stations, "node", "left").join(lines, "line", "left")
    hop = F.struct("pos", "node", F.coalesce("node_name", F.col("node").cast("string")).alias("node_name"), F.coalesce("line_name", F.col("line").cast("string")).alias("line_name"))
    return named.groupBy(*keys).agg(F.array_sort(F.collect_list(hop)).alias("path"))
