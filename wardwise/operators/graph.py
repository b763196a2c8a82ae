"""Connected components and station complexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.geo import haversine_m
from wardwise.sources.shared import discard, materialized, shared_folder

from .spatial import near


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and the smallest id that pairs (a_id, b_id) reach from it.

    Every pair (u, v) with u > v is turned by large and small stars: first each node's larger neighbours go to the node's least neighbour,
    then its smaller ones and itself. Pairs never get more, and at the end each points to its component's least node. The rounds follow the
    logarithm of the longest way and end by themselves. Tables of rounds are read by shuffles only, so the driver gets none of them.
    """
    spark, rounds = pairs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        rounds.append(f"{shared_folder(spark)}/stars-{uuid.uuid4().hex}")
        return materialized(df, "stars", rounds[-1])

    u, v = F.col("u"), F.col("v")
    edges = kept(pairs.where("a_id <> b_id").select(F.greatest("a_id", "b_id").alias("u"), F.least("a_id", "b_id").alias("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(both.join(low.hint("shuffle_hash"), "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_hash"), "u")
        after = small.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        after = kept(after)
        same = after.join(edges.hint("shuffle_hash"), ["u", "v"], "left_anti").limit(1).count() == 0 and edges.join(after.hint("shuffle_hash"), ["u", "v"], "left_anti").limit(1).count() == 0
        edges = after
        if same:
            found = materialized(nodes.select("id").join(edges.select(u.alias("id"), v.alias("low")).hint("shuffle_hash"), "id", "left").select("id", F.coalesce("low", "id").alias("component")), "components")
            for path in rounds:
                discard(spark, path)
            return found


def merged_stations(stations: DataFrame, radius_m: float = config.MERGE_M) -> DataFrame:
    """Complexes of stations (id, name_key, name, lon, lat) with one name within the radius, also by way of others.

    Stations of one name and place are one node, the smallest of them, so pairs follow the number of places.
    """
    place = ["name_key", "lon", "lat"]
    nodes = materialized(stations.groupBy(*place).agg(F.min("id").alias("id")), "places")
    a = nodes.select(F.col("id").alias("anchor_id"), F.col("name_key").alias("a_key"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    p = nodes.select(F.col("id").alias("b_id"), F.col("name_key").alias("b_key"), "lon", "lat")
    pairs = near(a, p, radius_m * 1.01, haversine_m).where((F.col("a_key") == F.col("b_key")) & (F.col("anchor_id") < F.col("b_id")) & (F.col("dist_m") <= radius_m))
    groups = nodes.join(components(nodes, pairs.select(F.col("anchor_id").alias("a_id"), "b_id")), "id").select(*place, "component")
    alone = F.col("name_key").isNull() | F.col("lon").isNull() | F.col("lat").isNull()
    joined = stations.where(~alone).join(groups, place).unionByName(stations.where(alone).withColumn("component", F.col("id")))
    return joined.groupBy("component").agg(F.count("*").alias("members"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min_by("name", "id").alias("name"))
