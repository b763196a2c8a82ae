"""GeoJSON features and map elements, read with given schemas and split into tables and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.text import first_of, stable_id, station_key, without_chome

_FEATURES = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def features(spark: SparkSession, *paths: str) -> DataFrame:
    """Features of one or more collections: tags, kind and coordinates (as JSON). Anything else than a collection is an error."""
    raw = spark.read.schema(_FEATURES).json(list(paths), multiLine=True, mode="FAILFAST")
    checked = raw.select(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast("array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>")).alias("features"))
    return checked.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("tags"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def points(rows: DataFrame) -> DataFrame:
    xy = F.from_json("coordinates", "array<double>")
    return rows.where("kind = 'Point'").withColumn("lon", xy[0]).withColumn("lat", xy[1])


def rings(rows: DataFrame) -> DataFrame:
    """Polygons and multipolygons as rings: part, ring number, ring."""
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = rows.where("kind in ('Polygon', 'MultiPolygon')").withColumn("_p", F.when(F.col("kind") == "Polygon", one).otherwise(many))
    parts = parts.select("*", F.posexplode("_p").alias("part", "_r")).select("*", F.posexplode("_r").alias("ring_no", "_c"))
    return parts.withColumn("ring", F.transform("_c", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).drop("_p", "_r", "_c")


def segments(rows: DataFrame) -> DataFrame:
    """Lines as segments: seq, x1, y1, x2, y2; lines of one vertex have none."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    lines = rows.where("kind in ('LineString', 'MultiLineString')").withColumn("_l", F.when(F.col("kind") == "LineString", one).otherwise(many)).select("*", F.posexplode("_l").alias("part", "_v"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_v") - 1), lambda i: F.struct(i.alias("seq"), F.get("_v", i - 1)[0].alias("x1"), F.get("_v", i - 1)[1].alias("y1"), F.get("_v", i)[0].alias("x2"), F.get("_v", i)[1].alias("y2")))
    return lines.where(F.size("_v") >= 2).select(*rows.columns, "part", F.explode(pairs).alias("s")).select(*rows.columns, "part", "s.*")


def in_country(lon: Column, lat: Column) -> Column:
    s, w, n, e = config.COUNTRY_BOX
    return F.coalesce(lat.between(s, n) & lon.between(w, e), F.lit(False))


def in_city(lon: Column, lat: Column) -> Column:
    s, w, n, e = config.BOX
    return F.coalesce(lat.between(s, n) & lon.between(w, e), F.lit(False))


def is_ward_code(code: Column) -> Column:
    return code.rlike("^131(0[1-9]|1[0-9]|2[0-3])$")


def ward_names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wards with their code, name and English name (their own, else the one known for the code), and the rows that lack one."""
    t = F.col("tags")
    code = first_of(t, ["N03_007", "ward_code"])
    r = rows.withColumn("ward_code", code).withColumn("name_ja", first_of(t, ["N03_004", "name_ja"])).withColumn("name_en", F.coalesce(first_of(t, ["name_en"]), _lookup(config.WARD_NAMES, code)))
    reason = F.when(F.col("ward_code").isNull(), "code").when(F.col("name_ja").isNull(), "name").when(F.col("name_en").isNull(), "English name")
    r = r.withColumn("reason", reason)
    return r.where("reason is null").drop("reason"), r.where("reason is not null")


def land_use(raw: Column) -> Column:
    """``residential`` for what names housing, else the trimmed text."""
    t = F.lower(F.trim(raw))
    return F.when(t.isin("住宅", "住宅地", "residential", "1", "住居") | t.contains("住宅"), "residential").otherwise(F.trim(raw))


def zone(names: DataFrame, codes: DataFrame, rows: DataFrame) -> DataFrame:
    """Zoning category and whether people live there: by name, by code, by a word in it; else null. names, codes: raw, category, is_residential."""
    t = F.col("tags")
    raw = first_of(t, ["category", "用途地域", "A29_005", "A29_004", "use_district"])
    r = rows.withColumn("raw", raw).withColumn("flag", F.try_element_at(t, F.lit("is_residential")).try_cast("boolean"))
    pick = lambda df, tag: df.select("raw", F.col("category").alias(f"c_{tag}"), F.col("is_residential").alias(f"r_{tag}"))
    r = r.join(pick(names, "n"), "raw", "left").join(pick(codes, "c"), "raw", "left")
    by_word = F.when(F.col("raw").contains("住居"), "residential").when(F.col("raw").contains("商業"), "commercial").when(F.col("raw").contains("工業"), "industrial")
    return r.withColumn("category", F.coalesce("c_n", "c_c", by_word)).withColumn("is_residential", F.coalesce("flag", "r_n", "r_c", by_word == "residential")).drop("c_n", "c_c", "r_n", "r_c", "flag")


def checked_zones(names: DataFrame, codes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``zone``, and the areas that cannot be used, with the reason."""
    z = zone(names, codes, rows).withColumn("reason", F.when(F.col("raw").isNull(), "no category").when(F.col("category").isNull(), "unknown category"))
    return z.where("reason is null").drop("reason"), z.where("reason is not null")


def rail_mode(kind: Column, operator_type: Column, operator: Column) -> Column:
    """Mode of a rail line: monorail and the like, subway, commuter rail, else local."""
    return (
        F.when(kind.isin("13", "14", "15", "16") | operator.contains("モノレール") | (F.lower(operator).contains("monorail")), "monorail")
        .when(operator.contains("地下鉄") | operator.contains("メトロ") | operator.contains("東京都") | F.lower(operator).contains("metro"), "subway")
        .when(operator_type.isin("1", "2") | operator.contains("旅客鉄道"), "commuter_rail")
        .otherwise("local_rail")
    )


def towns(rows: DataFrame, prefix: str = "13") -> DataFrame:
    """Parts of towns by ward and name without the block number, each with a stable id."""
    t = F.col("tags")
    code, name = first_of(t, ["KEY_CODE", "code"]), without_chome(first_of(t, ["S_NAME", "name"]))
    r = rings(rows.withColumn("ward_code", F.substring(code, 1, 5)).withColumn("name_ja", name).where(code.startswith(prefix) & is_ward_code(F.substring(code, 1, 5)) & name.isNotNull()))
    return r.withColumn("region_id", stable_id(F.col("ward_code"), F.col("name_ja")))


def station_rows(rows: DataFrame) -> DataFrame:
    t = F.col("tags")
    name = first_of(t, ["N02_005", "name", "station_name"])
    return points(rows).select(first_of(t, ["id", "N02_005c", "station_code"]).alias("id"), name.alias("name"), station_key(name).alias("name_key"), "lon", "lat")


ELEMENTS = "osm3s struct<timestamp_osm_base: string>, elements array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, ref: long, role: string, geometry: array<struct<lat: double, lon: double>>>>, tags: map<string, string>>>"


def elements(spark: SparkSession, *paths: str) -> DataFrame:
    """Map elements with the class that their tags mean: kind (poi, road, green, unmapped) and category."""
    rows = spark.read.schema(ELEMENTS).json(list(paths), multiLine=True, mode="FAILFAST")
    e = rows.select(F.col("osm3s.timestamp_osm_base").alias("as_of"), F.explode("elements").alias("e")).select("as_of", "e.*")
    return e.withColumn("c", classified(F.col("tags"))).select("*", "c.kind", "c.category").drop("c")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def classified(tags: Column) -> Column:
    """Roads come before green spaces, those before shops, amenities and offices that have a name."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    place = F.coalesce(_lookup(config.SHOPS, tag("shop")), _lookup(config.AMENITIES, tag("amenity")), F.when(tag("office").isNotNull() & (F.trim(tag("name")) != ""), "landmark"))
    cls = lambda kind, category: F.struct(F.lit(kind).alias("kind"), category.alias("category"))
    return F.when(tag("highway").isin(*config.ROADS), cls("road", tag("highway"))).when(tag("leisure").isin(*config.GREEN), cls("green", tag("leisure"))).when(place.isNotNull(), cls("poi", place)).otherwise(cls("unmapped", F.lit(None).cast("string")))


def map_pois(classes: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Places with a position, and those without one. aliases: osm_type, osm_id, aliases."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    p = classes.where("kind = 'poi'").select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), "category", tag("name").alias("name"), tag("name:en").alias("name_en"), tag("cuisine").alias("cuisine"), tag("opening_hours").alias("opening_hours"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))
    if aliases is not None:
        p = p.join(aliases, ["osm_type", "osm_id"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    good = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return p.where(good), p.where(~good)


def map_roads(classes: DataFrame) -> DataFrame:
    """Segments of roads that are ways of two vertices or more."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(i.alias("seq"), F.get("geometry", i - 1)["lon"].alias("x1"), F.get("geometry", i - 1)["lat"].alias("y1"), F.get("geometry", i)["lon"].alias("x2"), F.get("geometry", i)["lat"].alias("y2")))
    r = classes.where("kind = 'road' and type = 'way'").where(F.size("geometry") >= 2)
    return r.select(F.col("id").alias("line_id"), F.col("category").alias("road_class"), F.explode(pairs).alias("s")).select("line_id", "road_class", "s.*")


def map_greens(classes: DataFrame) -> DataFrame:
    """Rings of parks: a way's own, or a relation's outer ways; rings of fewer than three points are left out."""
    outer = F.transform(F.filter("members", lambda m: (m["role"] == "outer") & (m["type"] == "way")), lambda m: m["geometry"])
    own = F.when(F.col("type") == "relation", outer).otherwise(F.array("geometry"))
    g = classes.where("kind = 'green' and type in ('way', 'relation')").select(F.col("id").alias("region_id"), F.col("category").alias("leisure_class"), F.posexplode(own).alias("part", "ring"))
    return g.where(F.size("ring") >= 3)


def in_collections(features: DataFrame, block: Column) -> DataFrame:
    """Lines of ``as_features`` as collections, one for each block: block, value. Written by ``partitionBy("block").text``
    each collection is a file of its own; blocks are to be of bounded size."""
    return features.groupBy(block.cast("string").alias("block")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))


def as_features(rows: DataFrame, geometry: Column, *properties: str, also: tuple[str, ...] = ()) -> DataFrame:
    """One GeoJSON feature a line, for ``write.text``; columns to be kept beside it are named in ``also``."""
    return rows.select(*also, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
