"""Queries of what an import does with rows from outside: matching, naming, classifying, checking; rejected rows are rows of the answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardwise.functions import numbers, text
from wardwise.operators import quality, transit
from wardwise.sources import maps, tabular, timetable
from wardwise.sources.shared import shared_folder

from . import adapters as A
from . import queries as Q


def matched_stops(s, d):
    """Stops of a feed and their stations: some known before, some platforms of others, some too far away or of another name."""
    st = A.stations(s, d)
    k, key = F.col("id"), lambda c: F.concat(F.lit("s"), c.cast("string"))
    stops = st.select(key(k).alias("stop_id"), F.when(k % 7 == 3, "elsewhere").otherwise(F.concat("name", F.lit(" Station"))).alias("stop_name"), (F.col("lon") + 0.001 * (k % 5)).alias("stop_lon"), F.col("lat").alias("stop_lat"), F.when(k % 3 == 1, key(k - 1)).otherwise("").alias("parent_station"))
    stations = st.select("id", text.station_key(F.col("name")).alias("name_key"), "lon", "lat")
    known = st.where("id % 11 = 5").select(key(k).alias("source_id"), (k + 1).alias("station"))
    return timetable.matched_stops(stops, stations, known)


def mapped_routes(s, d):
    """Routes and their lines: by id, by a short or long name, or none."""
    st, k = A.stations(s, d), F.col("id")
    number = (k % 20).cast("string")
    routes = st.select(F.when(k % 4 == 0, F.concat(F.lit("L"), number)).otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("route_id"), F.when(k % 4 == 1, F.concat(F.lit(" Line "), number, F.lit(" "))).alias("route_short_name"), F.when(k % 4 == 2, F.concat(F.lit("Express "), number)).otherwise("x").alias("route_long_name"))
    lines = st.select(number.alias("n")).distinct().select(F.concat(F.lit("L"), "n").alias("line"), F.array(F.concat(F.lit("line "), "n"), F.concat(F.lit("EXPRESS "), "n")).alias("names"))
    return timetable.mapped_routes(routes, lines)


def _towns(s, d):
    return A.table(s, d, "customer").select(F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("ward_ja"), F.col("c_mktsegment").alias("town_ja"), F.col("c_nationkey").alias("n")).distinct()


def resolved_names(s, d):
    """English names of towns: from an index, from overrides, or why there is none; overrides of no town."""
    t, n = _towns(s, d), F.col("n")
    name = text.title(F.col("town_ja"))
    index = t.where("n % 4 <> 3").select("ward_ja", "town_ja", F.explode(F.when(n % 4 == 2, F.array(name, F.concat(name, F.lit(" B")))).when((n % 4 == 1) & (n % 5 == 0), F.array(F.concat(name, F.lit("!")))).otherwise(F.array(name))).alias("town_en"))
    own = t.where("n % 4 = 3 and n % 3 = 0").select("ward_ja", "town_ja", F.concat(F.lit("Own "), name).alias("town_en"))
    unused = A.table(s, d, "region").select(F.lit("nowhere").alias("ward_ja"), F.col("r_name").alias("town_ja"), F.lit("Own").alias("town_en"))
    return tabular.resolved_names(t.select("ward_ja", "town_ja"), index, own.unionByName(unused))


def preferred_names(s, d):
    """Names of parts by the first source that has just one."""
    k, p = F.col("p_partkey"), A.table(s, d, "part")
    row = lambda cond, source, name: F.when(cond, F.struct(F.lit(source).alias("source"), name.alias("name")))
    rows = F.array(row(k % 2 == 0, "a", F.col("p_name")), row(k % 6 == 0, "a", F.col("p_brand")), row(k % 3 == 0, "b", F.col("p_type")), row(k > -1, "c", F.col("p_brand")))
    names = p.select(k.alias("key"), F.explode(rows).alias("r")).where("r is not null").select("key", "r.*")
    return tabular.preferred_names(names, ["a", "b"])


def cube_read(s, d):
    """Rents and fees written as statistical responses of two tables, read, joined, and what is wrong with them."""
    n = A.table(s, d, "nation").select(F.col("n_nationkey").alias("ward"))
    stats = A.rent_stats(s, d).where("source = 'estat' and period = '1995'").join(n, "ward")
    code = (F.col("ward") + 13101).cast("string")
    value = F.when(F.col("ward") % 9 == 4, "-").otherwise(F.format_number("rent_per_sqm", 0))
    cell = lambda c: F.to_json(F.struct(code.alias("@area"), F.lit("1").alias("@tab"), F.lit("yen").alias("@unit"), c.alias("$")))

    def written(rows, table):
        path = f"{shared_folder(s)}/cube-{uuid.uuid4().hex}"
        cells = rows.agg(F.array_join(F.array_sort(F.collect_list("cell")), ",").alias("c"))  # a cell for each ward
        cells.select(F.concat(F.lit('{"GET_STATS_DATA":{"STATISTICAL_DATA":{"TABLE_INF":{"@id":"' + table + '"},"DATA_INF":{"VALUE":['), "c", F.lit("]}}}}")).alias("value")).coalesce(1).write.text(path)
        return tabular.statistics_cube(s, path)

    rents = written(stats.where("ward % 8 <> 7").select(cell(value).alias("cell")), "rents")
    fees = written(stats.where("ward % 3 <> 0").select(cell(F.format_number("fee", 0)).alias("cell")), "fees")
    expected = n.select(code.alias("area"))
    problems = tabular.cube_problems(rents, "rents", expected)
    both = tabular.rent_and_fee(rents, fees).select("area", F.col("rent_per_sqm_yen").alias("rent"), F.col("management_fee_yen").alias("fee"))
    return both.join(problems, "area", "full")


def zones(s, d):
    """Zoning areas by name, by code, by a word, and those of no known kind, which are rejected."""
    k = F.col("n_nationkey")
    raw = F.when(k % 6 == 0, "第一種住居地域").when(k % 6 == 1, "近隣商業").when(k % 6 == 2, "7").when(k % 6 == 3, "quiet quarter").when(k % 6 == 4, "wasteland")
    tags = F.map_filter(F.create_map(F.lit("用途地域"), raw, F.lit("is_residential"), F.when(k % 12 == 1, "true")), lambda _, v: v.isNotNull())
    names = s.createDataFrame([("quiet quarter", "low-rise", True)], "raw string, category string, is_residential boolean")
    codes = s.createDataFrame([("7", "industrial", False)], "raw string, category string, is_residential boolean")
    good, bad = maps.checked_zones(names, codes, A.table(s, d, "nation").select(k.cast("long").alias("id"), tags.alias("tags")))
    return good.select("id", "category", "is_residential", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "category", "is_residential", "reason"))


def rail_modes(s, d):
    """Modes of lines by their kind and operator, and the use of land prices."""
    k = F.col("s_suppkey")
    operator = F.when(k % 5 == 0, "東京地下鉄").when(k % 5 == 1, "東日本旅客鉄道").when(k % 5 == 2, "Tama Monorail").when(k % 5 == 3, "Metro Co").otherwise("私鉄")
    use = F.when(k % 4 == 0, " 住宅地 ").when(k % 4 == 1, "低層住宅").when(k % 4 == 2, " RESIDENTIAL").otherwise("商業地 ")
    return A.table(s, d, "supplier").select(k.alias("id"), maps.rail_mode((k % 17).cast("string"), (k % 7).cast("string"), operator).alias("mode"), maps.land_use(use).alias("use"))


def name_keys(s, d):
    """Keys of names in full and half width, and confidence lowered by steps."""
    k = F.col("s_suppkey")
    wide = F.translate("s_name", "Suplier#0123456789", "Ｓｕｐｌｉｅｒ＃０１２３４５６７８９")
    return A.table(s, d, "supplier").select(k.alias("id"), text.station_key(F.concat(wide, F.when(k % 2 == 0, "駅").otherwise("　Station"))).alias("station"), text.ward_key(F.concat(F.lit("霞 ヶ"), wide, F.lit("　"))).alias("ward"), numbers.confidence_name(numbers.lower_confidence((k % 3).cast("int"), (k % 2).cast("int"))).alias("confidence"), numbers.yen(k * 1234).alias("price"))


def price_tables(s, d):
    """Prices from map features with the reasons why some are not used: use, price and place are checked."""
    p = A.land_prices(s, d)
    rules = {"price": F.col("price") > 0, "use": maps.land_use(F.when(F.col("use") == "residential", "住宅").otherwise(F.col("use"))) == "residential", "place": maps.in_city(F.col("lon"), F.col("lat"))}
    good, bad = quality.split_rejects(p, rules)
    return bad.groupBy("ward", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n")).unionByName(good.groupBy("ward").agg(F.count("*").alias("n")).select("ward", F.lit("").alias("reasons"), "n"))


def import_health(s, d):
    """Shares of stops without a station, of stations without rides and of rents without near prices, each with its threshold."""
    checks = [
        ("unmatched stops", quality.share(matched_stops(s, d), F.col("station").isNull()), 0.5),
        ("stations without rides", quality.share(A.stations_and_halts(s, d).join(transit.orphans(A.stations_and_halts(s, d).select("id"), A.rail_edges(s, d)).withColumn("orphan", F.lit(True)), "id", "left"), F.col("orphan").isNotNull()), 0.1),
        ("rents without near prices", quality.share(Q.land_multiplier(s, d), F.col("fallback")), 0.25),
    ]
    parts = [df.select(F.lit(label).alias("label"), "bad", "n", F.round("share", 6).alias("share"), (F.col("share") <= most).alias("passed")) for label, df, most in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (matched_stops, mapped_routes, resolved_names, preferred_names, cube_read, zones, rail_modes, name_keys, price_tables, import_health)}
