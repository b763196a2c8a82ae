"""The library's tables made from the driver's, by expressions that SQL has too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(k: Column) -> Column:
    return F.lit(139.56) + ((k * 7919) % 3600) / F.lit(10000.0)


def lat_of(k: Column) -> Column:
    return F.lit(35.50) + ((k * 104729) % 3200) / F.lit(10000.0)


def stations(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("ward"), lon_of(k).alias("lon"), lat_of(k).alias("lat"))


def stations_and_halts(spark, d) -> DataFrame:
    """Stations, and beside every seventh a halt within walking distance that no train calls at."""
    st = stations(spark, d).select("id", "name", "lon", "lat")
    halts = st.where("id % 7 = 2").select((F.col("id") + 1000000).alias("id"), F.concat("name", F.lit(" halt")).alias("name"), (F.col("lon") + 0.0011).alias("lon"), (F.col("lat") + 0.0012 * (1 + F.col("id") % 3)).alias("lat"))
    return st.unionByName(halts)


def anchors(spark, d) -> DataFrame:
    return stations(spark, d).select(F.col("id").alias("anchor_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat"), "name", "ward")


def pois(spark, d) -> DataFrame:
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "AUTOMOBILE", "supermarket").when(seg == "BUILDING", "convenience").when(seg == "FURNITURE", "bar").when(seg == "MACHINERY", "cafe").otherwise("health")
    none = F.lit(None).cast("string")
    a = c.select(F.concat(F.lit("c"), k).alias("poi_id"), F.col("c_name").alias("name"), kind.alias("category"), none.alias("cuisine"), none.alias("opening_hours"), lon_of(k).alias("lon"), lat_of(k).alias("lat"))
    k = F.col("p_partkey") + 7
    hours = F.when(F.col("p_size") % 4 == 0, "24/7").when(F.col("p_size") % 4 == 1, "Mo-Su 10:00-23:30").when(F.col("p_size") % 4 == 2, "Mo-Fri 09:00-18:00; Sa off")
    kind = F.when(F.col("p_size") % 5 == 0, "grocery").otherwise("restaurant")
    b = p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("poi_id"), F.col("p_name").alias("name"), kind.alias("category"), F.col("p_brand").alias("cuisine"), hours.alias("opening_hours"), lon_of(k).alias("lon"), lat_of(k).alias("lat"))
    return a.unionByName(b)


def ward_rings(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = F.lit(139.56) + F.lit(0.072) * (k % 5), F.lit(35.50) + F.lit(0.064) * F.floor(k / 5)
    x1, y1 = x0 + F.lit(0.072), y0 + F.lit(0.064)
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return table(spark, d, "nation").select(k.alias("region_id"), F.lit(0).alias("part"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))


#: Homes of wards by the ward's number modulo 8: island and corners, as distances from the ward's corner in degrees.
HOMES = {
    0: [("a", 0.025, 0.02, 0.071, 0.061), ("b", 0.004, 0.004, 0.012, 0.01)],
    2: [("a", 0.031, 0.0271, 0.0382, 0.0335)],  # a hundredth of the ward
    4: [("a", 0.0101, 0.0103, 0.0302, 0.0304), ("a", 0.0253, 0.0202, 0.0454, 0.0403), ("b", 0.0501, 0.0301, 0.0702, 0.0553)],
    6: [("a", 0.0103, 0.0107, 0.0203, 0.0209), ("b", 0.0511, 0.0411, 0.0631, 0.0522)],
}


def home_rings(spark, d) -> DataFrame:
    """Residential squares of every second ward, one to three."""
    k = F.col("n_nationkey")
    x0, y0 = F.lit(139.56) + F.lit(0.072) * (k % 5), F.lit(35.50) + F.lit(0.064) * F.floor(k / 5)
    corner = lambda x, y: F.struct((x0 + F.lit(x)).alias("lon"), (y0 + F.lit(y)).alias("lat"))
    every = [F.when(k % 8 == m, F.struct(F.lit(i).alias("part"), F.array(corner(a, b), corner(c, b), corner(c, e), corner(a, e)).alias("ring"))) for m, boxes in HOMES.items() for i, (_, a, b, c, e) in enumerate(boxes)]
    return table(spark, d, "nation").select(k.alias("region_id"), F.explode(F.array(*every)).alias("h")).where("h is not null").select("region_id", "h.*")


def land_prices(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ward"))
    k = F.col("o_orderkey")
    use = F.when(F.col("o_orderstatus") == "O", "residential").when(F.col("o_orderstatus") == "F", "commercial").otherwise("industrial")
    return o.join(c, "o_custkey").select(k.alias("price_id"), "ward", lon_of(k).alias("lon"), lat_of(k).alias("lat"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"), use.alias("use"))


def rent_stats(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ward"))
    source = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "reins").otherwise("estat")
    g = o.join(c, "o_custkey").groupBy("ward", source.alias("source"), F.year("o_orderdate").cast("string").alias("period"))
    return g.agg((F.lit(1000.0) + F.pmod(F.floor(F.avg("o_totalprice")), F.lit(19000))).alias("rent_per_sqm"), F.pmod(F.count("*"), F.lit(20000)).cast("double").alias("fee"))


def rail_edges(spark, d) -> DataFrame:
    s = stations(spark, d)
    n = s.count()
    i = F.col("id")
    ring = s.select(i.alias("a"), F.pmod(i + 1, F.lit(n)).alias("b"), F.floor(i / 20).alias("line"))
    chord = s.select(i.alias("a"), F.pmod(i * 7 + 3, F.lit(n)).alias("b"), (F.lit(1000) + i % 3).alias("line"))
    e = ring.unionByName(chord).where("a <> b")
    at = s.select("id", "lon", "lat")
    e = e.join(at.withColumnsRenamed({"id": "a", "lon": "ax", "lat": "ay"}), "a").join(at.withColumnsRenamed({"id": "b", "lon": "bx", "lat": "by"}), "b")
    minutes = F.floor(F.lit(1.0) + F.lit(100.0) * (F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by"))))
    e = e.select("a", "b", "line", minutes.cast("double").alias("peak_minutes"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "line", "peak_minutes"))
    return both.groupBy(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "line").agg(F.min("peak_minutes").alias("peak_minutes")).withColumn("offpeak_minutes", F.col("peak_minutes") + 1).withColumn("peak_wait", (F.col("line") % 4).cast("double")).withColumn("offpeak_wait", (F.col("line") % 5).cast("double")).withColumn("kind", F.lit("ride")).withColumn("confidence", F.when(F.col("line") >= 1000, 1).otherwise(2))


def faulty_edges(spark, d) -> DataFrame:
    """Edges of one period, some without what a search needs."""
    e = rail_edges(spark, d)
    k = (F.col("from_id") * 31 + F.col("to_id") * 17 + F.col("line")) % 23
    minutes = F.when(k == 1, F.lit(None)).when(k == 2, -F.col("peak_minutes")).when(k == 3, F.lit(float("nan"))).when(k == 4, F.lit(float("inf"))).otherwise(F.col("peak_minutes"))
    kind = F.when(k == 5, "ferry").when(k.isin(6, 7), "transfer").otherwise("ride")
    return e.withColumn("peak_minutes", minutes).withColumn("kind", kind).withColumn("line", F.when(k.isin(7, 8), F.lit(None)).otherwise(F.col("line"))).withColumn("to_id", F.when(k == 9, F.lit(None)).otherwise(F.col("to_id")))


def faulty_seeds(spark, d) -> DataFrame:
    """A seed for each station, some without what a search needs."""
    k = F.col("id") % 13
    walk = F.when(k == 1, F.lit(-1.0)).when(k == 2, F.lit(None)).when(k == 3, F.lit(float("nan"))).otherwise(F.lit(2.0))
    return stations(spark, d).select(F.when(k != 4, F.col("id")).alias("dest"), F.when(k != 5, F.col("id")).alias("node"), walk.alias("walk"))


def track_pieces(spark, d) -> DataFrame:
    """Lines of twenty stations each as pieces in no order, every third the other way round, every fourth in two halves; every third line has a fork."""
    st = stations(spark, d)
    a, b = st.select("id", F.col("lon").alias("ax"), F.col("lat").alias("ay")), st.select((F.col("id") - 1).alias("id"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    legs = a.join(b, "id").where("id % 20 <> 19").select(F.floor(F.col("id") / 20).alias("line_id"), F.col("id").alias("k"), "ax", "ay", "bx", "by")
    forks = a.where("id % 20 = 6 and floor(id / 20) % 3 = 1").select(F.floor(F.col("id") / 20).alias("line_id"), (F.col("id") + 1000000).alias("k"), "ax", "ay", (F.col("ax") + 0.0101).alias("bx"), (F.col("ay") + 0.0132).alias("by"))
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    leg = lambda i, x1, y1, x2, y2: F.struct(F.lit(i).alias("i"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    c = {n: F.col(n) for n in ("ax", "ay", "bx", "by")}
    one, two = F.array(leg(0, c["ax"], c["ay"], c["bx"], c["by"])), F.array(leg(0, c["ax"], c["ay"], mx, my), leg(1, mx, my, c["bx"], c["by"]))
    cut = legs.unionByName(forks).withColumn("p", F.explode(F.when(F.col("k") % 4 == 0, two).otherwise(one))).select("line_id", "k", "p.*")
    turned = F.col("k") % 3 == 0
    turn = [F.when(turned, F.col(f"{n}{2 if e == 1 else 1}")).otherwise(F.col(f"{n}{e}")).alias(f"{n}{e}") for e in (1, 2) for n in "xy"]
    return cut.select("line_id", F.sha2(F.concat_ws("-", "k", "i"), 256).alias("piece"), *turn)


def stop_times(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyyMMdd")
    minute = F.hour("ts") * 60.0 + F.minute("ts") + F.second("ts") / 60.0
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("trip_id"), F.struct("ts", "event_id").alias("stop_sequence"), F.col("event_type").alias("stop"), minute.alias("arrival"), minute.alias("departure"))


def trip_routes(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trip_id"), (F.col("user_id") % 10).alias("route")).distinct()


def runs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("event_type").alias("source"), F.col("ts").alias("started_at"), F.when(k % 3 == 0, "failed").otherwise("success").alias("status"), F.col("value").alias("rows"))


def places(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("place_id"), F.lit("poi").alias("kind"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("place_id"), F.lit("station").alias("kind"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return p.unionByName(s)


def localities(spark, d) -> DataFrame:
    """Nine samples around each nation's middle with their nearest stations: locality, sample, lon, lat."""
    k = F.col("n_nationkey")
    x, y = F.lit(139.56) + F.lit(0.072) * (k % 5) + F.lit(0.036), F.lit(35.50) + F.lit(0.064) * F.floor(k / 5) + F.lit(0.032)
    s = table(spark, d, "nation").select(k.alias("locality"), x.alias("x"), y.alias("y"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("s"))
    return s.select("locality", (F.col("s") + 1).alias("sample"), (F.col("x") + (F.col("s") % 3 - 1) * F.lit(0.02)).alias("lon"), (F.col("y") + (F.floor(F.col("s") / 3) - 1) * F.lit(0.02)).alias("lat"))


#: request_id, destination, max_commute, budget, layout, preferences (axis: importance).
REQUESTS = [
    (1, 0, 45, 200000, "1LDK", {"supermarkets": "high", "quietness": "medium"}),
    (2, 25, 60, 150000, "1K", {"restaurants": "essential", "late_night": "low", "konbini": "low"}),
    (3, 50, 30, 300000, "2LDK", {"cuisine_variety": "medium"}),
    (4, 75, 90, 90000, "1R", {"health": "high", "green_space": "high", "quietness": "essential", "supermarkets": "low", "konbini": "medium"}),
    (5, 0, 20, 120000, "1DK", {"quietness": "low"}),
    (6, 25, 10, 500000, "3LDK", {"supermarkets": "medium"}),
    (7, 50, 120, 30000, "3LDK", {"restaurants": "medium", "health": "low"}),
    (8, 75, 75, 250000, "2K_2DK", {"late_night": "essential", "cuisine_variety": "high"}),
]


def requests(spark) -> DataFrame:
    return spark.createDataFrame([(r, dest, float(c), float(b), lay) for r, dest, c, b, lay, _ in REQUESTS], "request_id long, dest long, max_commute double, budget double, layout string")


def preferences(spark) -> DataFrame:
    return spark.createDataFrame([(r, a, i) for r, *_, p in REQUESTS for a, i in p.items()], "request_id long, axis string, importance string")


#: Requests that break a rule: request_id, destination, point (lat, lon), max_commute, budget, layout, preferences, arrival.
FAULTY_REQUESTS = [
    (101, 0, (35.6, 139.7), 45.0, 200000.0, "1K", {"health": "low"}, "08:30"),
    (102, 0, None, 45.0, 200000.0, "1K", {}, "08:30"),
    (103, 25, None, 45.0, 200000.0, "1K", {"nothing": "low"}, "08:30"),
    (104, 25, None, 45.0, 0.0, "1K", {"health": "low"}, "08:30"),
    (105, 50, None, None, 200000.0, "1K", {"health": "low"}, "08:30"),
    (106, 50, None, 45.0, 200000.0, "1K", {"health": "low"}, "25:00"),
    (107, 75, None, 45.0, 200000.0, "9K", {"health": "low"}, "08:30"),
    (108, None, None, 45.0, 200000.0, "1K", {"health": "low"}, "08:30"),
]


def raw_requests(spark) -> DataFrame:
    """Requests as they come in, some of them faulty."""
    rows = [(r, dest, None, float(c), float(b), lay, p, "08:30") for r, dest, c, b, lay, p in REQUESTS] + FAULTY_REQUESTS
    flat = [(r, dest, *(point or (None, None)), c, b, lay, p, t) for r, dest, point, c, b, lay, p, t in rows]
    return spark.createDataFrame(flat, "request_id long, destination_id long, destination_lat double, destination_lon double, max_commute double, budget double, layout string, preferences map<string,string>, arrival_time string")
