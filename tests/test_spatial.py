"""Spatial joins against brute force and analytic shapes."""

import math
import random

from pyspark.sql import functions as F

from wardwise.functions.geo import haversine_m
from wardwise.operators import metrics, spatial


def star(cx, cy, r, n, phase):
    return [(cx + (r if i % 2 else r / 2.3) * math.cos(phase + i * math.pi / n), cy + (r if i % 2 else r / 2.3) * math.sin(phase + i * math.pi / n)) for i in range(2 * n)]


def inside(x, y, rings):
    c = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                c = not c
    return c


def test_containment_equals_brute_force(spark):
    random.seed(5)
    regions = {}
    for k in range(6):
        cx, cy = random.uniform(139.6, 139.8), random.uniform(35.5, 35.7)
        outer = star(cx, cy, random.uniform(0.03, 0.09), 5, k)
        hole = star(cx, cy, 0.008, 4, 1)
        regions[k] = [[outer, hole]] + ([[star(cx + 0.2, cy, 0.02, 6, 0)]] if k == 0 else [])
    rows = [(k, p, [(float(x), float(y)) for x, y in ring]) for k, parts in regions.items() for p, rings in enumerate(parts) for ring in rings]
    edges = spatial.ring_edges(spark.createDataFrame(rows, "region_id int, part int, ring array<struct<lon:double,lat:double>>"))
    pts = [(i, random.uniform(139.5, 140.1), random.uniform(35.4, 35.8)) for i in range(800)]
    got = {(r.point_id, r.region_id) for r in spatial.contained(spark.createDataFrame(pts, "point_id int, lon double, lat double"), edges).collect()}
    assert got == {(i, k) for i, x, y in pts for k, parts in regions.items() if any(inside(x, y, rings) for rings in parts)} and got


def test_radius_join_equals_brute_force_and_is_an_equi_join(spark):
    random.seed(6)
    pts = [(i, 139.6 + random.random() / 20, 35.6 + random.random() / 20) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    pairs = spatial.self_pairs(df, 500.0, haversine_m)

    def dist(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert {(r.a_id, r.b_id) for r in pairs.collect()} == {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and dist(a, b) <= 500}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shares_of_a_half_plane(spark):
    at = spark.createDataFrame([(1, 139.7, 35.6), (2, 139.9, 35.6)], "anchor_id int, alon double, alat double")
    ring = [(139.7, 35.5), (139.8, 35.5), (139.8, 35.7), (139.7, 35.7)]
    edges = spatial.ring_edges(spark.createDataFrame([(1, 0, ring), (2, 0, ring)], "region_id int, part int, ring array<struct<lon:double,lat:double>>"))
    got = {r.anchor_id: r.share for r in spatial.coverage_share(at, edges, 800.0).collect()}
    assert abs(got[1] - 0.5) < 0.01 and got[2] == 0
    line = spark.createDataFrame([(139.7, 35.5, 139.7, 35.7)], "x1 double, y1 double, x2 double, y2 double")
    share = {r.anchor_id: r.share for r in spatial.near_line_share(at, line, 800.0, 100.0).collect()}
    x = 100 / 800
    exact = 2 / math.pi * (x * math.sqrt(1 - x * x) + math.asin(x))
    assert abs(share[1] - exact) < 0.015 and share[2] == 0


def test_samples_lie_inside_and_repeat(spark):
    rows = [(1, 0, [(139.7, 35.6), (139.72, 35.6), (139.7, 35.62)])]
    edges = spatial.ring_edges(spark.createDataFrame(rows, "region_id int, part int, ring array<struct<lon:double,lat:double>>"))
    a, b = (sorted(map(tuple, spatial.sample_region(edges).collect())) for _ in range(2))
    assert a == b and [r[1] for r in a] == list(range(1, 10)) and all(inside(x, y, [rows[0][2]]) for _, _, x, y in a)
    p = spatial.interior_point(edges).first()
    assert inside(p.lon, p.lat, [rows[0][2]])


def test_rings_and_lines(spark):
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), (2, [(0.0, 0.0), (1.0, 1.0)]), (3, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (4, [])], "id int, ring array<struct<lon:double,lat:double>>")
    assert [r.usable for r in spatial.usable_rings(rings).orderBy("id").collect()] == [True, False, False, False]
    seg = spark.createDataFrame([(1, 1, 139.7, 35.6, 139.71, 35.6), (1, 2, 139.71, 35.6, 139.72, 35.6)], "line_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    c = spatial.line_centre(seg, ["line_id"]).first()
    assert abs(c.lon - 139.71) < 1e-9
    pts = spark.createDataFrame([(1, 139.703, 35.6001), (2, 139.715, 35.5999), (3, 139.9, 35.6)], "point_id int, lon double, lat double")
    pos = {r.point_id: r.pos_m for r in spatial.positions_on_line(pts, seg, 300.0).collect()}
    assert set(pos) == {1, 2} and abs(pos[1] / c.length_m - 0.15) < 0.001 and abs(pos[2] / c.length_m - 0.75) < 0.001


def test_long_segments_go_to_the_cells_near_them(spark):
    r = random.Random(8)
    ends = [(139.6, 35.5, 139.9, 35.8), (139.9, 35.52, 139.6, 35.6), (139.7, 35.8, 139.7, 35.5), (139.75, 35.5, 139.7500001, 35.8), (139.6, 35.7, 139.9, 35.7), (139.65, 35.65, 139.65, 35.65)]
    seg = spark.createDataFrame([(k, 1, *e) for k, e in enumerate(ends)], "line_id long, seq int, x1 double, y1 double, x2 double, y2 double")
    assert spatial.line_cells(seg.where("line_id = 0"), 300.0).count() < 400  # of 3,800 in its bounds
    xy = [(139.55 + 0.4 * r.random(), 35.45 + 0.4 * r.random()) for _ in range(700)]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(xy + xy[:50])], "point_id long, lon double, lat double")
    far = F.col("line_m") <= 300.0
    d = spatial.segment_distance_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))
    want = {(x.line_id, x.point_id) for x in pts.crossJoin(seg).withColumn("line_m", d).where(far).collect()}
    assert want and {(x.line_id, x.point_id) for x in spatial.near_lines(pts, seg, 300.0).collect()} == want
    assert sorted((x.line_id, x.point_id) for x in spatial.positions_on_line(pts, seg, 300.0).collect()) == sorted(want)


def test_nearest_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, 139.7, 35.6)], "anchor_id int, alon double, alat double")
    p = spark.createDataFrame([(i, 139.7 + d, 35.6) for i, d in ((5, 0.001), (3, 0.001), (2, 0.002), (1, 0.1))], "id int, lon double, lat double")
    assert [(r.id, r.rank) for r in spatial.nearest(a, p, 3, 1500.0).orderBy("rank").collect()] == [(3, 1), (5, 2), (2, 3)]
    assert spatial.canvas(p).select(F.max("x")).first()[0] == 1000.0


def test_radius_pairs_at_any_latitude(spark):
    r = random.Random(3)
    for lat in (-71.0, 0.0, 60.0, 85.0):
        wide = 0.02 / max(0.05, math.cos(math.radians(lat)))
        pts = [(i, 10 + r.uniform(-wide, wide), lat + r.uniform(-0.02, 0.02)) for i in range(250)]
        df = spark.createDataFrame(pts, "id long, lon double, lat double")
        got = {(x.a_id, x.b_id) for x in spatial.self_pairs(df, 800).collect()}
        a, b = df.selectExpr("id as a", "lon as alon", "lat as alat"), df.selectExpr("id as b", "lon", "lat")
        every = a.crossJoin(b).where("a <> b").where(spatial.geo_dist_m(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon")) <= 800)
        assert got == {(x.a, x.b) for x in every.select("a", "b").collect()} and got


def test_rows_of_one_place_are_looked_at_once(spark, monkeypatch):
    """Many anchors and points at few places: pairs follow the places, and results are those of all rows."""
    rng = random.Random(9)
    spots = [(139.7 + rng.random() * 0.02, 35.6 + rng.random() * 0.02) for _ in range(12)]
    at = [(i, *spots[i % 4]) for i in range(40)] + [(90, None, 35.6)]
    pts = [(*rng.choice(spots), rng.choice("xyz"), float(rng.randrange(50))) for _ in range(300)] + [(None, None, "x", 1.0)]
    anchors, points = spark.createDataFrame(at, "anchor_id int, alon double, alat double"), spark.createDataFrame(pts, "lon double, lat double, kind string, price double")
    met, plain = [], spatial.near
    monkeypatch.setattr(spatial, "near", lambda *a: (met.append(plain(*a)), met[-1])[1])
    here = {"n": F.count("*"), "kinds": F.collect_set("kind"), "prices": F.collect_list("price")}
    over = {"n": F.sum("n"), "kinds": F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))), "prices": F.sort_array(F.flatten(F.collect_list("prices")))}
    got = {r.anchor_id: (r.n, r.kinds, r.median) for r in spatial.near_by_place(anchors, points, 800.0, here, over).withColumn("median", metrics.median_of_sorted(F.col("prices"))).collect()}
    assert 0 < met[0].count() <= 4 * 12
    rows = plain(anchors, points, 800.0).groupBy("anchor_id").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("k"), F.percentile("price", 0.5).alias("m")).collect()
    assert got == {r.anchor_id: (r.n, r.k, r.m) for r in rows} | {90: (None, None, None)}
    assert spatial._lattices(anchors.where("alon is not null"), 800.0, 64).count() == 4 * 64


def test_a_task_has_as_many_lattice_points_however_many_places_there_are(spark):
    at = spark.createDataFrame([(139.6 + i / 2000, 35.6) for i in range(640)], "alon double, alat double")
    dealt = spatial._lattices(at, 800.0, 1024)
    assert dealt.count() == 640 * 1024 and dealt.rdd.getNumPartitions() == 640 * 1024 // spatial.TASK_POINTS > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_medians_and_not_prices_go_to_the_anchors(spark):
    anchors = spark.createDataFrame([(1, 139.7, 35.6), (2, 139.7, 35.6), (3, 139.9, 35.6)], "anchor_id int, alon double, alat double")
    points = spark.createDataFrame([(139.7, 35.6, 3.0), (139.7, 35.6, 1.0), (139.701, 35.6, 8.0)], "lon double, lat double, v double")
    over = {"all": F.sort_array(F.flatten(F.collect_list("vs")))}
    got = spatial.near_by_place(anchors, points, 800.0, {"vs": F.collect_list("v")}, over, {"median": metrics.median_of_sorted(F.col("all"))})
    assert got.columns == ["anchor_id", "alon", "alat", "median"] and sorted((r.anchor_id, r.median) for r in got.collect()) == [(1, 3.0), (2, 3.0), (3, None)]
    assert "all" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
