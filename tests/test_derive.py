"""Steps of a run, what they need, and the cards and regions made from it."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise import config
from wardwise.operators import cards, quality, spatial
from wardwise.plans import derive
from wardwise.sources import maps

RINGS = "region_id long, part int, ring array<struct<lon:double,lat:double>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_ward_names(spark):
    rows = spark.createDataFrame([({"ward_code": "13113", "name_ja": "渋谷区"},), ({"N03_007": "13101", "N03_004": "千代田区", "name_en": "Own"},), ({"ward_code": "99999", "name_ja": "x"},), ({"name_ja": "y"},), ({},)], "tags map<string,string>")
    ok, bad = maps.ward_names(rows)
    assert {(r.ward_code, r.name_en) for r in ok.collect()} == {("13113", "Shibuya"), ("13101", "Own")}
    assert sorted(r.reason for r in bad.collect()) == ["English name", "code", "code"]
    assert len(config.WARD_NAMES) == 23


def test_thin_regions_get_all_their_samples(spark):
    """A diagonal strip that random places of its bounds nearly never meet."""
    strip = [(139.0, 35.0), (139.00001, 35.0), (139.10001, 35.1), (139.1, 35.1)]
    edges = spatial.ring_edges(spark.createDataFrame([(1, 0, strip), (2, 0, box(139.2, 35.2, 139.3, 35.3))], RINGS))
    out = spatial.sample_region(edges).cache()
    assert {r.region_id: r.n for r in out.groupBy("region_id").agg(F.count_distinct("sample", "lon", "lat").alias("n")).collect()} == {1: 9, 2: 9}
    hit = spatial.contained(out.select(F.struct("region_id", "sample").alias("point_id"), "lon", "lat"), edges).where("point_id.region_id = region_id")
    assert hit.count() == 18


def inside(r, *boxes):
    return any(x0 < r.lon < x1 and y0 < r.lat < y1 for x0, y0, x1, y1 in boxes)


def test_samples_lie_in_homes_where_there_are_any(spark):
    regions = [(k, 0, box(2.0 * k, 0.0, 2.0 * k + 1, 1.0)) for k in range(7)]
    at = {
        0: [(0.6, 0.1, 0.9, 0.8)],
        1: [],  # whole region
        2: [(0.41, 0.37, 0.51, 0.47)],  # a hundredth
        3: [(0.05, 0.05, 0.25, 0.25), (0.6, 0.5, 0.9, 0.9)],  # of two islands the larger
        4: [(0.1, 0.1, 0.4, 0.4), (0.35, 0.3, 0.65, 0.6), (0.7, 0.62, 0.99, 0.99)],  # two that overlap are more than one larger
        5: [(0.111, 0.111, 0.1113, 0.1112), (0.9, 0.9, 0.9003, 0.9004)],  # far from each other and smaller than a cell
        6: [(0.9, -3.0, 4.0, 4.0)],  # mostly outside
    }
    homes = [(10 * k + i, 0, box(2.0 * k + b[0], b[1], 2.0 * k + b[2], b[3])) for k, boxes in at.items() for i, b in enumerate(boxes)]
    edges, homes = (spatial.ring_edges(spark.createDataFrame(x, RINGS)) for x in (regions, homes))
    got = {}
    for r in spatial.sample_homes(edges, homes).collect():
        got.setdefault(r.region_id, []).append(r)
    want = {0: at[0], 1: [(0, 0, 1, 1)], 2: at[2], 3: at[3][1:], 4: at[4][:2], 5: at[5][1:], 6: [(0.9, 0.0, 1.0, 1.0)]}
    assert set(got) == set(want)
    for k, rows in got.items():
        assert [r.sample for r in sorted(rows, key=lambda r: (r.lon, r.lat))] == list(range(1, 10)) and len({(r.lon, r.lat) for r in rows}) == 9
        assert all(inside(r, *[(2.0 * k + x0, y0, 2.0 * k + x1, y1) for x0, y0, x1, y1 in want[k]]) for r in rows), k
        assert {r.in_homes for r in rows} == {k != 1}
    assert len({round(r.lat * 3) for r in got[1]}) > 2 and len({round(r.lon * 3) for r in got[1]}) > 2  # spread over it
    none = spatial.sample_homes(edges, homes.limit(0)).collect()
    assert len(none) == 63 and not any(r.in_homes for r in none)


def test_largest_piece_of_a_mask():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.55, 0.7):
        mask = rng.random((24, 24)) < share
        seen, pieces = set(), []
        for cell in zip(*np.nonzero(mask)):
            if cell not in seen:
                piece, stack = set(), [cell]
                while stack:
                    x, y = stack.pop()
                    if (x, y) in piece or not (0 <= x < 24 and 0 <= y < 24 and mask[x, y]):
                        continue
                    piece.add((x, y))
                    stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
                seen |= piece
                pieces.append(piece)
        assert set(zip(*np.nonzero(spatial.component_of(mask)))) == max(pieces, key=len)


def test_thin_regions_have_samples_too(spark):
    strip = [(139.0, 35.0), (139.00001, 35.0), (139.10001, 35.1), (139.1, 35.1)]
    edges = spatial.ring_edges(spark.createDataFrame([(1, 0, strip)], RINGS))
    out = spatial.sample_homes(edges, edges).cache()
    assert out.count() == 9
    assert spatial.contained(out.select(F.struct("region_id", "sample").alias("point_id"), "lon", "lat"), edges).count() == 9


def test_largest_parts_dissolve_clip_and_probe(spark):
    rings = spark.createDataFrame([(1, 0, box(0.0, 0.0, 1.0, 1.0)), (1, 0, box(0.1, 0.1, 0.9, 0.9)), (1, 1, box(2.0, 0.0, 2.8, 0.8)), (2, 0, box(5.0, 5.0, 6.0, 6.0)), (2, 3, box(7.0, 5.0, 8.0, 6.0))], RINGS)
    assert sorted((r.region_id, r.part) for r in spatial.largest_parts(rings).collect()) == [(1, 1), (2, 0)]
    keys = spark.createDataFrame([(1, 9), (2, 9)], "region_id long, key long")
    whole = spatial.ring_edges(spatial.dissolved(rings, keys))
    points = spark.createDataFrame([(1, 0.05, 0.05), (2, 0.5, 0.5), (3, 2.5, 0.5), (4, 5.5, 5.5), (5, 4.0, 4.0)], "point_id long, lon double, lat double")
    assert sorted(r.point_id for r in spatial.contained(points, whole).collect()) == [1, 3, 4]
    clip = spatial.ring_edges(spark.createDataFrame([(9, 0, box(-1.0, -1.0, 2.6, 2.0))], RINGS))
    assert sorted(r.point_id for r in spatial.clipped(points, whole, clip).collect()) == [1, 3]
    segments = spark.createDataFrame([(1, 1, 0.05, 0.05, 9.0, 9.0), (1, 2, 9.0, 9.0, 9.5, 9.0), (2, 1, 4.0, 4.0, 0.05, 0.05), (3, 1, 20.0, 20.0, 21.0, 20.0)], "line_id long, seq int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.lines_from(segments, whole, (19.0, 19.0, 20.5, 20.5)).collect()
    assert sorted((r.line_id, r.seq) for r in got) == [(1, 1), (1, 2), (3, 1)]


def test_sources_and_prerequisites(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "source string") for v in (["mlit", "seed", "seed", None], ["fixture"]))
    assert {(r.table, r.source, r.n) for r in quality.forbidden_sources({"a": a, "b": b}, config.FORBIDDEN_SOURCES).collect()} == {("a", "seed", 2), ("b", "fixture", 1)}
    old = spark.createDataFrame([(1, "seed"), (2, "mlit"), (3, "seed")], "id long, source string")
    new = spark.createDataFrame([(1, "mlit"), (1, "mlit"), (2, "mlit"), (4, "mlit")], "id long, source string")
    assert [tuple(r) for r in quality.taken_over(old, new, ["id"]).collect()] == [("seed", "mlit", 1)]
    checks = [("rent", "ward", a.where("source is null")), ("rent", "price", a.where("false")), ("names", "code", b)]
    assert [tuple(r) for r in quality.prerequisites(checks).collect()] == [("rent", "ward", 1, False), ("rent", "price", 0, True), ("names", "code", 1, False)]
    with pytest.raises(ValueError, match="rent cannot run yet, ward: 1 rows"):
        quality.require(checks, "rent")
    quality.require(checks, "other")


def test_steps_run_on_the_tables_of_earlier_ones(spark, tmp_path):
    raw = tmp_path / "sf"
    spark.range(4).write.parquet(f"{raw}/numbers.parquet")
    calls = []

    def step(name, build, reads=(), raw=(), needs=lambda s, d, t: []):
        return derive.Step(name, lambda s, d, t: (calls.append(name), build(s, d, t))[1], ("id",), reads, raw, needs)

    positive = lambda s, d, t: [("three", "rows of one", t["one"].where("id < 0"))]
    steps = (step("one", lambda s, d, t: s.read.parquet(f"{d}/numbers.parquet"), raw=("numbers",)), step("two", lambda s, d, t: s.range(0)), step("three", lambda s, d, t: t["one"].where("id > 1"), ("one",), needs=positive))
    store = derive.Store(spark, f"file://{tmp_path}/store")

    def run(*args, **more):
        calls.clear()
        return [tuple(r)[1:] for r in derive.run_steps(spark, str(raw), store, *args, **more).collect()], list(calls)

    assert run(steps) == ([("one", 4, "written"), ("two", 0, "written"), ("three", 2, "written")], ["one", "two", "three"])
    assert run(steps) == ([("one", 4, "skipped"), ("two", 0, "skipped"), ("three", 2, "skipped")], [])
    assert run(steps, force=True)[0] == [("one", 4, "same"), ("two", 0, "same"), ("three", 2, "same")]
    spark.range(5, 7).write.mode("append").parquet(f"{raw}/numbers.parquet")
    assert run(steps) == ([("one", 6, "written"), ("two", 0, "skipped"), ("three", 4, "written")], ["one", "three"])
    assert run(steps, ["three"], force=True) == ([("three", 4, "same")], ["three"])
    spark.range(-3, -2).write.mode("append").parquet(f"{raw}/numbers.parquet")
    with pytest.raises(ValueError, match="three cannot run yet, rows of one: 1 rows"):
        run(steps)
    assert store.read("one").count() == 7 and store.read("three").count() == 4
    for bad, why in (((steps, ["four"]), "no such steps"), ((steps[::-1],), "not before it"), (((steps[0], step("x", lambda s, d, t: t["one"], ("two",)))[::1],), "not before it")):
        with pytest.raises(ValueError, match=why):
            run(*bad)
    with pytest.raises(ValueError, match="have not run"):
        derive.run_steps(spark, str(raw), derive.Store(spark, f"file://{tmp_path}/other"), steps, ["three"])


def test_cards_and_named_paths(spark):
    localities = spark.createDataFrame([(1, "a", 7, 0.5, 0.5), (2, "b", 8, 5.5, 5.5)], "locality long, name string, ward long, lon double, lat double")
    wards = spark.createDataFrame([(7, "W")], "ward long, ward_name string")
    rings = spark.createDataFrame([(1, 0, box(0.0, 0.0, 1.0, 1.0) + [(0.0, 0.0)])], RINGS)
    walks = spark.createDataFrame([(1, 1, 4, 9), (1, 2, 4, 6), (1, 1, 5, 7)], "locality long, sample int, station long, walk_min long")
    got = {r.locality: r for r in cards.locality_cards(localities, wards, rings, walks, spark.createDataFrame([(4, "S")], "station long, station_name string")).collect()}
    assert [tuple(x) for x in got[1].near] == [(6, 4, "S"), (7, 5, None)] and got[1].ward_name == "W"
    assert json.loads(got[1].polygon) == {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]}
    assert got[2].near == [] and got[2].polygon is None and got[2].ward_name is None
    paths = spark.createDataFrame([(1, [(4, 2), (9, None), (4, 3)])], "k long, path array<struct<node:long,line:long>>")
    named = cards.named_paths(paths, ["k"], spark.createDataFrame([(4, "S")], "node long, node_name string"), spark.createDataFrame([(2, "L")], "line long, line_name string")).first()
    assert [(h.node_name, h.line_name) for h in named.path] == [("S", "L"), ("9", None), ("S", "3")]


def test_lines_run_towards_their_larger_station_and_are_placed_once(spark, tmp_path, monkeypatch):
    """Stations 28,800 apart are at one place, so what follows what there depends on the way a line runs."""
    duckdb = pytest.importorskip("duckdb")
    from wardwise.plans import derive_sql

    spark.range(80).select(F.when(F.col("id") < 40, F.col("id")).otherwise(F.col("id") + 28760).alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(1).alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    placed, plain = [], spatial.positions_on_line
    monkeypatch.setattr(spatial, "positions_on_line", lambda points, segments, *a: placed.append(segments) or plain(points, segments, *a))
    got = sorted(map(tuple, derive.merged_topology(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    assert got == sorted(con.execute(derive_sql.SQL["merged_topology"]).fetchall()) and {r[2] for r in got} == {0, 1, 1440, 1441}
    assert {r.line_id for r in placed[0].collect()} == {0, 1}


def test_positions_are_made_in_many_tasks_and_not_sent_to_the_driver(spark):
    seg = spark.createDataFrame([(1, 1, 139.6, 35.5, 139.9, 35.8)], "line_id long, seq int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 139.7, 35.6)], "point_id long, lon double, lat double")
    plan = spatial.positions_on_line(pts, seg, 300.0)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastExchange" not in plan


def test_ends_without_a_point_come_last(spark):
    from wardwise.operators import lines

    rows = [(1, p, k, float(k - 1), float(p), float(k), float(p)) for p in (1, 2, 3, 4) for k in (1, 2)]
    chains = spark.createDataFrame(rows, "line_id long, part int, seq long, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(5, 0.0, 1.0), (9, 0.0, 1.0), (7, 2.0, 1.0), (7, 0.0, 2.0), (5, 2.0, 2.0), (6, 2.0, 2.0), (1, 2.0, 3.0)], "point_id long, lon double, lat double")
    first = {r.part: (r.x1, r.x2) for r in lines.directed(chains, pts).where("seq = 1").collect()}
    assert first == {1: (0.0, 1.0), 2: (2.0, 1.0), 3: (2.0, 1.0), 4: (0.0, 1.0)}
