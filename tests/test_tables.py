"""Table maintenance, quality rules, sources and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wardwise.operators import quality, tables
from wardwise.sources import maps, tabular, timetable
from wardwise.streaming.maintenance import keep_upserted


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_and_syncs(spark):
    schema = "k int, line string, source string, v int"
    cur = spark.createDataFrame([(1, None, "a", 1), (2, "x", "a", 2), (3, "x", "b", 3)], schema)
    inc = spark.createDataFrame([(1, None, "a", 10), (4, "x", "a", 4)], schema)
    assert rows(tables.upsert(cur, inc, ["k", "line"])) == rows(spark.createDataFrame([(1, None, "a", 10), (2, "x", "a", 2), (3, "x", "b", 3), (4, "x", "a", 4)], schema))
    once = tables.sync(cur, inc, ["k", "line"], "a")
    assert {r.k for r in once.collect()} == {1, 3, 4} and rows(tables.sync(once, inc, ["k", "line"], "a")) == rows(once)
    assert rows(tables.stale(cur, inc, ["k", "line"], "a")) == [(2, "x")]
    assert {r.k for r in tables.replace_source(cur, inc, "a").collect()} == {1, 3, 4}


def test_versions_keep_the_old_table_when_a_write_fails(spark, tmp_path):
    t = tables.Versions(spark, str(tmp_path / "t"))
    t.write(spark.range(3))
    with pytest.raises(Exception):
        t.write(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")))
    assert t.current() == 1 and t.read().count() == 3
    t.write(t.read().where("id > 0"))
    assert t.current() == 2 and t.read().count() == 2


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert tables.run_ledgered(spark, path, "s", "2024-01-01", lambda: 7) == 7
    with pytest.raises(ValueError):
        tables.run_ledgered(spark, path, "s", "2024-01-02", lambda: (_ for _ in ()).throw(ValueError("bad")))
    assert [(r.status, r.rows, r.error) for r in spark.read.parquet(path).orderBy("started_at").collect()] == [("success", 7, None), ("failed", None, "bad")]


def test_rules(spark):
    df = spark.createDataFrame([("a", 1), ("", 2), (None, None)], "name string, v int")
    ok, bad = quality.split_rejects(df, quality.not_empty("name") | {"v": F.col("v") < 2})
    assert rows(ok) == [("a", 1)] and sorted(len(r.reasons) for r in bad.collect()) == [2, 2]
    assert quality.share(df.limit(0), F.lit(True)).first().share == 0.0
    found = spark.createDataFrame([(1,), (1,), (5,)], "c int")
    assert rows(quality.coverage(found, spark.createDataFrame([(1,), (2,)], "c int"), "c")) == [(1, "repeated"), (2, "missing"), (5, "unknown")]


def test_stream_upserts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v int, t int"
    spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 5, 1)], schema).coalesce(1).write.parquet(src)
    keep_upserted(spark.readStream.schema(schema).parquet(src), out, ["k"], "t", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, 6, 3)], schema).write.mode("append").parquet(src)
    keep_upserted(spark.readStream.schema(schema).parquet(src), out, ["k"], "t", str(tmp_path / "cp")).awaitTermination()
    assert rows(tables.Versions(spark, out).read()) == [(1, 2, 2), (2, 6, 3)]


def test_geojson(spark, tmp_path):
    feature = lambda p, g: {"type": "Feature", "properties": p, "geometry": g}
    a = tmp_path / "a.geojson"
    a.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature({"name": "Shibuya Station", "id": "s1"}, {"type": "Point", "coordinates": [139.7, 35.65]}),
        feature({"KEY_CODE": "13113001", "S_NAME": "神南二丁目"}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}),
        feature({"KEY_CODE": "14113001", "S_NAME": "x"}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1]]]]}),
        feature({"l": "1"}, {"type": "LineString", "coordinates": [[0, 0], [1, 0], [2, 0]]}),
    ]}))
    f = maps.features(spark, str(a))
    assert f.count() == 4
    s = maps.station_rows(f).first()
    assert (s.id, s.name_key, s.lon, s.lat) == ("s1", "shibuya", 139.7, 35.65)
    t = maps.towns(f).collect()
    assert [(r.ward_code, r.name_ja, len(r.ring)) for r in t] == [("13113", "神南", 4)] and t[0].region_id == "13113:" + hashlib.sha256("神南".encode()).hexdigest()[:16]
    assert maps.segments(f).count() == 2
    b = tmp_path / "b.geojson"
    b.write_text('{"type": "Feature", "features": []}')
    with pytest.raises(Exception):
        maps.features(spark, str(b)).collect()


def test_map_elements(spark, tmp_path):
    ring = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 1.0}, {"lat": 1.0, "lon": 0.0}]
    e = [
        {"type": "node", "id": 1, "lat": 35.6, "lon": 139.7, "tags": {"shop": "bakery", "amenity": "cafe"}},
        {"type": "way", "id": 2, "center": {"lat": 35.6, "lon": 139.7}, "tags": {"amenity": "pub", "name": "P"}},
        {"type": "node", "id": 3, "tags": {"amenity": "clinic"}},
        {"type": "way", "id": 4, "geometry": ring, "tags": {"highway": "primary", "leisure": "park"}},
        {"type": "way", "id": 5, "geometry": ring, "tags": {"leisure": "park"}},
        {"type": "relation", "id": 6, "members": [{"type": "way", "ref": 9, "role": "outer", "geometry": ring}, {"type": "way", "ref": 8, "role": "inner", "geometry": ring}], "tags": {"leisure": "garden"}},
        {"type": "node", "id": 7, "lat": 1.0, "lon": 1.0, "tags": {"office": "company"}},
    ]
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"osm3s": {"timestamp_osm_base": "2024-01-01T00:00:00Z"}, "elements": e}))
    c = maps.elements(spark, str(p))
    assert rows(c.select("id", "kind", "category")) == [(1, "poi", "grocery"), (2, "poi", "bar"), (3, "poi", "health"), (4, "road", "primary"), (5, "green", "park"), (6, "green", "garden"), (7, "unmapped", None)]
    ok, bad = maps.map_pois(c)
    assert {r.osm_id for r in ok.collect()} == {1, 2} and {r.osm_id for r in bad.collect()} == {3}
    assert maps.map_roads(c).count() == 2 and maps.map_greens(c).count() == 2


def test_rent_tables(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes("地域コード,地域,家賃(1平方m当たり),共益費・サービス費,標本数\r\n13113,渋谷区,\"4,500\",,12\r\n,新宿区,3000,100,\r\n99999,どこか,3000,,1\r\n13104,新宿区,5,,1\r\n".encode("shift_jis"))
    wards = spark.createDataFrame([("13113", "渋谷区"), ("13104", "新宿区")], "ward_code string, name string")
    out = tabular.yearly_rents(tabular.as_tags(tabular.delimited(spark, str(p), "Shift_JIS")), wards, "2023")
    assert rows(out.select("ward_code", "rent_per_sqm_yen", "management_fee_yen", "sample_count", "reason")) == [("13104", 3000.0, 100.0, None, None), ("13104", 5.0, 0.0, 1, "rent"), ("13113", 4500.0, 0.0, 12, None), (None, 3000.0, 0.0, 1, "ward")]
    q = tmp_path / "q.csv"
    q.write_text("地域コード,地域,year,quarter,rent_per_sqm_yen,management_fee_yen,sample_count\n13113,x,2026,2,4000,0,3\n13113,x,2026,7,4000,0,3\n")
    got = rows(tabular.quarterly_rents(tabular.as_tags(tabular.delimited(spark, str(q))), wards).select("period", "reason"))
    assert got == [("2026Q2", None), ("2026Q7", "period")]
    cube = tmp_path / "c.json"
    cell = {"@area": "13113", "@tab": "1", "@unit": "円", "$": "4,321"}
    for value in (cell, [cell, cell | {"@area": "13104"}]):
        cube.write_text(json.dumps({"GET_STATS_DATA": {"STATISTICAL_DATA": {"TABLE_INF": {"@id": "t"}, "DATA_INF": {"VALUE": value}}}}, ensure_ascii=False))
        assert {r.value for r in tabular.statistics_cube(spark, str(cube)).collect()} == {4321.0}


def test_names_and_catalogue(spark, tmp_path):
    towns = spark.createDataFrame([("w", "a"), ("w", "b"), ("w", "c"), ("w", "d")], "ward_ja string, town_ja string")
    index = spark.createDataFrame([("w", "a", "A"), ("w", "b", "B1"), ("w", "b", "B2"), ("w", "d", "Ā")], "ward_ja string, town_ja string, town_en string")
    over = spark.createDataFrame([("w", "b", "Bee"), ("w", "z", "Zed")], "ward_ja string, town_ja string, town_en string")
    got = {r.town_ja: (r.town_en, r.problem) for r in tabular.resolved_names(towns, index, over).collect()}
    assert got == {"a": ("A", None), "b": ("Bee", None), "c": (None, "missing"), "d": ("Ā", "invalid"), "z": (None, "unused")}
    f = tmp_path / "files"
    f.mkdir()
    (f / "x.zip").write_bytes(b"x")
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"version": 1, "datasets": [{"id": "x", "file": "x.zip", "url": "u", "sha256": hashlib.sha256(b"x").hexdigest()}, {"id": "y", "file": "y.zip", "url": "u", "sha256": "0"}, {"id": "y", "file": "", "url": "u", "sha256": "0"}]}))
    m = tabular.catalogue(spark, str(c))
    assert sorted(str(r.problem) for r in m.collect()) == ["None", "empty", "repeated"]
    assert {r.status for r in tabular.checksums(spark, str(f), m.where("problem is null")).collect()} == {"ok"}


def test_timetable_feed(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,parent_station\nA,Shibuya Station,35.6580,139.7016,\nA1,Shibuya,35.6581,139.7017,A\nG,Ghost,0,0,\n")
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20240101,20241231\nWE,0,0,0,0,0,1,1,20240101,20241231\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\nX,20240103,1\nY,20240106,1\nWE,20240103,1\n")
    feed = lambda n: timetable.feed(spark, str(tmp_path), n)
    assert {r.service_id for r in timetable.weekday_services(feed("calendar"), feed("calendar_dates")).collect()} == {"WD", "X"}
    stations = spark.createDataFrame([(7, "shibuya", 139.7015, 35.6581)], "id long, name_key string, lon double, lat double")
    known = spark.createDataFrame([], "source_id string, station long")
    assert {r.stop_id: r.station for r in timetable.matched_stops(feed("stops"), stations, known).collect()} == {"A": 7, "A1": 7, "G": None}
    (tmp_path / "calendar_dates.txt").unlink()
    assert feed("calendar_dates").count() == 0
    routes = spark.createDataFrame([("r1", "Ginza", "x"), ("9", "y", "z")], "route_id string, route_short_name string, route_long_name string")
    lines = spark.createDataFrame([("9", ["q"]), ("5", ["GINZA"]), ("6", ["ginza"])], "line string, names array<string>")
    assert {r.route_id: r.line for r in timetable.mapped_routes(routes, lines).collect()} == {"r1": "5", "9": "9"}


def test_geojson_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 139.7, 35.6)], "name string, lon double, lat double")
    maps.as_features(df, maps.point_geometry(F.col("lon"), F.col("lat")), "name").write.text(str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [139.7, 35.6]}, "properties": {"name": "a"}}


def test_periods_arrays_guards_and_backfill(spark):
    stats = spark.createDataFrame([("w1", "a", "2023", 1), ("w2", "a", "2023", 2), ("w1", "a", "2022", 3), ("w1", "b", "2023", 4)], "ward string, source string, period string, v int")
    new = spark.createDataFrame([("w1", "a", "2023", 9)], stats.schema)
    assert rows(tables.sync_periods(stats, new, ["ward", "source", "period"])) == [("w1", "a", "2022", 3), ("w1", "a", "2023", 9), ("w1", "b", "2023", 4)]
    a = spark.createDataFrame([(1, ["x"]), (2, None)], "k int, aliases array<string>")
    b = spark.createDataFrame([(1, ["y", "x"]), (3, ["z"])], "k int, aliases array<string>")
    assert {r.k: r.aliases for r in tables.union_arrays(a, b, "k", "aliases").collect()} == {1: ["x", "y"], 2: [], 3: ["z"]}
    gone = spark.createDataFrame([(1,)], "k int")
    assert rows(tables.blocked(gone, {"t.kk": spark.createDataFrame([(1,), (1,), (None,)], "kk int")}, "k")) == [("t", 2)]
    names = spark.createDataFrame([(1, None), (2, "old"), (3, "same")], "k int, name_en string")
    table, report = tables.backfill(names, spark.createDataFrame([(1, "one"), (2, "two"), (3, "same")], names.schema), "k", "name_en")
    assert rows(table) == [(1, "one"), (2, "two"), (3, "same")] and tuple(report.first()) == (3, 2, 1)


def test_nullable_references_and_values_filled_in_all_or_none(spark):
    rows_ = spark.createDataFrame([(1, 7, 8), (2, 9, 7), (3, None, 9)], "id int, a int, b int")
    gone = spark.createDataFrame([(7,), (7,), (8,)], "k int")
    assert sorted(map(tuple, tables.without_references(rows_, gone, {"a": "k", "b": "k"}).collect())) == [(1, None, None), (2, 9, None), (3, None, 9)]
    names = spark.createDataFrame([(1, None), (2, "two")], "k int, name_en string")
    latin = F.col("name_en").rlike("^[a-z]+$")
    new = lambda *x: spark.createDataFrame(list(x), names.schema)
    bad = new((1, "one"), (2, "x"), (2, "y"), (3, "three"), (1, "one"))
    assert sorted(map(tuple, tables.backfill_problems(names, bad, "k", "name_en", latin).collect())) == [(1, "repeated"), (2, "repeated"), (3, "unknown")]
    with pytest.raises(ValueError, match="1 invalid, 1 unknown"):
        tables.backfill_checked(names, new((1, "渋谷"), (5, "five")), "k", "name_en", latin)
    table, report = tables.backfill_checked(names, new((1, "one")), "k", "name_en", latin)
    assert sorted(map(tuple, table.collect())) == [(1, "one"), (2, "two")] and report.first().updated == 1


def test_fees_that_are_no_numbers_reject_the_row(spark):
    tags = [{"code": "13101", "period": "2023Q1", "rent_per_sqm_yen": "3,000", "management_fee_yen": fee} if fee is not None else {"code": "13101", "period": "2023Q1", "rent_per_sqm_yen": "3,000"} for fee in ("1,000", "", None, "n/a", "-")]
    wards = spark.createDataFrame([("13101", "千代田区")], "ward_code string, name string")
    got = tabular.quarterly_rents(spark.createDataFrame([(t,) for t in tags], "tags map<string,string>"), wards).select("management_fee_yen", "reason")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1000.0, None), (0.0, None), (0.0, None), (None, "fee"), (None, "fee")], key=repr)


def test_short_texts_are_searched_by_their_own_length(spark):
    from wardwise.operators import search

    places = spark.createDataFrame([("p1", "poi", "Ab cd", ["x"]), ("p2", "station", "b", None), ("p3", "poi", None, ["zab"])], "place_id string, kind string, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "b"), (2, "AB"), (3, "b cd"), (4, ""), (5, None), (6, "q")], "query_id int, query string")
    got = {}
    for r in search.place_search(asked, places).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.place_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["p1", "p2", "p3"], 2: ["p1", "p3"], 3: ["p1"]} and got[1][0] == "p2"
