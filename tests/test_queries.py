"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from wardwise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["amenity_counts_800m", "minmax_norm", "sufficiency_scores", "catchment_land_median", "ward_assignment", "points_in_any_region", "transfer_pairs", "latest_run", "rent_choice", "pair_travel_medians", "headways", "orphan_stations", "place_search", "sync_upsert", "array_union_upsert", "dq_report", "name_audit", "slug_ids", "commute_matrix", "graph_rejects", "resolved_names", "cube_read", "zones", "similar_part_names"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v if isinstance(v, (int, bool, type(None))) else str(v)


def same(spark, con, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == expected


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    same(spark, con, registry.QUERIES[name], registry.SQL[name])


def test_registry_is_whole(spark):
    assert set(registry.SQL) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_locality_scores_come_from_the_shares_of_their_samples(spark):
    from wardwise import config
    from wardwise.plans import queries

    edges = [r for r in queries._edges(spark, SF).collect()]
    lines = queries._grid_lines(spark, SF).collect()
    got = {r.axis: r.score for r in registry.QUERIES["locality_scores"](spark, SF).where("locality = 12").collect()}
    shares = {"residential": [], "exposure": [], "green": []}
    for s in queries.sample_places(spark, SF).where("region_id = 12").collect():
        hits = dict.fromkeys(shares, 0)
        for i in range(1024):
            r, a = 800 * math.sqrt((i + 0.5) / 1024), i * 2.399963229728653
            lat, lon = s.lat + r * math.sin(a) / 111320, s.lon + r * math.cos(a) / 111320 / math.cos(math.radians(s.lat))
            inside = {}
            for e in edges:
                if (e.y1 > lat) != (e.y2 > lat) and lon < e.x1 + (lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1):
                    inside[e.region_id] = not inside.get(e.region_id, False)
            hits["residential"] += any(v and k % 2 == 0 for k, v in inside.items())
            hits["green"] += any(v and k % 3 == 0 for k, v in inside.items())
            kx, ky, near = 111320 * math.cos(math.radians(lat)), 111320, False
            for x in lines:
                ax, ay, dx, dy = (x.x1 - lon) * kx, (x.y1 - lat) * ky, (x.x2 - x.x1) * kx, (x.y2 - x.y1) * ky
                t = min(1, max(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
                near = near or math.hypot(ax + t * dx, ay + t * dy) <= 100
            hits["exposure"] += near
        for k in shares:
            shares[k].append(hits[k] / 1024)
    m = {k: sorted(v)[4] for k, v in shares.items()}
    green = min(100, 100 * math.log1p(m["green"]) / math.log1p(config.TARGETS["green_space"]))
    assert abs(got["green_space"] - green) < 1
    base = 100 * (0.5 * m["residential"] + 0.3 * (1 - m["exposure"]))
    assert base - 1 < got["quietness"] < base + 21
    assert len({r.score for r in registry.QUERIES["locality_scores"](spark, SF).where("axis = 'green_space'").collect()}) > 1
