"""Commutes on tiny graphs against a textbook search, timetable statistics, components."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from wardwise.operators import graph, transit

EDGES = "from_id long, to_id long, line long, kind string, minutes double, wait double, confidence int"


def textbook(edges, seeds):
    best, heap = {}, []
    for node, walk in seeds:
        heapq.heappush(heap, (walk, node, -1))
    while heap:
        total, node, line = heapq.heappop(heap)
        if (node, line) in best:
            continue
        best[node, line] = total
        for f, t, l, kind, m, w, _ in edges:
            if t != node:
                continue
            if kind == "transfer":
                heapq.heappush(heap, (total + m + 5, f, -1))
            elif l == line:
                heapq.heappush(heap, (total + m, f, l))
            else:
                heapq.heappush(heap, (total + m + w + (5 if line != -1 else 0), f, l))
    return best


def test_commutes_equal_a_textbook_search(spark):
    random.seed(3)
    edges = [(random.randrange(12), random.randrange(12), random.randrange(3), "ride", float(random.randint(1, 9)), 4.0, 2) for _ in range(40)]
    edges += [(1, 9, -1, "transfer", 0.0, 4.0, 1), (9, 1, -1, "transfer", 0.0, 4.0, 1)]
    seeds = spark.createDataFrame([(0, 0, 0.0), (1, 3, 6.0), (1, 4, 2.0)], "dest long, node long, walk double")
    got = {(r.dest, r.node, r.line): r.total for r in transit.commute_matrix(spark.createDataFrame(edges, EDGES), seeds).collect()}
    expected = {(0, *k): v for k, v in textbook(edges, [(0, 0.0)]).items()} | {(1, *k): v for k, v in textbook(edges, [(3, 6.0), (4, 2.0)]).items()}
    assert got == expected


def test_path_and_parts_of_a_way(spark):
    edges = spark.createDataFrame([(1, 2, 7, "ride", 3.0, 4.0, 2), (2, 3, 7, "ride", 5.0, 4.0, 1), (0, 1, 8, "ride", 2.0, 6.0, 2)], EDGES)
    m = transit.commute_matrix(edges, spark.createDataFrame([(3, 3, 0.0)], "dest long, node long, walk double"))
    r = transit.best_by_node(transit.with_legs(m)).where("node = 0").first()
    assert (r.total, r.rail, r.waits, r.transfers, r.confidence, r.hops) == (25.0, 10.0, 10.0, 1, 1, 3)
    ways = {(p.node, p.line): [(h.node, h.line) for h in p.path] for p in transit.paths(m, m).collect()}
    assert ways == {(0, 8): [(1, 8), (2, 7), (3, 7)], (1, 7): [(2, 7), (3, 7)], (2, 7): [(3, 7)], (3, -1): []}
    assert transit.paths(m, m.where("node = 99")).collect() == []


def test_paths_cost_what_the_matrix_says(spark):
    random.seed(8)
    edges = [(random.randrange(30), random.randrange(30), random.randrange(4), "ride", float(random.randint(0, 5)), 2.0, random.randint(0, 2)) for _ in range(90)]
    edges += [(a, (a + 7) % 30, -1, "transfer", 0.0, 0.0, 1) for a in range(0, 30, 4)]
    m = transit.commute_matrix(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(0, 0, 1.5), (5, 5, 0.0)], "dest long, node long, walk double")).cache()
    tables = transit.jumps(m)
    assert len(tables) <= 2 + m.agg(F.max("hops")).first()[0].bit_length()
    legs = {(r.dest, r.node, r.line): r for r in transit.with_legs(m, tables).collect()}
    known = {}
    for f, t, l, kind, minutes, _, sure in edges:
        known.setdefault((f, t, l, kind), set()).add((minutes, sure))
    for p in transit.paths(m, m, tables).collect():
        r, node, line, total, rail, least = legs[p.dest, p.node, p.line], p.node, p.line, 0.0, 0.0, 2
        steps = []
        for h in p.path:
            minutes = min(x for x, _ in known[node, h.node, h.line, h.kind])
            least = min(least, max(sure for x, sure in known[node, h.node, h.line, h.kind] if x == minutes))
            steps.append((h.kind, h.line, minutes))
            node = h.node
        before = -1
        for kind, line, minutes in reversed(steps):
            rail += minutes
            total += minutes + (5 if kind == "transfer" else 0 if line == before else 2.0 + (5 if before != -1 else 0))
            before = -1 if kind == "transfer" else line
        assert node == p.dest and len(p.path) == r.hops
        assert (total + r.walk, rail, least) == (r.total, r.rail, r.confidence) and r.walk == (1.5 if p.dest == 0 else 0.0)


def test_faulty_edges_and_seeds_are_rejected_before_the_search(spark):
    good = [(1, 2, 1, "ride", 5.0, 4.0, 2), (2, 3, 1, "ride", 5.0, 4.0, 2)]
    bad = [(1, 3, 1, "ride", None, 4.0, 2), (3, 1, 1, "ride", -50.0, 4.0, 2), (1, 3, 2, "ride", float("nan"), 4.0, 2), (1, 3, 2, "ride", float("inf"), 4.0, 2), (1, 3, -1, "ride", 1.0, 4.0, 2), (1, 3, None, "ride", 1.0, 4.0, 2), (None, 3, 1, "ride", 1.0, 4.0, 2), (1, 3, 1, "walk", 1.0, 4.0, 2), (1, 3, 1, None, 1.0, 4.0, 2), (1, 3, 3, "ride", 1.0, None, 2), (3, 1, -1, "transfer", -9.0, 0.0, 1)]
    edges = spark.createDataFrame(good + bad, EDGES)
    seeds = spark.createDataFrame([(3, 3, 0.0), (3, 2, -90.0), (3, 1, None), (None, 1, 0.0), (3, None, 0.0), (3, 1, float("nan"))], "dest long, node long, walk double")
    b = {r.node: r.total for r in transit.best_by_node(transit.commute_matrix(edges, seeds)).collect()}
    assert b == {1: 14.0, 2: 9.0, 3: 0.0}
    n = {}
    for r in transit.graph_rejects(edges, seeds).collect():
        n[r.input, r.reason] = n.get((r.input, r.reason), 0) + 1
    assert n == {("edge", "no minutes"): 3, ("edge", "negative minutes"): 2, ("edge", "ride without line"): 2, ("edge", "no station"): 1, ("edge", "unknown kind"): 2, ("edge", "no wait"): 1, ("seed", "negative walk"): 1, ("seed", "no walk"): 2, ("seed", "no destination"): 1, ("seed", "no station"): 1}
    with pytest.raises(ValueError, match=r"edge: negative minutes \(2\)"):
        transit.require_graph(edges, seeds)
    with pytest.raises(ValueError, match="no edges; no seeds"):
        transit.require_graph(edges.limit(0), seeds.limit(0))
    transit.require_graph(spark.createDataFrame(good, EDGES), seeds.limit(1))


def test_rounds_write_only_what_got_better(spark, tmp_path, monkeypatch):
    """A long line: every round betters one state, whatever is known by then."""
    edges = spark.createDataFrame([(i + 1, i, 1, "ride", 1.0, 2.0, 2) for i in range(12)], EDGES)
    monkeypatch.setattr(transit, "shared_folder", lambda spark: f"file://{tmp_path}")
    seeds = spark.createDataFrame([(0, 0, 0.0)], "dest long, node long, walk double")
    assert transit.commute_matrix(edges, seeds).count() == 13 and not list(tmp_path.glob("commute-*"))  # rounds go when they are put together
    monkeypatch.setattr(transit, "discard", lambda spark, path: None)
    m = transit.commute_matrix(edges, seeds)
    rows = [spark.read.parquet(str(p)).count() for p in tmp_path.glob("commute-*/*")]
    assert m.count() == 13 and sorted(rows) == [0, *[1] * 13]


def test_offers_of_a_round_are_made_once(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 0, 1, "ride", 1.0, 2.0, 2), (2, 1, 1, "ride", 1.0, 2.0, 2), (2, 0, 2, "ride", 1.0, 2.0, 2)], EDGES)
    plans, write = [], transit.materialized

    def noted(df, name, path=None):
        if name == "commute":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, path)

    monkeypatch.setattr(transit, "materialized", noted)
    transit.commute_matrix(edges, spark.createDataFrame([(0, 0, 0.0)], "dest long, node long, walk double"))
    assert len(plans) > 2 and all(p.count("Join Inner") == 1 for p in plans[1:])


def test_timetable_statistics(spark):
    rows = [("a", 1, "s", 480.0, 480.0), ("a", 2, "d", 485.0, 485.0), ("b", 1, "s", 490.0, 490.0), ("b", 2, "d", 494.0, 494.0), ("c", 1, "s", 500.0, 500.0), ("c", 2, "d", 506.0, 506.0), ("e", 1, "s", 700.0, 700.0), ("e", 2, "d", 702.5, 702.5)]
    times = spark.createDataFrame(rows, "trip_id string, stop_sequence int, stop string, arrival double, departure double")
    routes = spark.createDataFrame([(t, 1) for t in "abce"], "trip_id string, route int")
    got = {r.period: (r.median_minutes, r.n) for r in transit.pair_medians(times, routes).collect()}
    assert got == {"peak": (5.0, 3), "offpeak": (2.5, 1)}
    gaps = {r.period: r.headway for r in transit.headways(times, routes).collect()}
    assert gaps == {"peak": 10.0, "offpeak": None}
    stops = spark.createDataFrame([("s", 1), ("d", 2)], "stop string, station long")
    e = transit.timetable_edges(transit.pair_medians(times, routes), transit.headways(times, routes), stops, spark.createDataFrame([(1, 9)], "route int, line long")).first()
    assert (e.from_id, e.to_id, e.line, e.peak_minutes, e.offpeak_minutes, e.peak_wait, e.offpeak_wait) == (1, 2, 9, 5.0, 2.5, 5.0, 6.0)


def test_locality_takes_the_middle_sample_and_walks_on_ties(spark):
    samples = spark.createDataFrame([(1, s, 139.7, 35.6, 5, float(w)) for s, w in ((1, 3), (2, 9), (3, 1), (4, 20))], "locality int, sample int, lon double, lat double, station long, walk_min double")
    nodes = spark.createDataFrame([(0, 5, 10.0)], "dest long, node long, total double")
    r = transit.locality_commutes(samples, nodes).first()
    assert (r.minutes, r.low, r.high) == (19.0, 12.5, 21.75)
    points = spark.createDataFrame([(0, 139.7, 35.6)], "dest long, plon double, plat double")
    assert transit.locality_commutes(samples, nodes, points).first()["mode"] == "walk"


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30) if i not in (9, 19)]
    got = {r.id: r.component for r in graph.components(spark.range(33).toDF("id"), spark.createDataFrame(pairs, "a_id long, b_id long")).collect()}
    assert got == {i: 0 if i < 10 else 10 if i < 20 else 20 if i < 31 else i for i in range(33)}


def test_topology_runs_both_ways(spark):
    pos = spark.createDataFrame([(1, 10, 0.0), (1, 11, 1000.0), (1, 12, 3800.0)], "line_id long, point_id long, pos_m double")
    e = transit.topology_edges(pos, spark.createDataFrame([(1, "subway")], "line_id long, mode string"))
    assert {(r.from_id, r.to_id): round(r.minutes, 3) for r in e.collect()} == {(10, 11): 2.143, (11, 10): 2.143, (11, 12): 6.0, (12, 11): 6.0}


@pytest.mark.parametrize("total, parts", [(30.6, (8.4, 10.3, 5.0, 0.0))])
def test_rounded_legs_add_up(spark, total, parts):
    legs = transit.leg_roundings(F.lit(total), *[F.lit(x) for x in parts])
    row = spark.range(1).select(*[c.alias(k) for k, c in legs.items()]).first()
    assert sum(row) == 31


def test_rounds_send_no_tables_through_the_driver(spark, monkeypatch):
    """However small a side of a round's joins is: many rounds would add up."""
    plans, plain = [], transit.materialized
    monkeypatch.setattr(transit, "materialized", lambda df, name, *rest: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), plain(df, name, *rest))[1])
    edges = spark.createDataFrame([(i + 1, i, 1, "ride", 1.0, 2.0, 2) for i in range(4)], EDGES)
    m = transit.commute_matrix(edges, spark.createDataFrame([(0, 0, 0.0)], "dest long, node long, walk double"))
    transit.jumps(m)
    rounds = [p for name, p in plans if name in ("commute", "jumps")]
    assert len(rounds) > 6 and not any("Broadcast" in p for p in rounds)


def test_stations_of_one_place_are_one_node(spark, monkeypatch):
    """Thirty stations at each of three places, two of them near each other, and some that lie nowhere: as many pairs as places have."""
    rows = [(i, "k" if i % 2 else "j", f"n{i}", 139.7 + 0.001 * (i % 3 == 1) + 0.5 * (i % 3 == 2), 35.6) for i in range(90)] + [(100, "k", "a", None, 35.6), (101, None, "b", 139.7, 35.6)]
    st = spark.createDataFrame(rows, "id long, name_key string, name string, lon double, lat double")
    met, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda nodes, pairs: (met.append(pairs.count()), plain(nodes, pairs))[1])
    got = sorted((r.component, r.members, r.name) for r in graph.merged_stations(st, 300.0).collect())
    assert got == [(0, 30, "n0"), (1, 30, "n1"), (2, 15, "n2"), (5, 15, "n5"), (100, 1, "a"), (101, 1, "b")] and met == [2]


@pytest.mark.parametrize("dests, block", [(32, 1 << 21), (2, 1)])
def test_totals_of_many_destinations_equal_those_of_the_matrix(spark, monkeypatch, dests, block):
    monkeypatch.setattr(transit, "DESTS", dests)
    monkeypatch.setattr(transit, "BLOCK", block)
    r = random.Random(5)
    edges = [(r.randrange(30), r.randrange(30), r.choice([0, 3, 7, 1000]), "ride", r.random() * 9, r.random() * 4, 2) for _ in range(110)]
    edges += [(a, (a + 7) % 30, -1, "transfer", 0.1, -1.0, 1) for a in range(0, 30, 4)]
    edges += [(1, 2, -1, "ride", 1.0, 1.0, 1), (1, 2, 3, "ride", -5.0, 1.0, 1), (1, None, 3, "ride", 1.0, 1.0, 1)]
    edges = spark.createDataFrame(edges, EDGES)
    seeds = spark.createDataFrame([(i, i + 3, 0.3 * i) for i in range(9)] + [(4, 1, 0.2), (4, 7, 9.0), (5, 99, 1.0), (6, None, 1.0), (7, 2, -1.0)], "dest long, node long, walk double")
    rows = lambda df: sorted(map(tuple, df.select("dest", "node", "line", "total").collect()))
    got = rows(transit.commute_totals(edges, seeds))
    assert got == rows(transit.commute_matrix(edges, seeds)) and len(got) > 300 and (5, 99, -1, 1.0) in got
    assert rows(transit.commute_totals(edges.where("false"), seeds.where("dest = 4"))) == [(4, 1, -1, 0.2), (4, 7, -1, 1.2)]
    assert rows(transit.commute_totals(edges, seeds.where("false"))) == []


def test_a_faulty_graph_is_searched_without_rounds(spark, tmp_path, monkeypatch):
    from wardwise.plans import queries

    spark.range(40).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(transit, "commute_matrix", None)
    assert {r.dest for r in queries.faulty_graph_matrix(spark, str(tmp_path)).collect()} == {0, 20}
