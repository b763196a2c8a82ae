"""Timetable statistics, edge plans and commute matrices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.geo import haversine_m, walk_minutes
from wardwise.functions.numbers import clamp
from wardwise.functions.times import period as period_of
from wardwise.sources.shared import discard, materialized, shared_folder

from .spatial import near, self_pairs

NO_LINE = -1
DESTS = 32  # destinations of a task in ``commute_totals``
BLOCK = 1 << 21  # times held there for each of a few arrays: edges or states times destinations at once
ROWS = 1 << 16  # of a batch


def adjacent_stops(stop_times: DataFrame) -> DataFrame:
    """Each stop of a trip with the next and with the trip's first: trip_id, stop_sequence, stop, arrival, departure (minutes)."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    out = stop_times.withColumn("next_stop", F.lead("stop").over(w)).withColumn("minutes", F.lead("arrival").over(w) - F.col("departure"))
    return out.withColumn("first_stop", F.first("stop").over(w))


def pair_medians(stop_times: DataFrame, routes: DataFrame) -> DataFrame:
    """Median minutes between adjacent stops by route, first stop and period; backward travel is left out. routes: trip_id, route."""
    legs = adjacent_stops(stop_times).where("next_stop is not null and next_stop <> stop and minutes >= 0").join(routes, "trip_id")
    return legs.groupBy("route", "first_stop", "stop", "next_stop", period_of(F.col("departure")).alias("period")).agg(F.percentile("minutes", 0.5).alias("median_minutes"), F.count("*").alias("n"))


def headways(stop_times: DataFrame, routes: DataFrame) -> DataFrame:
    """Mean minutes between departures from a route's first stop, by period; null below two."""
    starts = stop_times.groupBy("trip_id").agg(F.min_by(F.struct("stop", "departure"), "stop_sequence").alias("s")).select("trip_id", F.col("s.stop").alias("first_stop"), F.col("s.departure").alias("departure")).join(routes, "trip_id")
    g = starts.groupBy("route", "first_stop", period_of(F.col("departure")).alias("period")).agg(F.count("*").alias("n"), F.min("departure").alias("a"), F.max("departure").alias("b"))
    return g.select("route", "first_stop", "period", "n", F.when(F.col("n") >= 2, (F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("headway"))


def expected_wait(headway: Column, default: float) -> Column:
    return F.coalesce(clamp(headway / 2, *config.WAIT_BOUNDS_MIN), F.lit(default))


def timetable_edges(medians: DataFrame, gaps: DataFrame, stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Ride edges from timetable statistics. stops: stop, station; lines: route, line. Missing periods take the other's
    minutes; of several first stops the one with most departures counts, then the smaller."""
    by = ["route", "first_stop"]
    legs = medians.groupBy(*by, "stop", "next_stop").agg(*[F.max(F.when(F.col("period") == p, F.col("median_minutes"))).alias(f"{p}_minutes") for p in ("peak", "offpeak")], F.sum("n").alias("n"))
    waits = gaps.groupBy(*by).agg(*[F.max(F.when(F.col("period") == p, F.col("headway"))).alias(f"{p}_gap") for p in ("peak", "offpeak")])
    e = legs.join(waits, by, "left").join(lines, "route")
    e = e.join(stops.select(F.col("stop"), F.col("station").alias("from_id")), "stop").join(stops.select(F.col("stop").alias("next_stop"), F.col("station").alias("to_id")), "next_stop").where("from_id <> to_id")
    e = e.select("from_id", "to_id", "line", "first_stop", "route", "n", F.coalesce("peak_minutes", "offpeak_minutes").alias("peak_minutes"), F.coalesce("offpeak_minutes", "peak_minutes").alias("offpeak_minutes"), expected_wait(F.col("peak_gap"), config.PEAK_WAIT_MIN).alias("peak_wait"), expected_wait(F.col("offpeak_gap"), config.OFFPEAK_WAIT_MIN).alias("offpeak_wait"))
    rank = F.row_number().over(Window.partitionBy("from_id", "to_id", "line").orderBy(F.desc("n"), "first_stop", "route"))
    return e.withColumn("r", rank).where("r = 1").select("from_id", "to_id", "line", "peak_minutes", "offpeak_minutes", "peak_wait", "offpeak_wait", F.lit("ride").alias("kind"), F.lit(2).alias("confidence"))


def timetable_skips(medians: DataFrame, stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Why legs of a timetable make no edge, and how many: reason, legs, runs. As for ``timetable_edges``."""
    named = medians.join(lines, "route", "left")
    named = named.join(stops.select("stop", F.col("station").alias("from_id")), "stop", "left").join(stops.select(F.col("stop").alias("next_stop"), F.col("station").alias("to_id")), "next_stop", "left")
    reason = F.when(F.col("line").isNull(), "route without line").when(F.col("from_id").isNull() | F.col("to_id").isNull(), "stop without station").when(F.col("from_id") == F.col("to_id"), "one station")
    return named.groupBy(reason.alias("reason")).agg(F.count("*").alias("legs"), F.sum("n").alias("runs")).where("reason is not null")


def topology_edges(positions: DataFrame, lines: DataFrame, keys: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Ride edges both ways between neighbours along a line (or a part of one, by keys): keys, point_id, pos_m; lines: line_id, mode."""
    w = Window.partitionBy(*keys).orderBy("pos_m", "point_id")
    speed = F.element_at(F.create_map(*[F.lit(x) for kv in config.SPEED_KMH.items() for x in kv]), F.col("mode"))
    legs = positions.withColumn("next_id", F.lead("point_id").over(w)).withColumn("gap", F.lead("pos_m").over(w) - F.col("pos_m")).where("next_id is not null").join(lines, "line_id")
    ends = lambda a, b: F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    both = legs.select(F.explode(F.array(ends("point_id", "next_id"), ends("next_id", "point_id"))).alias("e"), F.col("line_id").alias("line"), (F.col("gap") / 1000 / speed * 60).alias("minutes"))
    return both.select("e.*", "line", "minutes").withColumn("kind", F.lit("ride")).withColumn("confidence", F.lit(0))


def transfer_edges(stations: DataFrame, radius_m: float = config.MERGE_M) -> DataFrame:
    """Ways of no minutes between different stations within the radius."""
    return self_pairs(stations, radius_m).select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), F.lit(None).cast("long").alias("line"), F.lit(0.0).alias("minutes"), F.lit("transfer").alias("kind"), F.lit(1).alias("confidence"))


def in_period(edges: DataFrame, period: str) -> DataFrame:
    """from_id, to_id, line, kind, minutes, wait and confidence for one period; a wait of 0 or less is the default."""
    default = config.PEAK_WAIT_MIN if period == "peak" else config.OFFPEAK_WAIT_MIN
    wait = F.col(f"{period}_wait")
    return edges.select("from_id", "to_id", F.coalesce("line", F.lit(NO_LINE)).alias("line"), "kind", F.col(f"{period}_minutes").alias("minutes"), F.when(wait > 0, wait).otherwise(F.lit(default)).alias("wait"), "confidence")


def access_seeds(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations within walking distance of destinations (anchor_id, alon, alat): dest, node, walk."""
    return near(points, stations.select(F.col("id").alias("node"), "lon", "lat"), config.MAX_WALK_M).select(F.col("anchor_id").alias("dest"), "node", walk_minutes(F.col("dist_m")).alias("walk"))


def edge_fault() -> Column:
    """Why an edge cannot be travelled, null if it can; for edges as from ``in_period``."""
    ride = F.col("kind") == "ride"
    return (
        F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), "no station")
        .when(~F.coalesce(F.col("kind").isin("ride", "transfer"), F.lit(False)), "unknown kind")
        .when(ride & F.coalesce(F.col("line") == NO_LINE, F.lit(True)), "ride without line")
        .when(_not_a_time(F.col("minutes")), "no minutes")
        .when(F.col("minutes") < 0, "negative minutes")
        .when(ride & (_not_a_time(F.col("wait")) | (F.col("wait") < 0)), "no wait")
    )


def seed_fault() -> Column:
    """Why a seed (dest, node, walk) cannot be started from, null if it can."""
    walk = F.col("walk")
    return F.when(F.col("dest").isNull(), "no destination").when(F.col("node").isNull(), "no station").when(_not_a_time(walk), "no walk").when(walk < 0, "negative walk")


def _not_a_time(minutes: Column) -> Column:
    return minutes.isNull() | F.isnan(minutes) | (F.abs(minutes) == float("inf"))


def graph_rejects(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges and seeds that no search takes, each with the reason: input, a (from, destination), b (to, node), reason."""
    bad = edges.select(F.lit("edge").alias("input"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), edge_fault().alias("reason"))
    return bad.unionByName(seeds.select(F.lit("seed").alias("input"), F.col("dest").alias("a"), F.col("node").alias("b"), seed_fault().alias("reason"))).where("reason is not null")


def require_graph(edges: DataFrame, seeds: DataFrame) -> None:
    """An error that says how many edges and seeds have which fault, or that there is nothing to search."""
    found = [f"{r.input}: {r.reason} ({r.n})" for r in graph_rejects(edges, seeds).groupBy("input", "reason").agg(F.count("*").alias("n")).orderBy("input", "reason").collect()]
    found += [f"no {what}" for what, df, fault in (("edges", edges, edge_fault()), ("seeds", seeds, seed_fault())) if not df.where(fault.isNull()).limit(1).count()]
    if found:
        raise ValueError("no commutes from this graph, " + "; ".join(found))


STATE = ["dest", "node", "line"]
_POINTER = "next_node long, next_line long, way_line long, kind string, minutes double, board double, way_confidence int"
_ORDER = ["total", "transfers", "hops", "next_node", "next_line", "way_line", "kind"]


def commute_matrix(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Best way from every reachable state (node, line) to each destination.

    edges: as from ``in_period``; seeds: dest, node, walk. Faulty ones (``graph_rejects``) are
    left out before the search begins, so no time is null and none makes a way shorter.
    All destinations are relaxed together, backwards: a state that got better offers itself to
    the edges that end at its node. Riding on costs the minutes; boarding a line also
    its wait; changing lines the penalty too; a transfer edge has the penalty and
    leaves the line. Equal times are settled by transfers, then hops, then by the node and
    line gone to; each hop makes a way longer by this order, so there are no circles.

    A state has no path, only where it goes on to (``next_node``, ``next_line``, by ``way_line``);
    see ``paths`` and ``with_legs``. A round writes the states that got better and nothing else;
    these are the next round's offers. An offer goes if a round before has its state as good or better; offers are read
    once for that, in the order in which they were put together. Rounds join by shuffles, as small sides sent through the
    driver would add up over the rounds.
    """
    ways = edges.where(edge_fault().isNull()).select("from_id", F.col("to_id").alias("node"), F.col("line").alias("e_line"), "kind", "minutes", "wait", "confidence")
    ways = materialized(ways.withColumnsRenamed({"kind": "e_kind", "minutes": "e_minutes"}), "ways")
    first = seeds.where(seed_fault().isNull()).groupBy("dest", "node").agg(F.min("walk").cast("double").alias("total"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _POINTER.split(", "))]
    folder = f"{shared_folder(edges.sparkSession)}/commute-{uuid.uuid4().hex}"
    better = materialized(first.select("dest", "node", F.lit(NO_LINE).cast("long").alias("line"), "total", F.lit(0).alias("transfers"), F.lit(0).alias("hops"), *blank), "commute", f"{folder}/0")
    rounds = [better]
    offered, order = _offer(), F.struct(*_ORDER)
    at, no_better = [F.col(f"k_{c}") == F.col(c) for c in STATE], F.col("known") <= order
    while True:
        offers = _best(better.join(ways.hint("shuffle_hash"), "node").select(*offered), better.columns)
        known = _together(rounds, folder).select(*[F.col(c).alias(f"k_{c}") for c in STATE], order.alias("known"))
        seen = Observation()
        improved = offers.join(known.hint("merge"), [*at, no_better], "left_anti")
        better = materialized(improved.observe(seen, F.count(F.lit(1)).alias("n")), "commute", f"{folder}/{len(rounds)}")
        if not seen.get["n"]:
            states = materialized(_best(_together(rounds, folder), better.columns), "states")
            discard(edges.sparkSession, folder)
            return states
        rounds.append(better)


def commute_totals(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """dest, node, line and total as of ``commute_matrix``, for many destinations: all states of all destinations, but no ways.

    Every task gets the graph by a shuffle and some destinations (``DESTS`` on average), which it searches in blocks and whose times it
    hands on as they are done: it holds the graph and ``BLOCK`` times, not its states. So work and rows grow with stations times destinations,
    a task's memory with the graph.
    """
    ride, n = F.col("kind") == "ride", int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wait = F.when(ride, F.col("wait")).otherwise(F.lit(0.0)).cast("double")
    ways = edges.where(edge_fault().isNull()).select(F.lit(None).cast("long").alias("dest"), F.col("from_id").cast("long").alias("a"), F.col("to_id").cast("long").alias("b"), F.when(ride, F.col("line")).cast("long").alias("line"), F.col("minutes").cast("double").alias("minutes"), wait.alias("wait"))
    first = materialized(seeds.where(seed_fault().isNull()).groupBy(F.col("dest").cast("long").alias("dest"), F.col("node").cast("long").alias("a")).agg(F.min("walk").cast("double").alias("minutes")), "seeds")
    groups = -(-first.agg(F.count_distinct("dest")).first()[0] // DESTS) or 1
    ways = materialized(ways, "ways").repartition(n).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    first = first.withColumn("group", F.pmod(F.xxhash64("dest"), F.lit(groups)).cast("int"))
    most, penalty = BLOCK, float(config.TRANSFER_PENALTY_MIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from _searched(pa.Table.from_batches(held), most, penalty)

    dealt = ways.unionByName(first, allowMissingColumns=True).repartitionById(groups, "group").drop("group")
    return dealt.mapInArrow(run, "dest long, node long, line long, total double")


def _searched(t: pa.Table, most: int, penalty: float) -> Iterator[pa.RecordBatch]:
    """Times of all states to some destinations. t: edges a, b, line (null: a transfer), minutes, wait, with no dest; seeds dest, a, minutes."""
    own = t["dest"].is_valid()
    seeds, e = t.filter(own), t.filter(pc.invert(own))
    m, w, ride = e["minutes"].to_numpy(), e["wait"].to_numpy(), e["line"].is_valid().to_numpy()
    k = len(m)
    nodes, at = np.unique(np.concatenate((e["a"].to_numpy(), e["b"].to_numpy(), seeds["a"].to_numpy())), return_inverse=True)
    frm, to, begin = at[:k], at[k : 2 * k], at[2 * k :]
    lines, code = np.unique(e["line"].fill_null(NO_LINE).to_numpy(), return_inverse=True)
    wide, code = len(lines) + 1, np.where(ride, code + 1, 0)
    # States node by node: the one without a line comes first.
    states = np.unique(np.concatenate((np.arange(len(nodes)) * wide, frm * wide + code)))
    n, start = len(states), np.searchsorted(states, np.arange(len(nodes)) * wide)
    target, goal = np.searchsorted(states, frm * wide + code), to * wide + code
    same = np.searchsorted(states, goal)
    same = np.where(ride & (states[np.minimum(same, n - 1)] == goal), same, n)  # n: none
    order = np.argsort(target, kind="stable")
    target, same, to, m, w = target[order], same[order], to[order], m[order, None], w[order, None]
    alone = np.where(ride[order], start[to], n)
    node, line = nodes[states // wide], np.append(NO_LINE, lines)[states % wide]
    of, dests = states // wide, np.unique(seeds["dest"].to_numpy())
    column, walk = np.searchsorted(dests, seeds["dest"].to_numpy()), seeds["minutes"].to_numpy()
    block = max(1, most // max(n, k))
    for i in range(0, len(dests), block):
        here = (column >= i) & (column < i + block)
        dist = np.full((n + 1, min(block, len(dests) - i)), np.inf)
        np.minimum.at(dist, (start[begin[here]], column[here] - i), walk[here])
        changed = np.zeros(len(nodes), bool)
        changed[begin[here]] = True
        while (live := np.flatnonzero(changed[to])).size:
            # The same sums in the same order as of offers there; over all lines it is never less than by the same one or none.
            ahead, minutes, waits = to[live], m[live], w[live]
            total = np.minimum.reduceat(dist[:n], start, axis=0)[ahead]
            total += minutes
            total += waits
            total += penalty
            for others, more in ((alone, waits), (same, None)):
                x = dist[others[live]]
                x += minutes
                if more is not None:
                    x += more
                np.minimum(total, x, out=total)
            ends = target[live]
            first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            new, ends = np.minimum.reduceat(total, first, axis=0), ends[first]
            old = dist[ends]
            better = (new < old).any(axis=1)
            dist[ends] = np.minimum(new, old)
            changed[:] = False
            changed[of[ends[better]]] = True
        for j in range(dist.shape[1]):
            found = np.flatnonzero(dist[:n, j] < np.inf)
            for r in range(0, len(found), ROWS):
                part = found[r : r + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dests[i + j])), pa.array(node[part]), pa.array(line[part]), pa.array(dist[part, j])], names=["dest", "node", "line", "total"])


def _offer() -> list[Column]:
    """What a state (and an edge that ends at its node, as e_ columns) makes of the state that the edge comes from."""
    ride = F.col("e_kind") == "ride"
    same = ride & (F.col("line") == F.col("e_line"))
    change = F.when(~ride | (~same & (F.col("line") != NO_LINE)), F.lit(1)).otherwise(F.lit(0))
    board = F.when(ride & ~same, F.col("wait")).otherwise(F.lit(0.0))
    return [
        F.col("dest"),
        F.col("from_id").alias("node"),
        F.when(ride, F.col("e_line")).otherwise(F.lit(NO_LINE)).cast("long").alias("line"),
        (F.col("total") + F.col("e_minutes") + board + change * F.lit(config.TRANSFER_PENALTY_MIN)).alias("total"),
        (F.col("transfers") + change).alias("transfers"),
        (F.col("hops") + 1).alias("hops"),
        F.col("node").cast("long").alias("next_node"),
        F.col("line").alias("next_line"),
        F.col("e_line").cast("long").alias("way_line"),
        F.col("e_kind").alias("kind"),
        F.col("e_minutes").alias("minutes"),
        board.alias("board"),
        F.col("confidence").cast("int").alias("way_confidence"),
    ]


def _best(states: DataFrame, columns: list[str]) -> DataFrame:
    """The best row of each state; of ways that are equal in all else the surest."""
    rest = [c for c in columns if c not in STATE]
    order = F.struct(*_ORDER, (-F.col("way_confidence")).alias("unsure"))
    return states.groupBy(*STATE).agg(F.min_by(F.struct(*rest), order).alias("s")).select(*STATE, "s.*")


def _together(rounds: list[DataFrame], folder: str) -> DataFrame:
    """The written rounds as one scan."""
    return rounds[0].sparkSession.read.schema(rounds[0].schema).parquet(*[f"{folder}/{k}" for k in range(len(rounds))])


def jumps(matrix: DataFrame) -> list[DataFrame]:
    """Where each state is after 1, 2, 4, ... hops (to_node, to_line; null: arrived), and what these hops add up to.

    Each table is the one before joined with itself; the last has arrived everywhere.
    """
    arrived = F.col("next_node").isNull()
    one = matrix.select(*STATE, F.col("next_node").alias("to_node"), F.col("next_line").alias("to_line"), F.coalesce("minutes", F.lit(0.0)).alias("rail"), F.coalesce("board", F.lit(0.0)).alias("waits"), F.when(arrived, F.col("total")).otherwise(F.lit(0.0)).alias("walk"), F.coalesce("way_confidence", F.lit(2)).alias("confidence"))
    found = [materialized(one, "jumps")]
    while found[-1].where("to_node is not null").limit(1).count():
        a = found[-1]
        b = a.toDF("dest", "to_node", "to_line", "far_node", "far_line", "rail2", "waits2", "walk2", "confidence2")
        plus = lambda c: F.col(c) + F.coalesce(f"{c}2", F.lit(0.0))
        both = a.join(b.hint("shuffle_hash"), ["dest", "to_node", "to_line"], "left")
        found.append(materialized(both.select(*STATE, F.col("far_node").alias("to_node"), F.col("far_line").alias("to_line"), plus("rail").alias("rail"), plus("waits").alias("waits"), plus("walk").alias("walk"), F.least("confidence", F.coalesce("confidence2", F.lit(2))).alias("confidence")), "jumps"))
    return found


def with_legs(matrix: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
    """The matrix with each way's parts: minutes of rides, of waits and of the walk at its end, and its least confidence."""
    last = (tables or jumps(matrix))[-1]
    return matrix.join(last.select(*STATE, "rail", "waits", "walk", "confidence"), STATE)


def paths(matrix: DataFrame, chosen: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
    """Ways of the chosen states (dest, node, line; others are not read) hop by hop: path is an array of the node gone to,
    the line and the kind, empty at a destination.

    A hop's place in a way is a sum of powers of two, so places are filled from the widest jump down.
    """
    tables = tables or jumps(matrix)
    at = chosen.select(*STATE).distinct().withColumnsRenamed({"node": "start_node", "line": "start_line"}).withColumn("pos", F.lit(0)).withColumn("node", F.col("start_node")).withColumn("line", F.col("start_line"))
    for k in reversed(range(len(tables))):
        further = at.join(tables[k].where("to_node is not null").select(*STATE, "to_node", "to_line"), STATE)
        at = at.unionByName(further.select("dest", "start_node", "start_line", (F.col("pos") + (1 << k)).alias("pos"), F.col("to_node").alias("node"), F.col("to_line").alias("line")))
    hop = F.struct("pos", F.col("next_node").alias("node"), F.col("way_line").alias("line"), "kind")
    hops = at.join(matrix.select(*STATE, "next_node", "way_line", "kind"), STATE)
    listed = hops.groupBy("dest", "start_node", "start_line").agg(F.array_sort(F.collect_list(F.when(F.col("next_node").isNotNull(), hop))).alias("hops"))
    return listed.select("dest", F.col("start_node").alias("node"), F.col("start_line").alias("line"), F.transform("hops", lambda h: F.struct(h["node"].alias("node"), h["line"].alias("line"), h["kind"].alias("kind"))).alias("path"))


def best_by_node(matrix: DataFrame) -> DataFrame:
    """The best state of each node."""
    order = F.struct("total", "transfers", "line")
    return matrix.groupBy("dest", "node").agg(F.min_by(F.struct(*[c for c in matrix.columns if c not in ("dest", "node")]), order).alias("s")).select("dest", "node", "s.*")


def locality_commutes(samples: DataFrame, nodes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Commute of localities to destinations. samples: locality, sample, lon, lat, station, walk_min (a row a station);
    nodes: dest, node, total; points: dest, plon, plat of destinations that are points.

    A sample takes its best station (of equally good ones the smallest), or walks where that is not slower; a locality
    takes its middle sample, with the station if it has one, and the quartiles as its range.
    """
    way = F.struct((F.col("total") + F.col("walk_min")).alias("transit"), "station")
    transit = samples.join(nodes.select("dest", F.col("node").alias("station"), "total"), "station").groupBy("locality", "sample", "dest").agg(F.min(way).alias("w")).select("locality", "sample", "dest", "w.*")
    if points is None:
        each = transit.withColumn("minutes", F.col("transit")).withColumn("mode", F.lit("transit"))
    else:
        walks = samples.select("locality", "sample", "lon", "lat").distinct().crossJoin(F.broadcast(points)).select("locality", "sample", "dest", walk_minutes(haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).alias("walk"))
        each = transit.join(walks, ["locality", "sample", "dest"], "full")
        on_foot = F.col("walk").isNotNull() & (F.col("transit").isNull() | (F.col("walk") <= F.col("transit")))
        each = each.withColumn("minutes", F.when(on_foot, F.col("walk")).otherwise(F.col("transit"))).withColumn("mode", F.when(on_foot, "walk").otherwise("transit")).withColumn("station", F.when(~on_foot, F.col("station")))
    by = Window.partitionBy("locality", "dest")
    ranked = each.withColumn("r", F.row_number().over(by.orderBy("minutes", "sample"))).withColumn("n", F.count("*").over(by))
    middle = F.col("r") == F.floor(F.col("n") / 2) + 1
    return ranked.groupBy("locality", "dest").agg(F.max(F.when(middle, F.col("minutes"))).alias("minutes"), F.max(F.when(middle, F.col("mode"))).alias("mode"), F.max(F.when(middle, F.col("station"))).alias("station"), F.percentile("minutes", 0.25).alias("low"), F.percentile("minutes", 0.75).alias("high"))


def line_names(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Names of the lines that touch a station at either end, in order."""
    ends = edges.where("kind = 'ride'").select(F.explode(F.array("from_id", "to_id")).alias("id"), "line").distinct()
    return ends.join(lines, "line").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("lines"))


def orphans(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Stations without any ride."""
    ends = edges.where("kind = 'ride'").select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return stations.join(ends, "id", "left_anti")


def leg_roundings(total: Column, walk: Column, rail: Column, penalty: Column, destination_walk: Column) -> dict[str, Column]:
    """Whole minutes of a way's parts; the wait is what is left of the whole."""
    from wardwise.functions.numbers import half_up

    parts = {"walk_min": half_up(walk), "rail_min": half_up(rail), "transfer_min": half_up(penalty), "end_walk_min": half_up(destination_walk)}
    return parts | {"wait_min": F.greatest(F.lit(0), half_up(total) - sum(parts.values(), F.lit(0)))}
