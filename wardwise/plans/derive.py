"""The run of derived tables: its steps, what they need, what the result must be; cards and regions made from it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.geo import geo_dist_m
from wardwise.operators import cards, lines, quality, rent, spatial, transit
from wardwise.operators.store import Store, digest
from wardwise.sources import maps
from wardwise.sources.shared import discard, materialized, shared_folder

from . import adapters as A
from . import queries as Q

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """A derived table: what it is made of and how. ``reads``: steps before it; ``raw``: the driver's tables; ``needs``: what must not
    be lacking before it runs, as for ``quality.require``."""

    name: str
    build: Callable[[SparkSession, str, Tables], DataFrame]
    keys: tuple[str, ...]
    reads: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    needs: Callable[[SparkSession, str, Tables], list[tuple[str, str, DataFrame]]] = lambda s, d, t: []


def _as_places(t: DataFrame) -> DataFrame:
    return t.withColumnRenamed("region_id", "locality")


def _axes(s, d, t):
    return Q._round(Q.axes_of(s, d, t["places"], t["catchments"]), "score")


#: Steps of a run in order.
STEPS = (
    Step("places", lambda s, d, t: Q._round(Q.sample_places(s, d), "lon", "lat"), ("region_id", "sample"), raw=("nation",)),
    Step("amenities", lambda s, d, t: Q.amenities(s, d), ("anchor_id",), raw=("supplier", "customer", "part")),
    Step("quietness", lambda s, d, t: Q.quietness(s, d, t["amenities"]), ("anchor_id",), ("amenities",), ("supplier", "nation")),
    Step("rent", lambda s, d, t: Q.rent_by_layout(s, d), ("anchor_id", "layout"), raw=("supplier", "orders", "customer")),
    Step("normalization", lambda s, d, t: Q.normalized(t["amenities"]), ("anchor_id",), ("amenities",)),
    Step("samples", lambda s, d, t: Q.stations_of(s, d, _as_places(t["places"])), ("locality", "sample", "rank"), ("places",), ("supplier",)),
    Step("catchments", lambda s, d, t: Q.catchments(s, d, t["places"]), ("locality", "sample"), ("places",), ("customer", "part")),
    Step("localities", _axes, ("locality", "axis"), ("places", "samples", "catchments"), ("nation",), lambda s, d, t: [("localities", "nine samples of the locality", t["places"].groupBy("region_id").count().where(F.col("count") != config.SAMPLES))]),
)
STATE = "_steps"  # what each step was made of, and what became of it


def _fingerprint(df: DataFrame) -> list[list]:
    return sorted([r["column"], r["n"], r["sum"], r["xor"]] for r in digest(df).collect())  # a row a column


def run_steps(spark: SparkSession, sf_dir: str, store: Store, steps: Sequence[Step] = STEPS, only: Sequence[str] | None = None, force: bool = False, started_at: str = "") -> DataFrame:
    """Run the steps in order, all or those named, each on the written tables of the steps before: position, step, rows, status.

    A step is ``skipped`` where what it reads is what it read last time (by digests), unless forced; else ``written``, or ``same`` where
    it gave what was there. It does not run while what it needs is lacking. Its table and the note of what it was made of change together.
    """
    names = [s.name for s in steps]
    unknown = set(only or ()) - set(names)
    if unknown:
        raise ValueError(f"no such steps: {sorted(unknown)}")
    report, raw = [], {}
    for k, step in enumerate(steps):
        if only is not None and step.name not in only:
            continue
        if late := set(step.reads) - set(names[:k]):
            raise ValueError(f"{step.name} reads steps that are not before it: {sorted(late)}")
        state = store.read(STATE)
        known = {r.step: (r.inputs, r.output) for r in state.collect()} if state is not None else {}
        tables = {r: store.read(r) for r in step.reads}
        if missing := [r for r in step.reads if tables[r] is None]:
            raise ValueError(f"{step.name} reads steps that have not run: {missing}")
        quality.require(step.needs(spark, sf_dir, tables), step.name)
        for t in step.raw:
            raw[t] = raw.get(t) or _fingerprint(A.table(spark, sf_dir, t))
        inputs = json.dumps([[t, raw[t]] for t in step.raw] + [[r, known[r][1]] for r in step.reads])
        old = known.get(step.name, (None, None))
        if old[0] == inputs and not force:
            held = store.manifest()["tables"][step.name]["buckets"].values()
            report.append((len(report) + 1, step.name, sum(b["rows"] for b in held), "skipped"))
            continue
        with store.run(step.name, started_at) as run:
            run.replace(step.name, step.build(spark, sf_dir, tables), step.keys)
            rows, output = run.rows, json.dumps(_fingerprint(run.read(step.name)))
            run.upsert(STATE, spark.createDataFrame([(step.name, inputs, output)], "step string, inputs string, output string"), ["step"])
        report.append((len(report) + 1, step.name, rows, "same" if output == old[1] else "written"))
    return spark.createDataFrame(report, "position long, step string, rows long, status string")


def derive_report(s, d):
    store = Store(s, f"{shared_folder(s)}/derive-{uuid.uuid4().hex}")
    report = run_steps(s, d, store)
    discard(s, store.path)  # the report is a table of its own
    return report


def derive_repeat(s, d):
    """What a second run of all steps on the same tables gives: the same rows."""
    store = Store(s, f"{shared_folder(s)}/derive-{uuid.uuid4().hex}")
    run_steps(s, d, store)
    report = run_steps(s, d, store, force=True)
    discard(s, store.path)
    return report


def prerequisites(s, d):
    """What the steps after them lack: stations near no price, rankable ones without rents, samples without stations, stations without rides."""
    st = A.stations(s, d)
    samples = A.localities(s, d).join(Q.knn_stations(s, d).select("locality", "sample"), ["locality", "sample"], "left_anti")
    rankable = A.anchors(s, d).join(rent.rent_choice(A.rent_stats(s, d), Q.YEAR).select("ward"), "ward", "left_semi")
    return quality.prerequisites([
        ("normalization", "price near the station", Q.catchment_land_median(s, d).where("median_price is null")),
        ("localities", "rent of a station in a ward with rents", rankable.join(Q.rent_by_layout(s, d), "anchor_id", "left_anti")),
        ("localities", "station near the sample", samples),
        ("commutes", "ride of the station", transit.orphans(st.select("id"), A.rail_edges(s, d))),
    ])


def _lines(s, d):
    """Lines with their mode; one in five has a mode that is not known."""
    names = F.array(*[F.lit(m) for m in (*config.MODES, "tram")])
    return A.rail_edges(s, d).select("line").distinct().withColumn("mode", F.get(names, (F.col("line") % 5).cast("int")))


def _sources(s, d):
    """Sources of stations and prices; some rows are left from tests."""
    st = A.stations(s, d).select(F.when(F.col("id") % 10 == 3, "seed").otherwise("mlit").alias("source"))
    lp = A.land_prices(s, d).select(F.when(F.col("price_id") % 100 == 7, "fixture").otherwise("mlit").alias("source"))
    return {"stations": st, "land_prices": lp, "rents": A.rent_stats(s, d).select("source")}


def forbidden_sources(s, d):
    return quality.forbidden_sources(_sources(s, d), config.FORBIDDEN_SOURCES)


def taken_over_sources(s, d):
    current, _ = Q._batches(s, d)
    incoming = A.table(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("osm").alias("source"))
    return quality.taken_over(current, incoming, ["id"])


def data_validation(s, d):
    """The assertions on a whole run, each with its value."""
    st, edges, rents, prices = A.stations(s, d), A.rail_edges(s, d), A.rent_stats(s, d), A.land_prices(s, d)
    rings = spatial.usable_rings(A.ward_rings(s, d))
    norm, scores = Q.minmax_norm(s, d), Q.locality_scores(s, d)
    at = A.localities(s, d).select(F.struct("locality", "sample").alias("point_id"), "lon", "lat")
    inside = spatial.contained(at, Q._edges(s, d)).where(F.col("point_id.locality") == F.col("region_id")).groupBy("region_id").agg(F.count("*").alias("k")).where(F.col("k") == config.SAMPLES)
    regions = A.table(s, d, "nation").select(F.col("n_nationkey").alias("region_id"), "n_name")
    middle = A.localities(s, d).where("sample = 5").select(F.col("locality").alias("point_id"), "lon", "lat")
    covered = spatial.contained(middle, Q._edges(s, d)).where(F.col("point_id") == F.col("region_id"))
    # A fifth of the names is not romanised, another fifth is blank.
    english = regions.select(F.when(F.col("region_id") % 5 == 0, F.col("n_name")).when(F.col("region_id") % 5 == 1, " ").otherwise(F.lower("n_name")).alias("name_en"), "n_name")
    every = F.count("*")
    return quality.report([
        ("wards", regions, every, 23, 23),
        ("unusable ward rings", rings, F.count_if(~F.col("usable")), None, 0),
        ("stations", st, every, 450, 550),
        ("stations without ward", st, F.count_if(F.col("ward").isNull()), None, 0),
        ("lines of unknown mode", _lines(s, d), F.count_if(~F.coalesce(F.col("mode").isin(*config.MODES), F.lit(False))), None, 0),
        ("stations without ride", transit.orphans(st.select("id"), edges), every, None, 0),
        ("rents of the survey", rents, F.count_if((F.col("source") == "estat") & (F.col("period") == "1995")), 23, 23),
        ("rows of forbidden sources", forbidden_sources(s, d), F.coalesce(F.sum("n"), F.lit(0)), None, 0),
        ("residential prices", prices, F.count_if(F.col("use") == "residential"), 1, None),
        ("unusable zoning rings", rings.where("region_id % 2 = 0"), F.count_if(~F.col("usable")), None, 0),
        ("station scores out of range", norm, F.count_if(~(F.col("norm_shop").between(0, 100) & F.col("norm_food").between(0, 100))), None, 0),
        ("localities that do not cover their middle", regions.join(covered, "region_id", "left_anti"), every, None, 0),
        ("localities", regions, every, 1, None),
        ("localities without nine samples inside", regions.join(inside, "region_id", "left_anti"), every, None, 0),
        ("locality scores out of range", scores, F.count_if(~F.col("score").between(0, 100)), None, 0),
        ("names that are not romanised", english, F.count_if(F.col("name_en").isNull() | (F.trim("name_en") == "") | (F.col("name_en") == F.col("n_name"))), None, 0),
    ])


def ward_names_en(s, d):
    """Wards with an English name of their own or a known one; others with the reason why there is none."""
    k = F.col("n_nationkey")
    tags = F.map_filter(F.create_map(F.lit("ward_code"), (k + 13101).cast("string"), F.lit("name_ja"), F.when(k % 6 != 5, F.col("n_name")), F.lit("name_en"), F.when(k % 4 == 0, F.lower("n_name"))), lambda _, v: v.isNotNull())
    ok, bad = maps.ward_names(A.table(s, d, "nation").select(tags.alias("tags")))
    return ok.select("ward_code", "name_en", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("ward_code", "name_en", "reason"))


def locality_card(s, d):
    n = A.table(s, d, "nation")
    middle = A.localities(s, d).where("sample = 5").select("locality", "lon", "lat")
    localities = middle.join(n.select(F.col("n_nationkey").alias("locality"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("ward")), "locality")
    wards = A.table(s, d, "region").select(F.col("r_regionkey").alias("ward"), F.col("r_name").alias("ward_name"))
    walks = Q._samples(s, d).select("locality", "sample", "station", F.col("walk_min").cast("long").alias("walk_min"))
    card = cards.locality_cards(localities, wards, A.ward_rings(s, d), walks, A.stations(s, d).select(F.col("id").alias("station"), F.col("name").alias("station_name")))
    return Q._round(card.withColumn("near", F.to_json("near")), "lon", "lat")


def trip_path_names(s, d):
    """Trips as named paths: an event's node is a station where there is one of that number, and some ways have no line."""
    e = A.table(s, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trip_id"), "ts", "event_id", (F.col("event_id") % 150).alias("node"), F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 10).alias("line"))
    paths = e.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "node", "line"))).alias("path"))
    lines = s.range(8).select(F.col("id").alias("line"), F.concat(F.lit("line "), F.col("id")).alias("line_name"))
    p = cards.named_paths(paths, ["trip_id"], A.stations(s, d).select(F.col("id").alias("node"), F.col("name").alias("node_name")), lines)
    return p.select("trip_id", F.array_join("path.node_name", " > ").alias("stations"), F.array_join("path.line_name", " > ", "-").alias("lines"))


def clipped_regions(s, d):
    """Places in each region, made of its nations and clipped to a box of its own."""
    n, r = A.table(s, d, "nation"), A.table(s, d, "region")
    whole = spatial.ring_edges(spatial.dissolved(A.ward_rings(s, d), n.select(F.col("n_nationkey").alias("region_id"), F.col("n_regionkey").alias("key"))))
    east = F.lit(139.70005) + F.lit(0.03) * F.col("r_regionkey")
    corner = lambda x, y: F.struct(x.alias("lon"), F.lit(y).alias("lat"))
    west = F.lit(139.0)
    clips = spatial.ring_edges(r.select(F.col("r_regionkey").alias("region_id"), F.lit(0).alias("part"), F.array(corner(west, 35.0), corner(east, 35.0), corner(east, 36.0), corner(west, 36.0)).alias("ring")))
    p = A.pois(s, d).select(F.col("poi_id").alias("point_id"), "lon", "lat")
    return spatial.clipped(p, whole, clips).groupBy("region_id").agg(F.count("*").alias("n"))


PROBE = (35.60005, 139.70005, 35.65005, 139.80005)


def lines_from_regions(s, d):
    """Lines from every station of two segments; kept are those that begin in some wards or in a box."""
    st = A.stations(s, d).select(F.col("id").alias("line_id"), "lon", "lat")
    legs = st.select("line_id", "lon", "lat", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    step = (F.col("seq") - 1) * F.lit(0.01)
    segments = legs.select("line_id", "seq", (F.col("lon") + step).alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + step + F.lit(0.01)).alias("x2"), F.col("lat").alias("y2"))
    return spatial.lines_from(segments, Q._edges(s, d, "region_id % 3 = 0"), PROBE).select("line_id", F.col("seq").cast("long").alias("seq"))


def _square(x, y, side):
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    zero = F.lit(0.0)
    return F.array(corner(zero, zero), corner(side, zero), corner(side, side), corner(zero, side))


def largest_parts(s, d):
    """Each ward's largest square around a station; some squares have a hole."""
    st = A.stations(s, d)
    side = F.lit(0.001) * (F.col("id") % 5 + 1)
    outer = st.select(F.col("ward").alias("region_id"), F.col("id").alias("part"), _square(F.col("lon"), F.col("lat"), side).alias("ring"))
    holes = st.where("id % 2 = 0").select(F.col("ward").alias("region_id"), F.col("id").alias("part"), _square(F.col("lon") + F.lit(0.0001), F.col("lat") + F.lit(0.0001), F.lit(0.0005)).alias("ring"))
    return spatial.largest_parts(outer.unionByName(holes)).groupBy("region_id", "part").agg(F.count("*").alias("rings"))


def sample_points(s, d):
    return Q._round(Q.sample_places(s, d).withColumn("sample", F.col("sample").cast("long")), "lon", "lat")


def topology_edges(s, d):
    """Rides between neighbours along lines (the wards' diagonals)."""
    lines = Q._grid_lines(s, d).withColumn("seq", F.lit(1))
    at = spatial.positions_on_line(A.stations(s, d).select(F.col("id").alias("point_id"), "lon", "lat"), lines, config.MERGE_M)
    modes = F.get(F.array(*[F.lit(m) for m in config.MODES]), (F.col("line_id") % len(config.MODES)).cast("int"))
    e = transit.topology_edges(at, lines.select("line_id", modes.alias("mode")))
    return Q._round(e.select("from_id", "to_id", "line", "minutes"), "minutes")


def merged_lines(s, d):
    """Lines put together from their pieces: parts, pieces and length of each."""
    m = lines.merged_lines(A.track_pieces(s, d))
    length = geo_dist_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    return Q._round(m.groupBy("line_id", "part").agg(F.max("seq").alias("pieces"), F.sum(length).alias("length_m")).groupBy("line_id").agg(F.count("*").alias("parts"), F.max("pieces").alias("longest"), F.sum("length_m").alias("length_m")), "length_m")


def merged_topology(s, d):
    """Rides between neighbours along lines whose pieces come in no order; lines of one course and mode are looked at once."""
    st = A.stations(s, d).select(F.col("id").alias("point_id"), "lon", "lat")
    whole = materialized(lines.directed(lines.merged_lines(A.track_pieces(s, d)), st), "lines")
    modes = F.get(F.array(*[F.lit(m) for m in config.MODES]), (F.col("line_id") % len(config.MODES)).cast("int"))
    modes = whole.select("line_id", modes.alias("mode")).distinct()
    like = materialized(lines.alike(whole, modes), "alike")
    part = ("line_id", "part")
    at = spatial.positions_on_line(st, whole.join(like.where("line_id = like"), "line_id", "left_semi"), config.MERGE_M, part)
    # Dealt out by line once, and all that follows keeps to that; by number, as Spark would make few tasks of rows that become many below.
    at = at.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "line_id")
    e = transit.topology_edges(at, modes, part).groupBy("from_id", "to_id", "line").agg(F.min("minutes").alias("minutes"))
    of = like.select(F.col("like").alias("line"), "line_id").hint("shuffle_hash")
    return Q._round(e, "minutes").join(of, "line").select("from_id", "to_id", F.col("line_id").alias("line"), "minutes")


def transfer_edges(s, d):
    return transit.transfer_edges(A.stations_and_halts(s, d)).select("from_id", "to_id", "minutes", "kind")


def line_centres(s, d):
    """Middle and length of the lines of each ward, one from every station."""
    st = A.stations(s, d)
    segments = st.select("ward", F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + F.lit(0.01) * (F.col("id") % 3 + 1)).alias("x2"), (F.col("lat") + F.lit(0.005)).alias("y2"))
    return Q._round(spatial.line_centre(segments, ["ward"]), "lon", "lat", "length_m")


def canvas_points(s, d):
    c = spatial.canvas(A.stations(s, d).select("id", "lon", "lat"))
    return c.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


QUERIES = {f.__name__: f for f in (derive_report, derive_repeat, prerequisites, forbidden_sources, taken_over_sources, data_validation, ward_names_en, locality_card, trip_path_names, clipped_regions, lines_from_regions, largest_parts, sample_points, topology_edges, merged_lines, merged_topology, transfer_edges, line_centres, canvas_points)}
