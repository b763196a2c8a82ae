"""Spatial joins as equi-joins on grid cells with an exact check after them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwise.functions.geo import cell, geo_dist_m, lat_step, lattice_offsets, lon_step, row_step
from wardwise.sources.shared import materialized

BAND = 0.01  # degrees of latitude of a band of polygon edges
LINE_CELL = 0.005  # degrees of a cell of line segments


def near(anchors: DataFrame, points: DataFrame, radius_m: float, distance=geo_dist_m) -> DataFrame:
    """Pairs within a radius with ``dist_m``. anchors: anchor_id, alon, alat, more; points: lon, lat, more.

    Cells are as wide as the radius at the latitudes of their row. Anchors go to the nine
    cells around them, so a point meets an anchor once at most; Spark splits the
    partitions of crowded cells. Ways over the 180th meridian are not looked for.
    """
    step = lat_step(radius_m)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), x -> transform(sequence(-1, 1), y -> struct(x, y))))"))
    a = anchors.withColumn("_d", around).withColumn("_gy", cell(F.col("alat"), step) + F.col("_d.y")).withColumn("_gx", F.floor(F.col("alon") / row_step(radius_m, F.col("_gy"))) + F.col("_d.x")).drop("_d")
    p = points.withColumn("_gy", cell(F.col("lat"), step)).withColumn("_gx", F.floor(F.col("lon") / row_step(radius_m, F.col("_gy"))))
    both = a.join(p, ["_gx", "_gy"]).withColumn("dist_m", distance(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon")))
    return both.where(F.col("dist_m") <= radius_m).drop("_gx", "_gy")


def near_by_place(anchors: DataFrame, points: DataFrame, radius_m: float, here: dict, over: dict, then: dict | None = None) -> DataFrame:
    """All anchors with aggregates over the points within the radius: ``here`` is of the points of one place (lon, lat), ``over`` of what
    ``here`` gave for the places around. Anchors without points keep nulls. What is made of wide aggregates (``then``) is made before they
    go to the anchors, which get it alone.

    Anchors and points of one place are looked at once, so the pairs follow the number of different places and not that of the rows.
    """
    places = points.groupBy("lon", "lat").agg(*[c.alias(n) for n, c in here.items()])
    found = near(anchors.select("alon", "alat").distinct(), places, radius_m).groupBy("alon", "alat").agg(*[c.alias(n) for n, c in over.items()])
    if then is not None:
        found = found.select("alon", "alat", *[c.alias(n) for n, c in then.items()])
    return anchors.join(found, ["alon", "alat"], "left").select(*anchors.columns, *(over if then is None else then))


def self_pairs(points: DataFrame, radius_m: float, distance=geo_dist_m) -> DataFrame:
    """Ordered pairs (a_id, b_id) of different points within the radius."""
    a = points.select(F.col("id").alias("anchor_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    both = near(a, points.select(F.col("id").alias("b_id"), "lon", "lat"), radius_m, distance)
    return both.where(F.col("anchor_id") != F.col("b_id")).select(F.col("anchor_id").alias("a_id"), "b_id", "dist_m")


def nearest(anchors: DataFrame, points: DataFrame, k: int, radius_m: float) -> DataFrame:
    """The k nearest points within the radius, in order of degrees, ties by id; points: id, lon, lat."""
    both = near(anchors, points, radius_m)
    degrees = F.pow(F.col("alat") - F.col("lat"), 2) + F.pow(F.col("alon") - F.col("lon"), 2)
    w = Window.partitionBy("anchor_id").orderBy(degrees, "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges of closed or open rings: region_id, part, ring (array of lon, lat) to region_id, part, x1, y1, x2, y2.

    Level edges cross no level line and are left out. Rings of fewer than three points have no inside.
    """
    n = F.size("ring")
    pairs = F.transform("ring", lambda p, i: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), F.get("ring", (i + 1) % n)["lon"].alias("x2"), F.get("ring", (i + 1) % n)["lat"].alias("y2")))
    return rings.where(n >= 3).select("region_id", "part", F.explode(pairs).alias("e")).select("region_id", "part", "e.*").where(F.col("y1") != F.col("y2"))


def contained(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (point_id, region_id) by the parity of edges to the right; holes are rings of the same part."""
    return _contained(points, edges, ["point_id"]).distinct()


def _contained(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """As ``contained``, of points known by some columns; a row for each part.

    A region is first met in the cells of its bounds, then by its edges in the point's band.
    """
    bounds = edges.groupBy("region_id", "part").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"))
    size = 0.05
    cells = bounds.withColumn("gx", F.explode(F.sequence(cell(F.col("w"), size), cell(F.col("e"), size)))).withColumn("gy", F.explode(F.sequence(cell(F.col("s"), size), cell(F.col("n"), size))))
    p = points.select(*keys, "lon", "lat").withColumn("gx", cell(F.col("lon"), size)).withColumn("gy", cell(F.col("lat"), size))
    met = p.join(cells, ["gx", "gy"]).where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    met = met.select(*keys, "lon", "lat", "region_id", "part", cell(F.col("lat"), BAND).alias("band"))
    bands = edges.withColumn("band", F.explode(F.sequence(cell(F.least("y1", "y2"), BAND), cell(F.greatest("y1", "y2"), BAND))))
    crosses = ((F.col("y1") <= F.col("lat")) != (F.col("y2") <= F.col("lat"))) & (F.col("lon") < F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    inside = met.join(bands, ["region_id", "part", "band"]).where(crosses).groupBy(*keys, "region_id", "part").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return inside.select(*keys, "region_id")


def lattice(anchors: DataFrame, radius_m: float, n: int, keys: tuple[str, ...] = ("anchor_id",)) -> DataFrame:
    """n points of equal areas around each anchor: anchor_id (or other columns), i, lon, lat."""
    at = anchors.select(*dict.fromkeys((*keys, "alon", "alat")), F.explode(lattice_offsets(n)).alias("o"))
    per_degree = 111320.0
    lat = F.col("alat") + F.col("o.north") * F.lit(radius_m / per_degree)
    lon = F.col("alon") + F.col("o.east") * F.lit(radius_m / per_degree) / F.cos(F.radians("alat"))
    return at.select(*keys, F.col("o.i").alias("i"), lon.alias("lon"), lat.alias("lat"))


PLACE = ("alon", "alat")  # anchors of one place have one circle


TASK_POINTS = 1 << 17  # points of lattices that a task has at a time, about


def _lattices(anchors: DataFrame, radius_m: float, n: int) -> DataFrame:
    """The lattice of each different place of the anchors, dealt out by places: a task has all of a place's points, and as many as
    ``TASK_POINTS`` however many places there are."""
    places = anchors.select(*PLACE).distinct()
    tasks = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-places.count() * n // TASK_POINTS))
    return lattice(anchors.select(*PLACE).repartition(tasks, *PLACE).distinct(), radius_m, n, PLACE)


def _share(anchors: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """Share of each anchor's lattice that is met; met: place and i, a point once or more."""
    hits = met.select(*PLACE, "i").distinct().groupBy(*PLACE).agg(F.count("*").alias("hits"))
    return anchors.select("anchor_id", *PLACE).join(hits, [*PLACE], "left").select("anchor_id", (F.coalesce("hits", F.lit(0)) / F.lit(n)).alias("share"))


def coverage_share(anchors: DataFrame, edges: DataFrame, radius_m: float, n: int = 1024) -> DataFrame:
    """Share of each anchor's circle that lies in any region; overlaps count once."""
    return _share(anchors, _contained(_lattices(anchors, radius_m, n), edges, [*PLACE, "i"]), n)


def segment_distance_m(lon, lat, x1, y1, x2, y2):
    """Metres from a point to a segment, on a plane at the point's latitude."""
    kx, ky = F.lit(111320.0) * F.cos(F.radians(lat)), F.lit(111320.0)
    ax, ay, bx, by = (x1 - lon) * kx, (y1 - lat) * ky, (x2 - lon) * kx, (y2 - lat) * ky
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / length))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def line_cells(segments: DataFrame, radius_m: float) -> DataFrame:
    """Segments with the cells (gx, gy) that they come near to, column by column: a long one has about as many as it is long."""
    pad_lat = lat_step(radius_m)
    pad_lon = lon_step(radius_m, F.greatest(F.abs("y1"), F.abs("y2")) + F.lit(pad_lat))
    wide = segments.withColumn("_p", pad_lon).withColumn("gx", F.explode(F.sequence(cell(F.least("x1", "x2") - F.col("_p"), LINE_CELL), cell(F.greatest("x1", "x2") + F.col("_p"), LINE_CELL))))
    dx, most = F.col("x2") - F.col("x1"), F.lit(1e-5)  # steeper ones are taken whole, as their places in a column are not exact

    def level(x: Column, other: float) -> Column:
        """Latitude of the segment at a longitude, or of its end."""
        t = F.when(F.abs(dx) >= most, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("x1")) / dx))).otherwise(F.lit(other))
        return F.col("y1") + t * (F.col("y2") - F.col("y1"))

    west, east = level(F.col("gx") * F.lit(LINE_CELL) - F.col("_p"), 0.0), level((F.col("gx") + 1) * F.lit(LINE_CELL) + F.col("_p"), 1.0)
    spare = F.lit(pad_lat + 1e-8)
    return wide.withColumn("gy", F.explode(F.sequence(cell(F.least(west, east) - spare, LINE_CELL), cell(F.greatest(west, east) + spare, LINE_CELL)))).drop("_p")


def near_lines(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of points (point_id, lon, lat) and segments (x1, y1, x2, y2, more) within a distance."""
    wide = line_cells(segments, radius_m)
    p = points.withColumn("gx", cell(F.col("lon"), LINE_CELL)).withColumn("gy", cell(F.col("lat"), LINE_CELL))
    d = segment_distance_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))
    return p.join(wide, ["gx", "gy"]).drop("gx", "gy").withColumn("line_m", d).where(F.col("line_m") <= radius_m)


def cut_segments(segments: DataFrame, most: float = LINE_CELL) -> DataFrame:
    """Segments in pieces of at most that many degrees, so that none covers more than a few cells."""
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / F.lit(most)))
    others = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    s = segments.withColumn("_n", pieces.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str, i):
        return F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")

    return s.select(*others, at("x1", "x2", F.col("_i")).alias("x1"), at("y1", "y2", F.col("_i")).alias("y1"), at("x1", "x2", F.col("_i") + 1).alias("x2"), at("y1", "y2", F.col("_i") + 1).alias("y2"))


def near_line_share(anchors: DataFrame, segments: DataFrame, radius_m: float, buffer_m: float, n: int = 1024) -> DataFrame:
    """Share of each anchor's circle within a distance of any line."""
    return _share(anchors, near_lines(_lattices(anchors, radius_m, n), cut_segments(segments.select("x1", "y1", "x2", "y2")), buffer_m), n)


def _candidates(edges: DataFrame, tries: int) -> DataFrame:
    """Places of a Halton sequence over each region's bounds that lie inside it: region_id, i, lon, lat, point_id."""
    bounds = edges.groupBy("region_id").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("t"))
    c = bounds.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    c = c.select("region_id", "i", (F.col("w") + (F.col("e") - F.col("w")) * _radical(F.col("i"), 2)).alias("lon"), (F.col("s") + (F.col("t") - F.col("s")) * _radical(F.col("i"), 3)).alias("lat")).withColumn("point_id", F.struct("region_id", "i"))
    inside = contained(c, edges).where(F.col("point_id.region_id") == F.col("region_id")).select("point_id")
    return c.join(inside, "point_id", "left_semi")


def _radical(i, base: int):
    digits = F.sequence(F.lit(0), F.lit(12))
    return F.aggregate(digits, F.lit(0.0), lambda acc, k: acc + F.pmod(F.floor(i / F.pow(F.lit(float(base)), k)), F.lit(base)) / F.pow(F.lit(float(base)), k + 1))


def _places_on_levels(edges: DataFrame, n: int) -> DataFrame:
    """n inner places of any region, however thin: the middle of the widest stretch inside, on n levels of the tallest part."""
    tall = edges.groupBy("region_id", "part").agg(F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("t"))
    tall = tall.groupBy("region_id").agg(F.max(F.struct((F.col("t") - F.col("s")).alias("h"), "s", "part")).alias("m")).select("region_id", "m.part", "m.s", "m.h")
    levels = tall.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("lat", F.col("s") + F.col("h") * (F.col("i") - 0.5) / n)
    met = levels.join(edges, ["region_id", "part"]).where((F.col("y1") <= F.col("lat")) != (F.col("y2") <= F.col("lat")))
    xs = met.groupBy("region_id", "i", "lat").agg(F.array_sort(F.collect_list(F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))).alias("x"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda k: F.struct((F.get("x", 2 * k + 1) - F.get("x", 2 * k)).alias("width"), ((F.get("x", 2 * k) + F.get("x", 2 * k + 1)) / 2).alias("lon")))
    return xs.select("region_id", "i", F.array_max(spans)["lon"].alias("lon"), "lat")


def _first_places(places: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Of every region's places the first n, numbered by place; regions with fewer take the middles of n levels."""
    by = Window.partitionBy("region_id")
    first = places.withColumn("k", F.row_number().over(by.orderBy("i"))).where(F.col("k") <= n).withColumn("m", F.count("*").over(by)).where(F.col("m") == n).select("region_id", "lon", "lat")
    thin = _places_on_levels(edges.join(first.select("region_id").distinct(), "region_id", "left_anti"), n).select("region_id", "lon", "lat")
    return first.unionByName(thin).select("region_id", F.row_number().over(by.orderBy("lon", "lat")).alias("sample"), "lon", "lat")


def sample_region(edges: DataFrame, n: int = 9, tries: int = 256) -> DataFrame:
    """The first n points of a Halton sequence over a region's bounds that lie inside it, numbered by place.

    Regions so thin that fewer than n of the tries meet them take the middles of n levels.
    """
    return _first_places(_candidates(edges, tries), edges, n)


BOX = ["region_id", "in_homes", "box"]  # what a lattice is laid for


def _boxes(edges: DataFrame, *by: str) -> DataFrame:
    """Bounds of regions or parts: by, w, s, e, t."""
    return edges.groupBy(*by).agg(F.min(F.least("x1", "x2")).alias("w"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("x1", "x2")).alias("e"), F.max(F.greatest("y1", "y2")).alias("t"))


def _overlaps(own: DataFrame, homes: DataFrame) -> DataFrame:
    """Where the bounds of regions and of homes' parts meet: region_id, home, w, s, e, t. A pair is met once, in the first cell that both have."""
    size = 0.05

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("gx", F.explode(F.sequence(cell(F.col("w"), size), cell(F.col("e"), size)))).withColumn("gy", F.explode(F.sequence(cell(F.col("s"), size), cell(F.col("t"), size))))

    theirs = homes.select(F.struct("region_id", "part").alias("home"), *[F.col(c).alias(f"h{c}") for c in "wset"])
    theirs = theirs.withColumn("gx", F.explode(F.sequence(cell(F.col("hw"), size), cell(F.col("he"), size)))).withColumn("gy", F.explode(F.sequence(cell(F.col("hs"), size), cell(F.col("ht"), size))))
    met = cells(own).join(theirs, ["gx", "gy"])
    out = met.select("region_id", "home", "gx", "gy", F.greatest("w", "hw").alias("w"), F.greatest("s", "hs").alias("s"), F.least("e", "he").alias("e"), F.least("t", "ht").alias("t")).where("w < e and s < t")
    return out.where((F.col("gx") == cell(F.col("w"), size)) & (F.col("gy") == cell(F.col("s"), size))).drop("gx", "gy")


def _lattice_of(boxes: DataFrame, side: int) -> DataFrame:
    """Middles of side x side cells of each box (columns of ``BOX`` and w, s, e, t): gx, gy, lon, lat."""
    c = boxes.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    at = lambda a, b, g: F.col(a) + (F.col(b) - F.col(a)) * (F.col(g) + 0.5) / side
    return c.select(*BOX, "gx", "gy", at("w", "e", "gx").alias("lon"), at("s", "t", "gy").alias("lat"))


def _odd(cells: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with an odd number of edges to their right, of the edges with the same keys."""
    bands = edges.withColumn("band", F.explode(F.sequence(cell(F.least("y1", "y2"), BAND), cell(F.greatest("y1", "y2"), BAND))))
    crosses = ((F.col("y1") <= F.col("lat")) != (F.col("y2") <= F.col("lat"))) & (F.col("lon") < F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    met = cells.withColumn("band", cell(F.col("lat"), BAND)).join(bands, [*keys, "band"]).where(crosses)
    by = [*cells.columns, *(["part"] if "part" in edges.columns else [])]
    return met.groupBy(*by).agg((F.count("*") % 2 == 1).alias("odd")).where("odd").select(*cells.columns).distinct()


def _met(cells: DataFrame, edges: DataFrame, parts: DataFrame, homes: DataFrame) -> DataFrame:
    """Cells whose middle lies in their own region and, where ``in_homes``, in any of the homes' parts that it shares bounds with."""
    own = _odd(cells, edges.select("region_id", "part", "x1", "y1", "x2", "y2"), ["region_id"])
    near = parts.select("region_id", "home", *[F.col(c).alias(f"h{c}") for c in "wset"])
    both = own.where("in_homes").join(near, "region_id").where(F.col("lon").between(F.col("hw"), F.col("he")) & F.col("lat").between(F.col("hs"), F.col("ht"))).select(*cells.columns, "home")
    theirs = homes.select(F.struct("region_id", "part").alias("home"), "x1", "y1", "x2", "y2")
    return own.where("not in_homes").unionByName(_odd(both, theirs, ["home"]).select(*cells.columns).distinct())


def component_of(mask: np.ndarray) -> np.ndarray:
    """The cells of the largest piece of a mask, joined by their sides; of equal ones that of the first cell."""
    n = mask.size
    label = np.where(mask, np.arange(n).reshape(mask.shape), n)
    while True:
        low = label.copy()
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
            low[a] = np.minimum(low[a], label[b])
            low[:, a] = np.minimum(low[:, a], label[:, b])
        low = np.append(low.ravel(), n)
        low = np.where(mask, low[low[:-1]].reshape(mask.shape), n)  # its label's own label
        if (low == label).all():
            return label == np.bincount(label[mask]).argmax()
        label = low


def largest_components(cells: DataFrame, side: int) -> DataFrame:
    """Of each box's cells those of the largest piece. A box has side x side cells at most."""
    kind = cells.schema["region_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        mask = np.zeros((side, side), bool)
        x, y = t["gx"].to_numpy(), t["gy"].to_numpy()
        mask[x, y] = True
        return t.filter(pa.array(component_of(mask)[x, y]))

    return cells.select(*BOX, "gx", "gy", "lon", "lat").groupBy(*BOX).applyInArrow(run, f"region_id {kind}, in_homes boolean, box long, gx int, gy int, lon double, lat double")


def _around(pieces: DataFrame, boxes: DataFrame, side: int) -> DataFrame:
    """Bounds of the pieces of cells with a cell more on each side, inside their boxes, and the number of cells."""
    b = pieces.groupBy(*BOX).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.count("*").alias("k")).join(boxes, BOX)
    at = lambda a, z, g: F.col(a) + (F.col(z) - F.col(a)) * g / side
    low, high = (lambda g: F.greatest(F.lit(0), F.col(g) - 1)), (lambda g: F.least(F.lit(side), F.col(g) + 2))
    size = (F.col("k") * (F.col("e") - F.col("w")) * (F.col("t") - F.col("s"))).alias("size")
    return b.select(*BOX, at("w", "e", low("x0")).alias("w"), at("s", "t", low("y0")).alias("s"), at("w", "e", high("x1")).alias("e"), at("s", "t", high("y1")).alias("t"), size)


def _z_order(bits: int) -> Column:
    """Place of a cell on a curve that keeps near cells together."""
    return sum((F.shiftleft(F.shiftright("gx", b).bitwiseAND(1), 2 * b) + F.shiftleft(F.shiftright("gy", b).bitwiseAND(1), 2 * b + 1) for b in range(bits)), F.lit(0))


def sample_homes(edges: DataFrame, homes: DataFrame, n: int = 9, side: int = 32) -> DataFrame:
    """n points of each region in the largest piece of what it and any of the homes' regions share, or of the region
    itself where they share nothing: region_id, sample (numbered by place), lon, lat, in_homes.

    A lattice over the shared bounds (where no cell of it is met, over each single shared part) gives the pieces, and a
    second lattice, over the bounds of the largest piece only, its cells. These are put in an order that keeps near cells
    together, and the middles of n equal stretches of it are the points. Pieces too thin for n cells of a lattice, or
    homes that no lattice meets, take the middles of n levels of the region.
    """
    edges, homes = materialized(edges, "edges"), materialized(homes, "homes")
    own, zero = _boxes(edges, "region_id"), F.lit(0).cast("long").alias("box")
    parts = materialized(_overlaps(own, _boxes(homes, "region_id", "part")), "shared_bounds")
    shared = parts.groupBy("region_id").agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("t").alias("t"))
    corners = ["w", "s", "e", "t"]
    boxes = shared.select("region_id", F.lit(True).alias("in_homes"), zero, *corners).unionByName(own.select("region_id", F.lit(False).alias("in_homes"), zero, *corners))
    found = materialized(_around(largest_components(_met(_lattice_of(boxes, side), edges, parts, homes), side), boxes, side), "pieces")
    missed = parts.join(found.where("in_homes").select("region_id"), "region_id", "left_anti").select("region_id", F.lit(True).alias("in_homes"), F.xxhash64("home").alias("box"), *corners)
    if missed.limit(1).count():
        found = found.unionByName(_around(largest_components(_met(_lattice_of(missed, side), edges, parts, homes), side), missed, side))
    # Homes before the whole region, and the largest of single parts.
    chosen = found.groupBy("region_id").agg(F.max_by(F.struct("in_homes", "box", *corners), F.struct("in_homes", "size", "box")).alias("b")).select("region_id", "b.*")
    chosen = materialized(chosen, "boxes")
    cells = largest_components(_met(_lattice_of(chosen, side), edges, parts, homes), side)
    by = Window.partitionBy("region_id")
    cells = cells.withColumn("m", F.count("*").over(by)).withColumn("r", F.row_number().over(by.orderBy(_z_order(side.bit_length() - 1))) - 1)
    picked = cells.where(F.col("m") >= n).where(F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((2 * k + 1) * F.col("m") / (2 * n)) == F.col("r")))
    points = materialized(picked.select("region_id", "lon", "lat", "in_homes"), "places")
    thin = _places_on_levels(edges.join(points.select("region_id").distinct(), "region_id", "left_anti"), n).select("region_id", "lon", "lat", F.lit(False).alias("in_homes"))
    return points.unionByName(thin).select("region_id", F.row_number().over(by.orderBy("lon", "lat")).alias("sample"), "lon", "lat", "in_homes")


def largest_parts(rings: DataFrame) -> DataFrame:
    """The rings of each region's largest part; of equal parts the first. A part's largest ring is its outer one, the others are holes."""
    size = usable_rings(rings).groupBy("region_id", "part").agg(F.round(2 * F.max("area") - F.sum("area"), 12).alias("a"))
    best = size.groupBy("region_id").agg(F.max_by("part", F.struct("a", (-F.col("part")).alias("p"))).alias("part"))
    return rings.join(best, ["region_id", "part"], "left_semi")


def dissolved(rings: DataFrame, keys: DataFrame) -> DataFrame:
    """Regions of one key as the parts of one region (keys: region_id, key); no outline is drawn anew."""
    return rings.join(keys.select("region_id", "key"), "region_id").select(F.col("key").alias("region_id"), F.struct("region_id", "part").alias("part"), "ring")


def clipped(points: DataFrame, edges: DataFrame, clips: DataFrame) -> DataFrame:
    """Pairs (point_id, region_id) of points inside both a region and the clip of the same id."""
    return contained(points, edges).join(contained(points, clips), ["point_id", "region_id"], "left_semi")


def lines_from(segments: DataFrame, edges: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Segments of the lines whose first vertex lies in any region or in the box (south, west, north, east)."""
    s, w, n, e = box
    first = segments.groupBy("line_id").agg(F.min_by(F.struct("x1", "y1"), "seq").alias("v")).select(F.col("line_id").alias("point_id"), F.col("v.x1").alias("lon"), F.col("v.y1").alias("lat"))
    boxed = first.where(F.col("lat").between(s, n) & F.col("lon").between(w, e)).select("point_id")
    kept = contained(first, edges).select("point_id").unionByName(boxed).select(F.col("point_id").alias("line_id")).distinct()
    return segments.join(kept, "line_id", "left_semi")


def interior_point(edges: DataFrame, tries: int = 256) -> DataFrame:
    """An inner point near the middle of each region."""
    points = _candidates(edges, tries).select("region_id", "lon", "lat").unionByName(_places_on_levels(edges, 1).select("region_id", "lon", "lat"))
    middle = points.groupBy("region_id").agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"))
    d = F.pow(F.col("lon") - F.col("mx"), 2) + F.pow(F.col("lat") - F.col("my"), 2)
    return points.join(middle, "region_id").groupBy("region_id").agg(F.min(F.struct(d.alias("d"), "lon", "lat")).alias("m")).select("region_id", "m.lon", "m.lat")


def usable_rings(rings: DataFrame) -> DataFrame:
    """Rings with whether they can bound an area: three points or more, finite, not all on a line."""
    n = F.size("ring")
    # From the first corner on, as products of whole degrees would lose the digits of small areas.
    x0, y0 = F.get("ring", F.lit(0))["lon"], F.get("ring", F.lit(0))["lat"]
    area = F.aggregate(F.transform("ring", lambda p, i: (p["lon"] - x0) * (F.get("ring", (i + 1) % n)["lat"] - y0) - (F.get("ring", (i + 1) % n)["lon"] - x0) * (p["lat"] - y0)), F.lit(0.0), lambda a, b: a + b) / 2
    finite = F.forall("ring", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & (F.abs(p["lon"]) < float("inf")) & (F.abs(p["lat"]) < float("inf")))
    return rings.withColumn("area", F.abs(area)).withColumn("usable", F.coalesce((n >= 3) & finite & (F.abs(area) > 0), F.lit(False)))


def line_centre(segments: DataFrame, by: list[str]) -> DataFrame:
    """Centre of lines by length."""
    length = geo_dist_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    s = segments.withColumn("len", length)
    return s.groupBy(*by).agg((F.sum((F.col("x1") + F.col("x2")) / 2 * F.col("len")) / F.sum("len")).alias("lon"), (F.sum((F.col("y1") + F.col("y2")) / 2 * F.col("len")) / F.sum("len")).alias("lat"), F.sum("len").alias("length_m"))


def positions_on_line(points: DataFrame, segments: DataFrame, radius_m: float, keys: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Where points within a distance of a line lie along it: keys, point_id, pos_m. segments: keys of a line, seq, x1, y1, x2, y2.

    Points of one place are looked at once. Segments are dealt out before they go to their cells, which Spark does not count: it would
    leave them all in a task or two. For that also neither side of the join is sent through the driver.
    """
    length = geo_dist_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("len", length).withColumn("before", F.coalesce(F.sum("len").over(before), F.lit(0.0)))
    s = s.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "seq")
    kx = F.lit(111320.0) * F.cos(F.radians("lat"))
    near_ones = near_lines(points.select("lon", "lat").distinct().hint("merge"), s, radius_m)
    dx, dy = (F.col("x2") - F.col("x1")) * kx, (F.col("y2") - F.col("y1")) * F.lit(111320.0)
    px, py = (F.col("lon") - F.col("x1")) * kx, (F.col("lat") - F.col("y1")) * F.lit(111320.0)
    t = F.when(dx * dx + dy * dy > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / (dx * dx + dy * dy)))).otherwise(F.lit(0.0))
    placed = near_ones.withColumn("pos_m", F.col("before") + t * F.col("len"))
    found = placed.groupBy(*keys, "lon", "lat").agg(F.min(F.struct("line_m", "seq", "pos_m"))["pos_m"].alias("pos_m"))
    return found.join(points.select("point_id", "lon", "lat").hint("shuffle_hash"), ["lon", "lat"]).select(*keys, "point_id", "pos_m")


def canvas(points: DataFrame, width: float = 1000.0) -> DataFrame:
    """Points scaled to a drawing of that width, north up, with the longitudes shortened at the middle latitude."""
    b = points.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    k = F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    scale = F.lit(width) / ((F.col("e") - F.col("w")) * k)
    return points.crossJoin(F.broadcast(b)).withColumn("x", (F.col("lon") - F.col("w")) * k * scale).withColumn("y", (F.col("n") - F.col("lat")) * scale).drop("w", "e", "s", "n")
