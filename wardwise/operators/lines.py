"""Lines put together from pieces in any order: chains over points where just two pieces meet, by list ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardwise.sources.shared import materialized

from .graph import components

PIECE = ["line_id", "piece"]
HALF = [*PIECE, "to_end"]  # a piece run through towards its first (0) or second end (1)


def _joints(pieces: DataFrame) -> DataFrame:
    """Points where two ends meet and no third: the ends a and b (piece, end), line_id, x, y."""
    ends = pieces.select(*PIECE, F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(*PIECE, "p.*")
    met = ends.groupBy("line_id", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("piece", "end")).alias("a"), F.max(F.struct("piece", "end")).alias("b"))
    return met.where("n = 2").drop("n")


def _opened(pieces: DataFrame, joints: DataFrame) -> DataFrame:
    """The joints without one of each closed loop, that of the smallest point."""
    node = lambda c: F.struct("line_id", F.col(c).alias("piece"))
    of = components(pieces.select(F.struct(*PIECE).alias("id")), joints.select(node("a.piece").alias("a_id"), node("b.piece").alias("b_id")))
    size = of.groupBy("component").agg(F.count("*").alias("pieces"))
    known = joints.withColumn("id", node("a.piece")).join(of, "id").drop("id")
    loops = known.groupBy("component").agg(F.count("*").alias("joints"), F.min(F.struct("x", "y")).alias("cut")).join(size, "component").where("joints = pieces").select("component", "cut")
    return known.join(loops, "component", "left").where(F.col("cut").isNull() | (F.struct("x", "y") != F.col("cut"))).select(*joints.columns)


def _ranked(steps: DataFrame) -> DataFrame:
    """Hops to the last half piece of each chain, and which that is. steps: HALF, and the next one as next_piece, next_end (null at the end).

    Each round every half piece takes over what the one it points to points to, so the rounds are the logarithm of the longest chain.
    """
    end = F.struct("piece", "to_end")
    found = materialized(steps.select(*HALF, "next_piece", "next_end", F.when(F.col("next_piece").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("hops"), end.alias("last")), "ranks")
    while found.where("next_piece is not null").limit(1).count():
        far = found.toDF("line_id", "next_piece", "next_end", "far_piece", "far_end", "far_hops", "far_last")
        found = materialized(found.join(far.hint("shuffle_hash"), ["line_id", "next_piece", "next_end"], "left").select(*HALF, F.col("far_piece").alias("next_piece"), F.col("far_end").alias("next_end"), (F.col("hops") + F.coalesce("far_hops", F.lit(0))).alias("hops"), F.coalesce("far_last", "last").alias("last")), "ranks")
    return found


def merged_lines(pieces: DataFrame) -> DataFrame:
    """Pieces (line_id, piece, x1, y1, x2, y2; any order, either way round) as chains: line_id, part, seq, x1, y1, x2, y2, each run through
    in the direction of its chain.

    Pieces join where just two ends of a line meet; at crossings and forks chains end. A closed loop is cut at its smallest point. A chain
    runs towards its larger end point (of a loop: comes in from the larger side), parts are numbered by their ends, so neither the order of the
    pieces nor their direction changes the result. Pieces without length or with unknown ends are left out.
    """
    known = pieces.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and not (x1 = x2 and y1 = y2)").select(*PIECE, "x1", "y1", "x2", "y2")
    known = materialized(known, "pieces")
    joints = materialized(_opened(known, materialized(_joints(known), "joints")), "joints")

    def step(a: str, b: str) -> DataFrame:
        """Who comes in by end a goes on with the other piece, away from its end b."""
        return joints.select("line_id", F.col(f"{a}.piece").alias("piece"), F.col(f"{a}.end").alias("to_end"), F.col(f"{b}.piece").alias("next_piece"), (1 - F.col(f"{b}.end")).alias("next_end"))

    halves = known.withColumn("to_end", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.col("to_end") == 1
    run = [F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}1") for c in "xy"] + [F.when(first, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}2") for c in "xy"]
    halves = halves.select(*HALF, *run)
    ranks = _ranked(halves.select(*HALF).join(step("a", "b").unionByName(step("b", "a")), HALF, "left"))
    ends = halves.select("line_id", F.struct("piece", "to_end").alias("last"), F.struct("x2", "y2", "x1", "y1", "piece").alias("goal"))
    both = halves.join(ranks.select(*HALF, "hops", "last"), HALF).join(ends, ["line_id", "last"])
    best = both.groupBy(*PIECE).agg(F.max(F.struct("goal", "to_end", "last", "hops", "x1", "y1", "x2", "y2")).alias("h")).select("line_id", "h.*")
    best = materialized(best, "chains")
    chains = best.groupBy("line_id", "last").agg(F.max("hops").alias("most"), F.first("goal").alias("goal"))
    chains = chains.withColumn("part", F.row_number().over(Window.partitionBy("line_id").orderBy("goal")))
    return best.join(chains.select("line_id", "last", "most", "part"), ["line_id", "last"]).select("line_id", "part", (F.col("most") - F.col("hops") + 1).alias("seq"), "x1", "y1", "x2", "y2")


def directed(chains: DataFrame, points: DataFrame) -> DataFrame:
    """Chains (as from ``merged_lines``), each run through towards the end with the larger point; an end without one comes last.

    points: point_id, lon, lat; of several at one end the least counts. A chain that they do not settle stays as it is.
    """
    part, at = ["line_id", "part"], lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    least = points.groupBy(at("lon", "lat").alias("at")).agg(F.min("point_id").alias("id"))
    ends = chains.groupBy(*part).agg(F.max("seq").alias("n"), F.min_by(at("x1", "y1"), "seq").alias("a"), F.max_by(at("x2", "y2"), "seq").alias("b"))
    for e in "ab":
        ends = ends.join(least.select(F.col("at").alias(e), F.col("id").alias(f"{e}_id")), e, "left")
    turned = F.col("b_id").isNotNull() & (F.col("a_id").isNull() | (F.col("a_id") > F.col("b_id")))
    turn = [F.when(F.col("turned"), F.col(f"{n}{3 - e}")).otherwise(F.col(f"{n}{e}")).alias(f"{n}{e}") for e in (1, 2) for n in "xy"]
    return chains.join(ends.select(*part, "n", turned.alias("turned")), part).select(*part, F.when(F.col("turned"), F.col("n") + 1 - F.col("seq")).otherwise(F.col("seq")).alias("seq"), *turn)


def alike(chains: DataFrame, lines: DataFrame) -> DataFrame:
    """line_id and, as ``like``, the least line that has the same course and the same else. lines: line_id, more."""
    more = [c for c in lines.columns if c != "line_id"]
    course = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("part", "seq", "x1", "y1", "x2", "y2")))), 256)
    of = chains.groupBy("line_id").agg(course.alias("course")).join(lines, "line_id").withColumn("course", F.struct("course", *more))
    return of.join(of.groupBy("course").agg(F.min("line_id").alias("like")), "course").select("line_id", "like")
