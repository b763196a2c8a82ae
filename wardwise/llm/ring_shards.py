"""Operator 4: shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a ring of 64-bit hashes and a bound on its
rows; the bounds differ by one row at most and add up to all rows, so the law is
``rows``. A row belongs to the arc that ends at the next point clockwise. An arc
fills that point's shard; rows beyond the shard's bound go on clockwise to the
next point whose shard still has room. Only rows of full shards move.

The ring is cut into cells, as many as the rows need, so that no task orders more
than a cell. A plan is made from the counts by arc (a fixed number, whatever the
input) and gives each arc's rows, by rank, to shards. Ranks and slots are a cell's
offset plus the rank inside the cell.

Null texts have size 1 and the checksum of the empty text; a row's place depends
on its doc_id and its text, and rows equal in both get neighbouring slots; null
doc_ids have a place like any other; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 4096
MAX_CELL_BITS = 40


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Points in order: place on the ring (62 bits) and shard."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            points[int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 2] = s
    return sorted(points.items())


def bounds(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def fill(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc, who gets its rows: (first rank, rows, shard). counts and owners by arc, clockwise."""
    room, n = list(room), len(counts)
    given: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    left = list(counts)
    for arc in range(n):  # first everybody's own rows
        take = min(left[arc], room[owners[arc]])
        if take:
            given[arc].append((0, take, owners[arc]))
            room[owners[arc]] -= take
            left[arc] -= take
    for arc in range(n):  # then what overflows, clockwise
        rank = counts[arc] - left[arc]
        step = 1
        while left[arc]:
            shard = owners[(arc + step) % n]
            take = min(left[arc], room[shard])
            if take:
                given[arc].append((rank, take, shard))
                room[shard] -= take
                left[arc] -= take
                rank += take
            step += 1
    return given


def ring_shards(docs: DataFrame, shards: int = 8, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, place (hash), arc, shard, home (the arc's own shard) and slot of each row."""
    text = F.coalesce("text", F.lit(""))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64(text)), 2)
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place"))
    points = ring(shards, vnodes)
    # Arc k ends at point k; places beyond the last point belong to the first.
    total = docs.count()
    bits = min(MAX_CELL_BITS, max(4, (total // CELL_ROWS).bit_length()))
    cell = F.shiftright("place", 62 - bits)
    # A cell may lie in several arcs; the pair is what is ordered and counted.
    arc = _arc(F.col("place"), [p for p, _ in points])
    rows = rows.withColumn("cell", cell).withColumn("arc", arc)
    inside = Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("in_cell", F.row_number().over(inside) - 1)
    cells = rows.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    by_arc = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row an arc
    owners = [s for _, s in points]
    given = fill([by_arc.get(a, 0) for a in range(len(points))], owners, bounds(total, shards))
    # Slots follow the order of arcs and ranks inside a shard.
    used, plan = [0] * shards, []
    for a, parts in enumerate(given):
        for first, n, s in parts:
            plan.append((a, first, first + n, s, used[s] - first, owners[a]))
            used[s] += n
    spark = docs.sparkSession
    parts = spark.createDataFrame(plan or [(0, 0, 0, 0, 0, 0)], "arc int, first long, last long, shard int, shift long, home int")
    # A 12-bit head first, so that no window holds an arc's cells beyond those of one head.
    offsets = cells.withColumn("head", F.shiftright("cell", max(0, bits - 12)))
    heads = offsets.groupBy("arc", "head").agg(F.sum("n").alias("n")).select("arc", "head", F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head_at"))
    in_head = Window.partitionBy("arc", "head").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.join(heads, ["arc", "head"]).select("arc", "cell", (F.col("head_at") + F.coalesce(F.sum("n").over(in_head), F.lit(0))).alias("cell_at"))
    out = ranked.join(offsets, ["arc", "cell"]).withColumn("rank", F.col("cell_at") + F.col("in_cell"))
    # At most two parts for most arcs; arcs and shards bound the plan, so it is small whatever the input.
    out = out.join(F.broadcast(parts), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return out.select("doc_id", "size", "text_crc32", "place", "arc", "shard", "home", (F.col("rank") + F.col("shift")).alias("slot"))


def _arc(place: Column, points: list[int]) -> Column:
    """Number of the first point at or after the place: found by halving."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo % len(points)).cast("int")
        mid = (lo + hi) // 2
        return F.when(place <= F.lit(points[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(points))


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = ring_shards(docs, shards=8, vnodes=64)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home", "arc")
