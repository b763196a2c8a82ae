"""Operator 12: near duplicates by SimHash, found by deletion-variant signatures.

A document's fingerprint has a bit for each bit that more than half of its shingle
hashes (XXH64) have. Fingerprints that differ by three bits or fewer are linked.
Equal fingerprints are one class. A fingerprint is cut into two segments of 32 bits;
of two linked ones one segment differs by one bit at most. Each segment is indexed
whole and with each of its bits deleted (a wildcard), and classes meet by equality of
these signatures. A wildcard signature counts only where both values of the deleted
bit are met, as equal segments meet by the whole one.

Signatures are counted first, with map-side combining, and only shared ones are
joined with their classes. Those of up to ``MID`` classes are verified in a task, on
whole fingerprints. The classes of a larger one are not gathered: the other segment is
cut again, into halves with one wildcard each, so that at most 18 bits are left open
and a group has at most 2**18 classes; groups above ``MID`` look up all flips of three
bits or fewer among these. A group's links are given as a tree, so their number grows
with its members, not with its pairs; components are walked through by Spark.

Null and empty texts and texts without words have the fingerprint zero, which is
linked like any other; texts of fewer words than a shingle are one shingle; very long
texts are hashed block by block; repeated rows are rows of the result; rows without
doc_id are linked too, but give no component its number (null where there is no
other); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import LOWER, SPACE, U64, eights, pieces, ranges, text_bytes, word_bounds
from .path_join import by_nodes, components
from .store import written

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.full(1, p, U64) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
LONG = 4096  # bytes of a range; longer ones are hashed one by one
BLOCK = 1 << 17  # shingles hashed at a time
SMALL, MID = 32, 1024  # members of a signature: pairs are listed, compared in a task
ROWS = 1 << 15
ONES = U64(0x0101010101010101)
SEGMENT = "(shiftrightunsigned(fp, cast(k div 33 * 32 as int)) & 4294967295L)"


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(h + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each range of bytes."""
    n = ends - starts
    whole, start = eights(data), np.full(1, seed, U64)
    stripes = np.where(n <= LONG, n // 32, 0)
    h = np.repeat(start + P5, len(n))
    wide = np.flatnonzero(stripes)
    if wide.size:
        v = np.repeat(np.stack((start + P1 + P2, start + P2, start, start - P1), axis=1), len(wide), axis=0)
        for step in range(int(stripes.max())):
            live = np.flatnonzero(stripes[wide] > step)
            at = starts[wide[live]] + 32 * step
            v[live] = _round(v[live], whole[at[:, None] + np.arange(0, 32, 8)])
        total = _rotated(v[:, 0], 1) + _rotated(v[:, 1], 7) + _rotated(v[:, 2], 12) + _rotated(v[:, 3], 18)
        for lane in range(4):
            total = (total ^ _round(np.zeros(len(wide), U64), v[:, lane])) * P1 + P4
        h[wide] = total
    h += n.astype(U64)
    at, left = starts + 32 * stripes, n - 32 * stripes
    for step in range(3):
        live = np.flatnonzero((left >= 8 * (step + 1)) & (n <= LONG))
        h[live] = _rotated(h[live] ^ _round(np.zeros(len(live), U64), whole[at[live] + 8 * step]), 27) * P1 + P4
    at, left = at + left // 8 * 8, left % 8
    live = np.flatnonzero(left >= 4)
    h[live] = _rotated(h[live] ^ (whole[at[live]] & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at, left = at + left // 4 * 4, left % 4
    for step in range(3):
        live = np.flatnonzero(left > step)
        h[live] = _rotated(h[live] ^ (whole[at[live] + step] & U64(0xFF)) * P5, 11) * P1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    h ^= h >> U64(32)
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many hashes of each group (bounds ``at``) have each bit: eight bits at a time, as bytes of up to 255 hashes."""
    n = np.diff(at)
    out = np.zeros((len(n), 64), np.int64)
    some = np.flatnonzero(n)
    if some.size:
        blocks = -(-n[some] // 255)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(at[:-1][some], blocks) + 255 * ranges(np.zeros(len(some), np.int64), blocks)
        each = np.empty((len(starts), 64), np.uint8)
        for k in range(8):
            each[:, k::8] = np.add.reduceat((h >> U64(k)) & ONES, starts).view(np.uint8).reshape(-1, 8)
        out[some] = np.add.reduceat(each, first, axis=0, dtype=np.int64)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of each text."""
    data = LOWER[data]
    starts, ends, at = word_bounds(data, offsets)
    before = starts - np.append(0, ends[:-1])[: len(starts)]
    # Words one space apart: shingles are ranges of these bytes.
    keep = ~SPACE[data]
    spaced = starts[before > 0] - 1
    keep[spaced], data[spaced] = True, 0x20
    size = ends - starts
    begins = np.cumsum(np.minimum(before, 1) + size) - size
    data, finish = data[keep], begins + size
    m = np.diff(at)
    n = np.where(m >= words, m - words + 1, np.minimum(m, 1))
    bounds = np.append(0, np.cumsum(n))
    first = ranges(at[:-1], n)
    last = first + np.minimum(np.repeat(m, n), words) - 1
    h = np.empty(len(first), U64)
    for i in range(0, len(first), BLOCK):
        part = slice(i, i + BLOCK)
        h[part] = xxh64(data, begins[first[part]], finish[last[part]])
    ones = 2 * bit_counts(h, bounds) > n[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]


def simhashes(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (its 64 bits as a long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in pieces(offsets):
                fp = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def signatures(prints: DataFrame) -> DataFrame:
    """node, fp, and the bit that the node leaves open (null: none): 33 nodes a segment."""
    every = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k"))
    bit = F.expr(f"case when k % 33 < 32 then {SEGMENT} & shiftleft(1L, k % 33) end")
    node = F.expr(f"shiftleft(cast(k as long), 32) | ({SEGMENT} & ~case when k % 33 < 32 then shiftleft(1L, k % 33) else 0L end)")
    return every.select(node.alias("node"), "fp", (bit > 0).alias("bit"))


def shared(rows: DataFrame) -> DataFrame:
    """node, fp and n of nodes with several members, and both values of their open bit if they have one.

    The join is hinted: Spark takes rows for as few as there were before they were exploded, and would send them all through the driver.
    """
    some = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("bit").alias("low"), F.max("bit").alias("high")).where("n > 1 and (low is null or low <> high)")
    return rows.select("node", "fp").join(some.select("node", "n").hint("merge"), "node")


def halves(large: DataFrame) -> DataFrame:
    """The members of large nodes by halves of their other segment, one bit of a half left open."""
    other = "shiftrightunsigned(fp, cast(32 - shiftrightunsigned(node, 32) div 33 * 32 as int))"
    every = large.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("q"))
    rest = F.expr(f"shiftrightunsigned({other}, cast(q div 16 * 16 as int)) & 65535L & ~shiftleft(1L, q % 16)")
    return every.select(F.expr("shiftleft(node, 21)").bitwiseOR(F.shiftleft(F.col("q").cast("long"), 16)).bitwiseOR(rest).alias("node"), "fp", F.lit(None).cast("boolean").alias("bit"))


def roots_of(fp: np.ndarray, bits: int) -> np.ndarray:
    """For each of some fingerprints the first that links reach from it."""
    m = len(fp)
    if m <= MID:
        linked = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits
        step = lambda label: np.where(linked, label[None, :], m).min(1)
    else:
        differ = np.bitwise_or.reduce(fp ^ fp[0])
        open_bits = [b for b in range(64) if int(differ) >> b & 1]
        code = sum(((fp >> U64(b)) & U64(1)).astype(np.int64) << i for i, b in enumerate(open_bits))
        table = np.full(1 << len(open_bits), -1, np.int64)
        table[code] = np.arange(m)
        flips = [sum(1 << i for i in c) for k in range(1, bits + 1) for c in combinations(range(len(open_bits)), k)]

        def step(label: np.ndarray) -> np.ndarray:
            low = label.copy()
            for flip in flips:
                there = table[code ^ flip]
                low = np.minimum(low, np.where(there >= 0, label[there], m))
            return low

    label = np.arange(m)
    while True:
        low = step(label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def trees(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that join what each node's members link, from rows node, fp; no node has more than 2**18 members or,
    above MID of them, 18 bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_nodes(batches, ROWS):
            node, fp = t["node"].to_numpy(), t["fp"].to_numpy().view(U64)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(first, len(node)))
            small = np.repeat(size <= SMALL, size)
            behind = np.where(small, np.repeat(first + size, size) - np.arange(len(node)) - 1, 0)
            a, b = np.repeat(np.arange(len(node)), behind), ranges(np.arange(len(node)) + 1, behind)
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
            found = [np.stack((fp[a[ok]], fp[b[ok]]))]
            for i, m in zip(first[size > SMALL], size[size > SMALL]):
                own = fp[i : i + m]
                root = roots_of(own, bits)
                far = np.flatnonzero(root != np.arange(m))
                found.append(np.stack((own[root[far]], own[far])))
            ends = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return rows.select("node", "fp").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct()


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints, as many as their components need at least."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments find up to three bits")
    met = written(shared(signatures(prints)), "signatures")
    found = trees(met.where(F.col("n") <= MID), bits)
    large = met.where(F.col("n") > MID)
    if large.limit(1).count():
        found = found.unionByName(trees(shared(halves(large)), bits))
    return found


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id and kept of every row."""
    prints = written(simhashes(docs, words), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(written(links(classes.select("fp"), bits), "links")).select(F.col("doc_id").alias("fp"), F.col("component_id").alias("root"))
    of_root = labels.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that its join with all rows is one of two plain shuffles, whose hot fingerprints Spark can split.
    of_class = written(classes.join(labels.join(of_root, "root"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "of_class")
    out = prints.join(of_class, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
