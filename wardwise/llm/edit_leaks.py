"""Operator 1: documents that hold a benchmark item, up to some edits.

Texts are compared in lower case, with every run of other characters than letters
and digits as one blank. An item of n characters may differ from the passage in
``rate`` * n edits. Cut into one piece more than that, at least one piece is
unharmed, so an automaton over all pieces finds every candidate in one pass over
a document, and Myers' bit-parallel algorithm gives the distance of the passage
around a hit. The benchmark is read in blocks of bounded size, each with its own
automaton and its own pass over all documents.

Null and empty texts and items match nothing; items of the same text are found
each; rows that share a doc_id share the result; rows without doc_id are left out;
with an empty benchmark nothing is found; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_size

BLOCK = 4 << 20  # bytes of items that are looked for together
_between = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _between.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets."""
    n, k = len(item), budget + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, masks: dict[str, int], passage: str, budget: int) -> int:
    """Least edit distance of the item to any part of the passage, or budget + 1."""
    m = len(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    up, down, score, best = full, 0, m, m
    for c in passage:
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(across | up) & full
        fall = up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        rise, fall = rise << 1 & full, fall << 1 & full
        eq |= down
        up, down = fall | ~(eq | rise) & full, rise & eq
    return min(best, budget + 1)


class Finder:
    """The pieces of a block of items in an automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            budget, masks = int(rate * len(text)), {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            for at, piece in pieces(text, budget):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, budget, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """Items in a text with their least distances."""
        text = plain(text)
        if not self.items or not text:
            return []
        best: dict[int, int] = {}
        seen: dict[int, tuple[int, int]] = {}  # of each item, the passage that was looked at last
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                if best.get(k) == 0:
                    continue
                _, item, budget, masks = self.items[k]
                first = end + 1 - n - at - budget
                last = first + len(item) + 2 * budget
                low, high = seen.get(k, (0, -1))
                if low <= first and last <= high:
                    continue
                seen[k] = (first, last + budget)
                distance = myers(item, masks, text[max(0, first) : last + budget], budget)
                if distance <= budget:
                    best[k] = min(distance, best.get(k, distance))
        return [(self.items[k][0], d) for k, d in best.items()]


def _blocks(benchmark: DataFrame):
    """Broadcast blocks of items, each of about ``BLOCK`` bytes."""
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    blocks = text_size(items) // BLOCK + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.where(block == b).collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """doc_id, item_id and least distance of each item found in a document."""
    out = None
    for own in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            finder = Finder(own.value, rate)
            for batch in batches:
                rows = [(d, i, n) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for i, n in finder.find(text.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

        hits = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance int")
        out = hits if out is None else out.unionByName(hits)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    for own in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            finder = Finder(own.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(text.as_py()) for text in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Each document, the items found in it and the least distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("distance"))
    out = docs.where("doc_id is not null").select("doc_id").join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), "item_ids", F.col("distance").cast("int"))
