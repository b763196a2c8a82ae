"""Operator 10: repeated word passages by relative Lempel-Ziv factors.

A reference block holds the strings of its anchors (see ``repeats``), each with the
smallest document that has it, and an index of their windows of ``window`` words. A
document is factored against every block that it has a string for. The walk looks up
the window at its position; if a smaller document has that, the words themselves are
compared, and the factor grows word by word for as long as both texts go on alike
(the longest match with that place of the block). At a factor's end the windows that
cross its boundary are looked up in turn; where none is known the walk goes on behind
it, word by word, to the next window that is. Factors have ``window`` words at least,
and their words are the duplicate spans.

Nulls are texts without words; short texts and empty tables give no removals;
rows that share a doc_id never count for one another; rows without doc_id are
left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import grams, ranges, word_hashes
from .repeats import Group, Plan, binaries, plan_for, removals

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:long,length:long>>, kept string"


class Block:
    """Strings of words, each word followed by one blank, and an index of their windows."""

    def __init__(self, plan: Plan, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        self.window, w = plan.window, plan.window
        end = np.flatnonzero(data == 0x20)
        start = np.append(0, end + 1)[:-1]
        self.word = binaries(data, end + 1 - start).dictionary_encode().indices.to_numpy()  # equal numbers, equal words
        self.first = np.searchsorted(start, np.append(0, np.cumsum(sizes)))  # each string's first word
        self.docs = docs
        n = np.diff(self.first)
        self.string = np.repeat(np.arange(len(n)), n)
        self.end = self.first[1:][self.string]  # of each word's string
        whole = np.arange(len(self.word)) + w <= self.end
        hashes = np.zeros(len(self.word), np.uint64)
        hashes[: max(0, len(self.word) - w + 1)] = grams(word_hashes(data, start, end), w)
        at = np.flatnonzero(whole)
        # Of equal windows the one of the smallest document is the place to copy from.
        at = at[np.lexsort((docs[self.string[at]], hashes[at]))]
        fresh = np.flatnonzero(np.append(True, hashes[at][1:] != hashes[at][:-1])) if len(at) else at
        self.source = np.full(len(self.word), -1)
        self.source[at] = np.repeat(at[fresh], np.diff(np.append(fresh, len(at))))
        known = at[docs[self.string[self.source[at]]] < docs[self.string[at]]]
        self.source[np.setdiff1d(at, known)] = -1
        self.next = np.full(len(self.word) + 1, len(self.word))  # the next window that a smaller document has
        self.next[known] = known
        self.next = np.minimum.accumulate(self.next[::-1])[::-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the strings at a and b share from there on."""
        n, live, most = np.zeros(len(a), np.int64), np.arange(len(a)), np.minimum(self.end[a] - a, self.end[b] - b)
        while live.size:
            live = live[n[live] < most[live]]
            live = live[self.word[a[live] + n[live]] == self.word[b[live] + n[live]]]
            n[live] += 1
        return n

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, first word in it, words) of each factor, by one greedy walk along each string, all walks side by side."""
        found = []
        at, end = self.first[:-1].copy(), self.first[1:]
        live = np.arange(len(at))
        while live.size:
            at[live] = self.next[at[live]]
            live = live[at[live] + self.window <= end[live]]
            here = at[live]
            n = self.common(here, self.source[here])
            factor = n >= self.window  # else the window only has the same hash
            found.append((live[factor], here[factor] - self.first[live[factor]], n[factor]))
            # First the windows that cross the factor's end; ``next`` then leads on behind it.
            at[live] = np.where(factor, here + n - self.window + 1, here + 1)
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))


def lempel_ziv(plan: Plan, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of a block's strings against the strings of smaller documents."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    return Block(plan, data, sizes, docs).factors()


def spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each maximal stretch of factors; none runs on into the next document."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    before = np.append(False, mask[:-1]) & ~edge[:-1]
    after = np.append(mask[1:], False) & ~edge[1:]
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after)
    return start, end - start + 1


def finish(keep_text: bool):
    def run(group: Group, mask: np.ndarray) -> pa.Table:
        at, sums = group.at, np.concatenate(([0], np.cumsum(mask)))
        removed = sums[at[1:]] - sums[at[:-1]]
        left = np.flatnonzero(~mask)
        n = np.diff(group.pos)[left]
        kept = group.data[ranges(group.pos[left], n)].tobytes()
        kept_at = np.append(0, np.cumsum(n))[np.searchsorted(left, at)].tolist()
        texts = [kept[a : max(a, b - 1)] for a, b in zip(kept_at, kept_at[1:])]  # without the last blank
        found = [None] * len(group.ids)
        if keep_text:
            start, length = spans(mask, at)
            of = np.searchsorted(start, at)
            found = [[{"start": int(s - at[i]), "length": int(k)} for s, k in zip(start[of[i] : of[i + 1]], length[of[i] : of[i + 1]])] for i in range(len(group.ids))]
        return pa.table({"doc_id": pa.array(group.ids, pa.int64()), "n_words": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "factors": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept": pa.array([t.decode() if keep_text else None for t in texts], pa.string())})

    return run


def relative_lz_dedup(docs: DataFrame, window: int = 50, gram: int = 8, keep_text: bool = True, **settings) -> DataFrame:
    """Each document with the words of all factors of ``window`` words or more removed; ``factors`` joins those that touch."""
    plan = plan_for(docs, "words", window, gram, **settings)
    return removals(docs, plan, lempel_ziv, finish(keep_text), SCHEMA)


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return relative_lz_dedup(docs, keep_text=False).drop("kept", "factors")
