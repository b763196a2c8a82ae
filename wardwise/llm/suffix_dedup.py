"""Operator 5: repeated byte strings by suffix arrays.

A shard holds the strings of its anchors (see ``repeats``): those of anchors that
have more than one are laid end to end, their suffixes classified, the
leftmost-smaller substrings sorted by recursion and the whole array induced from
them. Neighbours whose permuted common prefix reaches ``window`` bytes hold the same
string, and a window is removed where the smallest document of its neighbours is
smaller than its own.

Nulls are empty texts; texts shorter than the window and empty tables give no
removals; rows that share a doc_id never count for one another, since neither
is smaller; rows without doc_id are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Group, Plan, least_by, plan_for, removals
from .suffixes import common_prefixes, suffix_array

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeated_strings(plan: Plan, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a shard's strings are covered by windows of smaller documents, read off its suffix array."""
    w = plan.window
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    array = suffix_array(data)
    prefix = common_prefixes(data, array)
    same = np.cumsum(prefix[array] < w)  # suffixes that share their first w bytes
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(data)) + w <= (first + sizes)[owner]  # windows that end within their string
    at = array[inside[array]]
    low, _ = least_by(same[inside[array]], docs[owner[at]])
    hit = np.sort(at[low < docs[owner[at]]])
    return owner[hit], hit - first[owner[hit]], np.full(len(hit), w)


def finish(keep_text: bool):
    def run(group: Group, mask: np.ndarray) -> pa.Table:
        data, at = group.data, group.at
        n = np.diff(at)
        sums = np.concatenate(([0], np.cumsum(mask)))
        rise = mask.copy()
        rise[1:] &= ~mask[:-1]
        inner = at[:-1][at[:-1] < len(mask)]
        rise[inner] |= mask[inner]
        spans = np.concatenate(([0], np.cumsum(rise)))
        kept, digests, raw = ~mask, [], data.tobytes()
        removed = sums[at[1:]] - sums[at[:-1]]
        texts = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            left = raw[a:b] if not removed[i] else data[a:b][kept[a:b]].tobytes()
            digests.append(hashlib.sha256(left).hexdigest())
            texts.append(left if keep_text else None)
        return pa.table({"doc_id": pa.array(group.ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans[at[1:]] - spans[at[:-1]], pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(texts, pa.binary())})

    return run


def suffix_dedup(docs: DataFrame, window: int = 50, gram: int = 24, keep_text: bool = True, **settings) -> DataFrame:
    """Each document with the bytes covered by a ``window``-byte string that also starts in a smaller doc_id removed."""
    plan = plan_for(docs, "bytes", window, gram, **settings)
    return removals(docs, plan, repeated_strings, finish(keep_text), SCHEMA)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, keep_text=False).drop("kept")
