"""Windows that also start in a document with a smaller id, found without a hot key.

A text is a sequence of symbols (bytes, or words each followed by one blank). Each
window of ``window`` symbols has an anchor: the least hash of its ``gram``-grams.
Equal windows have equal anchors, and neighbouring windows mostly share theirs, so
a document is a list of short runs of windows, each with one anchor. Two rounds,
each dealt out by hash in packed arrays, decide every window:

1. anchors: which of them do two documents have. A group of documents sends each of
   its anchors once, with the number of its documents that have it.
2. strings: the text of the runs of those anchors goes to the shard of the anchor,
   each different string of a group once, for its smallest document. Anchors of
   more than ``HOT`` documents are taken apart into single windows, dealt out by
   their own hash, so no shard grows with the number of documents that share a
   passage. A shard compares the strings themselves: equal ones count for their
   smallest document; of anchors with several strings all windows are compared by
   the operator's own method (``windows``), which sees every string of the shard.

Hashes only say where strings meet; what is equal is decided by the strings.
Answers go back to the groups, which keep where each string stands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import U64, grams, mix, ranges, sliding_min, text_bytes, wider, word_bounds, word_hashes
from .store import text_size

STEP = 1 << 19  # window starts looked at together
HOT = 512  # documents; beyond that an anchor's windows are dealt out one by one
SINGLE = 1 << 16  # such windows looked at together
SHARD = 1 << 20  # bytes of strings that a shard compares by window at a time, and what is left of the last anchor
PACK = "bucket long, grp long, kind int, payload binary, texts binary"
STRING = np.dtype([("sid", "<u4"), ("anchor", "<u4"), ("doc", "<i8"), ("size", "<u4")])
PLACE = np.dtype([("begin", "<u4"), ("length", "<u4"), ("sid", "<u4")])
SHARED, HOTTER, OWN, SENT, WHOLE, PART = range(6)  # kinds of packed rows


@dataclass(frozen=True)
class Plan:
    """unit: bytes or words. groups and buckets grow with the input."""

    unit: str
    window: int
    gram: int
    groups: int
    buckets: int
    hot: int = HOT


def plan_for(docs: DataFrame, unit: str, window: int, gram: int, group_mb: int = 4, bucket_mb: int = 16, hot: int = HOT) -> Plan:
    size = text_size(docs)
    return Plan(unit, window, gram, max(1, size // (group_mb << 20)), max(4, size // (bucket_mb << 20)), hot)


def grouped(docs: DataFrame, plan: Plan) -> DataFrame:
    """Rows with a doc_id, and the group that each belongs to (by id and text, so one repeated id is no hot group)."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.groups)).alias("grp")).where("doc_id is not null")


class Group:
    """The documents of a group by id, as symbols. ``pos``: where each symbol begins in ``data``; ``at``: each document's first symbol."""

    def __init__(self, table: pa.Table, plan: Plan):
        table = table.select(["doc_id", "text"]).sort_by("doc_id").combine_chunks()
        self.plan = plan
        self.ids = table["doc_id"].to_numpy()
        self.data, self.at = text_bytes(table["text"])
        if plan.unit == "words":
            starts, ends, self.at = word_bounds(self.data, self.at)
            n = ends - starts
            self.pos = np.append(0, np.cumsum(n + 1))
            joined = np.full(self.pos[-1], 0x20, np.uint8)
            joined[ranges(self.pos[:-1], n)] = self.data[ranges(starts, n)]
            self.data, self.symbols = joined, word_hashes(joined, self.pos[:-1], self.pos[:-1] + n)
        else:
            self.pos, self.symbols = None, self.data
        self.n = int(self.at[-1]) if len(self.at) else 0

    def runs(self):
        """Chunks (hashes of grams, first symbol, anchors, first window, windows, row) of runs of windows with one anchor."""
        w = self.plan.window
        starts = np.flatnonzero(np.diff(self.at) >= w)
        # Spans of window starts of documents next to each other, cut at STEP.
        lo, hi = self.at[starts], self.at[starts + 1] - w + 1
        first = 0
        while first < len(starts):
            a = int(lo[first])
            last = max(first, int(np.searchsorted(hi, a + STEP, "right")) - 1)
            b = min(int(hi[last]), a + STEP)
            yield self._runs(a, b)
            if b < hi[last]:
                lo[last] = b
                first = last
            else:
                first = last + 1

    def _runs(self, a: int, b: int):
        w, k = self.plan.window, self.plan.gram
        hashes = grams(self.symbols[a : b + w - 1], k)
        least = sliding_min(hashes, w - k + 1)
        edge = np.append(True, least[1:] != least[:-1])
        edge[self.at[(self.at > a) & (self.at < b)] - a] = True
        end = self.at[1:] - a - w + 1  # no window starts at or after that in a document
        edge[end[(end > 0) & (end < b - a)]] = True
        begin = np.flatnonzero(edge)
        length = np.diff(np.append(begin, b - a))
        row = np.searchsorted(self.at, begin + a, "right") - 1
        good = begin + a + w <= self.at[row + 1]
        begin, length, row = begin[good], length[good], row[good]
        return hashes, a, mix(least[begin]), begin, length, row

    def strings(self, begin: np.ndarray, length: np.ndarray) -> pa.Array:
        """Text of runs of windows (first symbol, windows)."""
        end = begin + length + self.plan.window - 1
        if self.pos is not None:
            begin, end = self.pos[begin], self.pos[end]
        return binaries(self.data[ranges(begin, end - begin)], end - begin)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def joined(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of an array of strings."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosened(small: bytes) -> bytes:
    return pa.decompress(memoryview(small)[8:], int.from_bytes(small[:8], "little"), codec="zstd", asbytes=True)


def by_column(records: np.ndarray) -> bytes:
    """Records a column after the other; ``begin`` and ``doc`` as differences, which are small."""
    return squeezed(b"".join(np.diff(x, prepend=x.dtype.type(0)).tobytes() if name in ("begin", "doc") else x.tobytes() for name in records.dtype.names for x in (np.ascontiguousarray(records[name]),)))


def from_columns(small: bytes, kind: np.dtype) -> np.ndarray:
    raw = loosened(small)
    out, at = np.zeros(len(raw) // kind.itemsize, kind), 0
    for name in kind.names:
        x = np.frombuffer(raw, kind[name], len(out), at)
        out[name] = np.cumsum(x, dtype=x.dtype) if name in ("begin", "doc") else x
        at += x.nbytes
    return out


class Rows:
    """Packed rows of one table."""

    def __init__(self):
        self.rows: dict[str, list] = {"bucket": [], "grp": [], "kind": [], "payload": [], "texts": []}

    def add(self, bucket: int, group: int, kind: int, payload: bytes, texts: bytes | None = None) -> None:
        for name, x in zip(self.rows, (int(bucket), int(group), kind, payload, texts)):
            self.rows[name].append(x)

    def table(self) -> pa.Table:
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(self.rows.items(), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))})


def parts(keys: np.ndarray):
    """Order of the keys, and (key, first, last) of each one's stretch."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order, list(zip(keys[bounds].tolist(), bounds.tolist(), np.append(bounds[1:], len(keys)).tolist()))


def least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the least and the largest value among those with its key."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    bounds = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(bounds, len(keys)))
    low, high = np.empty(len(keys), values.dtype), np.empty(len(keys), values.dtype)
    if len(keys):
        v = values[order]
        low[order] = np.repeat(np.minimum.reduceat(v, bounds), counts)
        high[order] = np.repeat(np.maximum.reduceat(v, bounds), counts)
    return low, high


def _key(key: tuple) -> int:
    return key[0].as_py()


def _bucket(keys: np.ndarray, plan: Plan) -> np.ndarray:
    return (keys % U64(plan.buckets)).astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(32)).astype(np.uint32)


def anchors(plan: Plan):
    """The group's anchors by bucket, each with the number of its documents (255 at most)."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        group, out = Group(t, plan), Rows()
        found, ids = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, _, anchor, _, _, row in group.runs():
            found.append(anchor)
            ids.append(group.ids[row])
        found, ids = np.concatenate(found), np.concatenate(ids)
        order = np.argsort(found, kind="stable")  # documents stay in order
        found, ids = found[order], ids[order]
        fresh = np.append(True, found[1:] != found[:-1])[: len(found)]
        other = fresh | np.append(True, ids[1:] != ids[:-1])[: len(ids)]
        first = np.flatnonzero(fresh)
        counts = np.minimum(np.add.reduceat(other, first), 255).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
        found = found[first]
        order, stretches = parts(_bucket(found, plan))
        short, counts = _short(found)[order], counts[order]
        for bucket, a, b in stretches:
            out.add(bucket, _key(key), SHARED, short[a:b].tobytes(), squeezed(counts[a:b].tobytes()))
        return out.table()

    return run


def shared_anchors(plan: Plan):
    """Of a bucket's anchors, for each group: those of two documents or more, and those of more than ``hot``."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        payloads, groups, out = t["payload"].to_pylist(), t["grp"].to_pylist(), Rows()
        sizes = np.array([len(p) // 4 for p in payloads])
        values = np.concatenate([np.frombuffer(p, np.uint32) for p in payloads])
        counts = np.concatenate([np.frombuffer(loosened(p), np.uint8) for p in t["texts"].to_pylist()])
        _, inverse = np.unique(values, return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        ends = np.cumsum(sizes)
        for group, a, b in zip(groups, ends - sizes, ends):
            own, n = values[a:b], total[a:b]
            for kind, mask in ((SHARED, (n >= 2) & (n <= plan.hot)), (HOTTER, n > plan.hot)):
                if mask.any():
                    out.add(_key(key), group, kind, own[mask].tobytes())
        return out.table()

    return run


def _known(t: pa.Table, kind: int) -> np.ndarray:
    t = t.filter(pc.equal(t["kind"], kind))
    keys = [np.frombuffer(p, np.uint32).astype(U64) | (U64(b) << U64(32)) for b, p in zip(t["bucket"].to_pylist(), t["payload"].to_pylist())]
    return np.sort(np.concatenate([np.zeros(0, U64), *keys]))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def sent_strings(plan: Plan):
    """Each different string of the group's runs, once, to the shard of its anchor, and where they stand to the group itself."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        out = Rows()
        if not t.num_rows or not answers.num_rows:
            return out.table()
        group, w = Group(t, plan), plan.window
        shared, hot = _known(answers, SHARED), _known(answers, HOTTER)
        texts, begins, lengths, keys = [], [], [], []

        def take(begin: np.ndarray, length: np.ndarray, key_of: np.ndarray) -> None:
            if len(begin):
                texts.append(group.strings(begin, length).dictionary_encode())
                begins.append(begin)
                lengths.append(length)
                keys.append(key_of)

        for hashes, a, anchor, begin, length, _ in group.runs():
            short = _short(anchor).astype(U64) | (_bucket(anchor, plan).astype(U64) << U64(32))
            ok = _among(short, shared)
            take(a + begin[ok], length[ok], anchor[ok])
            ok = _among(short, hot)
            at = ranges(begin[ok], length[ok])
            for i in range(0, len(at), SINGLE):
                own = at[i : i + SINGLE]
                take(a + own, np.ones(len(own), np.int64), mix(wider(hashes, plan.gram, own, w)))
        if not texts:
            return out.table()
        whole = pa.chunked_array(texts).unify_dictionaries()
        distinct = whole.chunk(whole.num_chunks - 1).dictionary
        sid = np.concatenate([c.indices.to_numpy() for c in whole.chunks])
        begin, length, key_of = np.concatenate(begins), np.concatenate(lengths), np.concatenate(keys)
        row = np.searchsorted(group.at, begin, "right") - 1
        # Places in order, so that a string's first one is of its smallest document.
        order = np.argsort(begin, kind="stable")
        begin, length, key_of, row, sid = begin[order], length[order], key_of[order], row[order], sid[order]
        first = np.unique(sid, return_index=True)[1]
        place = np.zeros(len(begin), PLACE)
        place["begin"], place["length"], place["sid"] = begin, length, sid
        out.add(_key(key) % plan.buckets, _key(key), OWN, by_column(place))
        data, sizes = joined(distinct)
        said = np.zeros(len(first), STRING)
        said["sid"], said["anchor"], said["doc"], said["size"] = np.arange(len(first)), _short(key_of[first]), group.ids[row[first]], sizes
        order, stretches = parts(_bucket(key_of[first], plan))
        start = np.cumsum(sizes) - sizes
        for bucket, a, b in stretches:
            own = order[a:b]
            out.add(bucket, _key(key), SENT, by_column(said[own]), squeezed(data[ranges(start[own], sizes[own])].tobytes()))
        return out.table()

    return run


Windows = Callable[[Plan, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def settled_strings(plan: Plan, windows: Windows):
    """A shard's answers. ``windows(plan, data, sizes, docs)`` gets strings and their smallest documents, and returns
    (string, first symbol, symbols) of what is covered by a window of a smaller document's string."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        passed = t.filter(pc.equal(t["kind"], OWN))
        t, out = t.filter(pc.equal(t["kind"], SENT)), Rows()
        if t.num_rows:
            said = [from_columns(p, STRING) for p in t["payload"].to_pylist()]
            group = np.repeat(t["grp"].to_numpy(), [len(x) for x in said])
            said = np.concatenate(said)
            strings = binaries(np.frombuffer(b"".join(map(loosened, t["texts"].to_pylist())), np.uint8), said["size"].astype(np.int64)).dictionary_encode()
            string = strings.indices.to_numpy()
            doc = said["doc"]
            low, _ = least_by(string, doc)
            later = doc > low
            a_low, a_high = least_by(said["anchor"], string)
            several = a_low < a_high
            # Strings whose anchor has another one go to the operator's method, once each, some anchors at a time.
            chosen, at = np.unique(string[several], return_index=True)
            anchor, docs = said["anchor"][several][at], low[several][at]
            order = np.argsort(anchor, kind="stable")
            anchor, chosen, docs = anchor[order], chosen[order], docs[order]
            reach = np.cumsum(said["size"][several][at][order].astype(np.int64))
            first, found = 0, [(np.zeros(0, np.int64),) * 3]
            while first < len(chosen):
                last = int(np.searchsorted(reach, (reach[first - 1] if first else 0) + SHARD))
                last = int(np.searchsorted(anchor, anchor[min(last, len(anchor) - 1)], "right"))
                data, sizes = joined(strings.dictionary.take(pa.array(chosen[first:last])))
                own, *spans = windows(plan, data, sizes, docs[first:last])
                found.append((chosen[first:last][own], *spans))
                first = last
            which, begin, length = (np.concatenate([f[i] for f in found]) for i in range(3))
            for g, a, b in (p := parts(group))[1]:
                own = p[0][a:b]
                if (m := later[own]).any():
                    out.add(-1, g, WHOLE, said["sid"][own[m]].tobytes())
            # What is covered goes to the entries of each string's smallest document.
            entry = np.flatnonzero(several & ~later)
            entry = entry[np.argsort(string[entry], kind="stable")]
            order = np.argsort(which, kind="stable")
            which, begin, length = which[order], begin[order], length[order]
            lo, hi = np.searchsorted(which, string[entry]), np.searchsorted(which, string[entry], "right")
            entry, at = np.repeat(entry, hi - lo), ranges(lo, hi - lo)
            cover = np.zeros(len(at), PLACE)
            cover["begin"], cover["length"], cover["sid"] = begin[at], length[at], said["sid"][entry]
            for g, a, b in (p := parts(group[entry]))[1]:
                out.add(-1, g, PART, by_column(cover[p[0][a:b]]))
        return pa.concat_tables([passed.cast(out.table().schema), out.table()])

    return run


def covered_symbols(group: Group, answers: pa.Table) -> np.ndarray:
    """Mask of the group's symbols that a window of a smaller document covers."""

    def of(kind: int, dtype: np.dtype, read: Callable = from_columns) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype), *[read(p, dtype) for p in answers.filter(pc.equal(answers["kind"], kind))["payload"].to_pylist()]])

    place, delta = of(OWN, PLACE), np.zeros(group.n + 1, np.int32)
    if not len(place):
        return np.zeros(group.n, bool)
    begin, sid = place["begin"].astype(np.int64), place["sid"].astype(np.int64)
    reach = place["length"].astype(np.int64) + group.plan.window - 1
    doc = group.ids[np.searchsorted(group.at, begin, "right") - 1]
    least = doc[np.unique(sid, return_index=True)[1]]  # of each string, in this group
    whole = np.zeros(len(least), bool)
    whole[of(WHOLE, np.dtype(np.uint32), np.frombuffer)] = True
    gone = whole[sid] | (doc > least[sid])
    np.add.at(delta, begin[gone], 1)
    np.add.at(delta, begin[gone] + reach[gone], -1)
    part = of(PART, PLACE)
    if len(part):
        part = part[np.argsort(part["sid"], kind="stable")]
        left = np.flatnonzero(~gone)
        lo, hi = (np.searchsorted(part["sid"], sid[left], side) for side in ("left", "right"))
        at = ranges(lo, hi - lo)
        first = np.repeat(begin[left], hi - lo) + part["begin"][at]
        np.add.at(delta, first, 1)
        np.add.at(delta, first + part["length"][at], -1)
    return np.cumsum(delta[:-1]) > 0


def removals(docs: DataFrame, plan: Plan, windows: Windows, finish: Callable, schema: str) -> DataFrame:
    """``finish(group, mask)`` makes a table with ``schema`` from each group of documents and the mask of its repeated symbols."""
    by_group = grouped(docs, plan).groupBy("grp")
    asked = by_group.applyInArrow(anchors(plan), PACK)
    shared = asked.groupBy("bucket").applyInArrow(shared_anchors(plan), PACK)
    strings = by_group.cogroup(shared.groupBy("grp")).applyInArrow(sent_strings(plan), PACK)
    answers = strings.groupBy("bucket").applyInArrow(settled_strings(plan, windows), PACK)

    def last(key: tuple[pa.Scalar, ...], t: pa.Table, said: pa.Table) -> pa.Table:
        group = Group(t, plan)
        return finish(group, covered_symbols(group, said))

    return by_group.cogroup(answers.groupBy("grp")).applyInArrow(last, schema)
