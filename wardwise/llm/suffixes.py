"""Suffix arrays of a shard's text by induced sorting, and permuted common prefixes, in numpy.

Each pass over the bytes handles all suffixes that begin with one byte together, so an
induction is some numpy calls a byte value and run length, and linear in the text. The
string of substring names, a third as long or less, has too many symbols for that; it is
sorted by the same recursion, whose inductions walk over compact arrays.
"""

from __future__ import annotations

from array import array

import numpy as np

from .columns import eights


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last is larger than the empty one."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.zeros(len(change) + 1, bool)  # by run of equal bytes; the last run falls to the end
    rises[:-1] = text[change + 1] > text[change]
    lengths = np.diff(np.concatenate(([-1], change, [n - 1])))
    return np.repeat(rises, lengths)


def _deal(pending: list[list[np.ndarray]], at: np.ndarray, text: np.ndarray) -> None:
    """Append positions, in their order, to the list of the byte that stands there."""
    if not at.size:
        return
    keys = text[at]
    order = np.argsort(keys, kind="stable")
    at, counts = at[order], np.bincount(keys, minlength=256)
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts):
        pending[c].append(at[ends[c] - counts[c] : ends[c]])


def _levels(text: np.ndarray, kind: np.ndarray, want: bool, start: list[np.ndarray], c: int) -> list[np.ndarray]:
    """A bucket's suffixes of one type: those given, then the ones before them with the same byte, and so on."""
    out, now = [], np.concatenate(start) if start else np.zeros(0, np.int64)
    while now.size:
        out.append(now)
        before = now[now > 0] - 1
        now = before[(text[before] == c) & (kind[before] == want)]
    return out


def _induce(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S ones in order."""
    none = np.zeros(0, np.int64)
    keys = text[lms]
    order = np.argsort(keys, kind="stable")
    lms, bounds = lms[order], np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=256))))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[-1]].append(np.array([len(text) - 1]))
    large: list[np.ndarray] = []
    for c in range(256):
        parts = _levels(text, kind, False, pending[c], c)
        own = np.concatenate(parts) if parts else none
        large.append(own)
        source = np.concatenate((own, lms[bounds[c] : bounds[c + 1]]))
        before = source[source > 0] - 1
        _deal(pending, before[~kind[before] & (text[before] > c)], text)
    pending = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        parts = _levels(text, kind, True, pending[c], c)
        small = np.concatenate(parts) if parts else none
        source = np.concatenate((small, large[c][::-1]))
        before = source[source > 0] - 1
        _deal(pending, before[kind[before] & (text[before] < c)], text)
        out.append(source)
    return np.concatenate(out)[::-1]


def _names(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Rank of each leftmost S substring (up to the next one's first symbol), equal ones sharing it, by symbol after symbol.

    With their types as well no substring begins another one. The last one meets the end of the text and is smaller
    than those that it begins.
    """
    ends = np.append(lms[1:] + 1, len(text))
    symbols = text.astype(np.int64) * 2 + kind
    name, live, step = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while live.size:
        at = lms[live] + step
        inside = at < ends[live]
        key = name[live] * (2 * int(text.max()) + 3) + np.where(inside, symbols[np.minimum(at, len(text) - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(live)))
        # A name is the number of substrings that are smaller: those of its old name keep their places.
        old = np.flatnonzero(np.append(True, name[live][1:] != name[live][:-1]))
        name[live] += np.repeat(first, count) - np.repeat(old, np.diff(np.append(old, len(live))))
        live = live[np.repeat(count > 1, count) & (lms[live] + step + 1 < ends[live])]
        step += 1
    return np.unique(name, return_inverse=True)[1]


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffixes in order of a string of numbers whose last is 0 and the only 0: classify, sort and name the
    leftmost S substrings, sort the string of these names by the same function, and induce."""
    n = len(names)
    kind = suffix_types(names)
    kind[-1] = True
    sizes = np.bincount(names)
    ends = np.cumsum(sizes)
    # Compact arrays: lists of number objects would miss the processor's caches.
    s, small, last_of, first_of = (array("i", x.astype(np.int32).tobytes()) for x in (names, kind, ends, ends - sizes))
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1

    def induced(order: np.ndarray) -> np.ndarray:
        rank = names[order]  # each bucket's own ones go to its end, in their order
        by = np.argsort(rank, kind="stable")
        bucket = rank[by]
        counts = np.bincount(bucket, minlength=len(sizes))
        start = np.zeros(n, np.int32)
        start[ends[bucket] - np.cumsum(counts)[bucket] + np.arange(len(by))] = order[by]
        out, at = array("i", start.tobytes()), first_of[:]
        for i in out:  # grows ahead of the loop
            if i:
                i -= 1
                if not small[i]:
                    c = s[i]
                    k = at[c]
                    out[k] = i
                    at[c] = k + 1
        at = last_of[:]
        for i in reversed(out):
            if i:
                i -= 1
                if small[i]:
                    c = s[i]
                    at[c] = k = at[c] - 1
                    out[k] = i
        return np.frombuffer(out, np.int32).astype(np.int64)

    name = _names(names, kind, lms)
    order = _sorted_names(np.append(name + 1, 0))[1:] if name.max() + 1 < len(lms) else np.argsort(name)
    return induced(lms[order])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte text in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    kind = suffix_types(text)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if not lms.size:
        return _induce(text, kind, lms)
    name = _names(text, kind, lms)
    order = _sorted_names(np.append(name + 1, 0))[1:] if name.max() + 1 < len(lms) else np.argsort(name)
    return _induce(text, kind, lms[order])


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Permuted: for each position, the bytes its suffix shares with the one before it in the array.

    Only where the byte to the left differs is anything compared; elsewhere the
    value is that of the position to the left less one.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    known = (at > 0) & (before > 0)
    known[known] = text[at[known] - 1] == text[before[known] - 1]
    todo = np.flatnonzero(~known & (before >= 0))
    word = eights(text)
    shared = np.zeros(n, np.int64)
    a, b, live = todo.copy(), before[todo], todo
    while live.size:
        differ = word[a] ^ word[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        room = n - np.maximum(a, b)
        shared[live] += np.minimum(same, room)
        more = (same == 8) & (room > 8)
        live, a, b = live[more], a[more] + 8, b[more] + 8
    reach = np.where(known, 0, at + shared)
    return np.maximum(np.maximum.accumulate(reach) - at, 0)
