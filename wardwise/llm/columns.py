"""Numpy views of Arrow text columns, word bounds and hashes of words and windows.

Hashes are chains of a 64-bit mixer over eight bytes, or over two halves of a
window, at a time: no sum of powers, for which there are texts that collide.

Everything here works on one Arrow batch inside a task; Spark does the reading,
grouping and shuffling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps that many bytes of eight.
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_LONG = 64  # bytes; the few longer words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix), a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in a row."""
    x = (left ^ (left >> U64(32))) * U64(0xD6E8FEB86659FD93) + right
    x = (x ^ (x >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each position on, zeros beyond the end."""
    return np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive symbols: bytes, or words as hashes."""
    m = len(symbols) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    if symbols.dtype == np.uint8:
        span = min(k, 8)
        h = eights(symbols)[: len(symbols) - span + 1] & KEEP[span]
        h = _joined(h, U64(span))
    else:
        h, span = symbols, 1
    while span * 2 <= k:
        h = _joined(h[:-span], h[span:])
        span *= 2
    return _joined(h[:m], h[k - span :]) if span < k else h


def wider(hashes: np.ndarray, k: int, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` symbols from each position on, from the hashes of ``k`` consecutive ones."""
    h = hashes[at]
    for step in [*range(k, width - k, k), width - k]:
        h = _joined(h, hashes[at + step])
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and where each begins (n + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (first, last) of rows with about ``most`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of other bytes than white space, never across texts), and each text's first word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    whole, n = eights(data), ends - starts
    h = mix(n.astype(U64))
    live = np.arange(len(n))
    for step in range(0, _LONG, 8):
        live = live[n[live] > step] if step else live
        if not live.size:
            break
        part = whole[starts[live] + step] & KEEP[np.minimum(n[live] - step, 8)]
        h[live] = mix(h[live] ^ part * U64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    span, low = 1, x
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = w - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``starts``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)
