"""Operator 7: byte-level BPE by a trie of distinct words.

A batch of texts is split into words, and only words not met before are encoded.
Sorted, they are the leaves of a trie: a word shares with the one before it the
nodes of their common prefix. A node holds one number, the last token of its
prefix's encoding, and that is found from nodes above it: it is the one token
that ends here and that the encoding of the rest can stand before (its last token
and this one would not be merged or split otherwise). The nodes of one depth are
worked out together, each prefix once; a word is read back from its leaf.

Nulls are empty texts, which have no tokens; empty tables give no rows; repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import U64, mix, pieces, ranges, text_bytes
from .repeats import binaries, joined

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
CHUNK = 1 << 20
LONG = 96  # bytes; the few longer words are encoded one by one
KNOWN = 300_000  # words that a worker remembers
#: Hashes of a word's parts come from sums over its bytes; tokens found by them are compared byte by byte.
BYTE = mix(np.arange(1, 257, dtype=U64))
BASE, BACK = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTER, NUMBER, SPACE, OTHER = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White_Space of Unicode (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[WHITE] = SPACE
    return kinds


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return names | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """Numbers by 64-bit key: one slot for most keys, a sorted list for those that share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 19):
        self.shift = U64(64 - bits)
        slot = keys >> self.shift
        self.slots, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int64)
        counts = np.bincount(slot.astype(np.int64), minlength=1 << bits)
        alone = counts[slot.astype(np.int64)] == 1
        self.slots[slot[alone]], self.values[slot[alone]] = keys[alone], values[alone]
        order = np.argsort(keys[~alone])
        self.more, self.more_values = keys[~alone][order], values[~alone][order]
        self.crowded = counts > 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        found = np.where(self.slots[slot] == keys, self.values[slot], -1)
        rest = np.flatnonzero(self.crowded[slot])
        if rest.size:
            at = np.minimum(np.searchsorted(self.more, keys[rest]), len(self.more) - 1)
            found[rest] = np.where(self.more[at] == keys[rest], self.more_values[at], -1)
        return found


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.ones(1, U64), np.full(n - 1, base)))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(U64) << U64(20)) | b.astype(U64)
    return (x + U64(1)) * U64(0x9E3779B97F4A7C15)


class Encoder:
    """Vocabulary tables and the words that this worker has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = byte_names(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        tokens = [b""] * n
        for name, i in vocab.items():
            tokens[i] = bytes(names[c] for c in name)
        for name, i in self.special.items():
            tokens[i] = name
        self.ids = {t: i for i, t in enumerate(tokens) if i not in self.special.values()}
        self.length = np.array([len(t) for t in tokens])
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges]) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges])
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[made], self.right[made] = left, right
        if not (np.diff(made) > 0).all():
            raise ValueError("tokens are not numbered in order of their merges")
        self.merged = Table(pair_key(left, right), made)
        plain = np.array(sorted(self.ids.values()))
        keys = np.empty(len(plain), U64)
        for size in np.unique(self.length[plain]):
            own = self.length[plain] == size
            keys[own] = mix((BYTE[self.bytes[self.at[plain[own]][:, None] + np.arange(size)]] * powers(BASE, size)).sum(1))
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens have one hash")
        self.by_hash = Table(keys, plain)
        self.lengths = np.unique(self.length[plain])
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.word_at, self.word_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, np.int32)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two tokens can stand side by side: no merge across their border comes before the ones inside them."""
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while live.size:
            pair = self.merged.get(pair_key(x, y))
            cut = (pair >= 0) & (pair < limit)
            ok[live[cut]] = False
            keep = ~cut
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
            # Undo the later of the two tokens' last merges; a byte that is to be split ends one side.
            first = x > y
            limit = np.where(first, x, y + 1)
            nx, ny = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            end_x, end_y = first & (nx == x), ~first & (ny == y)
            limit = np.where(end_x, y + 1, np.where(end_y, x, limit))
            nx, ny = np.where(end_y, self.right[x], nx), np.where(end_x, self.left[y], ny)
            done = (end_x & (ny == y)) | (end_y & (nx == x))
            live, x, y, limit = live[~done], nx[~done], ny[~done], limit[~done]
        return ok

    def encode_long(self, word: bytes) -> list[int]:
        """The same states for one word, as a path instead of a trie."""
        last = [-1] * (len(word) + 1)
        most = int(self.lengths[-1])
        for d in range(1, len(word) + 1):
            for n in range(min(most, d), 0, -1):
                token = self.ids.get(word[d - n : d])
                if token is not None and (n == d or self._fits(last[d - n], token)):
                    last[d] = token
                    break
        out, d = [], len(word)
        while d:
            out.append(last[d])
            d -= int(self.length[last[d]])
        return out[::-1]

    @lru_cache(200_000)  # noqa: B019
    def _fits(self, a: int, b: int) -> bool:
        return bool(self.fit(np.array([a]), np.array([b]))[0])

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word one after the other, and how many each has. The words are of one class of length."""
        n, width = end - start, int((end - start).max())
        rows = np.zeros((len(n), width), np.uint8)
        rows[np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)] = data[ranges(start, n)]
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        rows, n_sorted = rows[order], n[order]
        same = rows[1:] == rows[:-1]
        shared = np.where(same.all(1), width, np.argmin(same, 1)) if len(rows) > 1 else np.zeros(0, np.int64)
        shared = np.append(0, np.minimum(shared, np.minimum(n_sorted[1:], n_sorted[:-1])))
        sums = np.zeros((len(rows), width + 1), U64)
        np.cumsum(BYTE[rows] * powers(BASE, width), axis=1, out=sums[:, 1:])
        back = powers(BACK, width + 1)
        last = np.full((len(rows), width + 1), -1, np.int32)
        index = np.arange(len(rows))
        for d in range(1, width + 1):
            inside = n_sorted >= d
            new = inside & (shared < d)
            todo = np.flatnonzero(new)
            for size in self.lengths[self.lengths <= d][::-1]:
                if not todo.size:
                    break
                token = self.by_hash.get(mix((sums[todo, d] - sums[todo, d - size]) * back[d - size]))
                hit = np.flatnonzero((token >= 0) & (self.length[token] == size))
                if not hit.size:
                    continue
                part = rows[todo[hit], d - size : d] == self.bytes[self.at[token[hit]][:, None] + np.arange(size)]
                hit = hit[part.all(1)]
                if not hit.size:
                    continue
                if size < d:
                    pairs, inverse = np.unique(last[todo[hit], d - size].astype(np.int64) << 20 | token[hit], return_inverse=True)
                    hit = hit[self.fit(pairs >> 20, pairs & ((1 << 20) - 1))[inverse]]
                last[todo[hit], d] = token[hit]
                rest = np.ones(len(todo), bool)
                rest[hit] = False
                todo = todo[rest]
            node = np.maximum.accumulate(np.where(new, index, 0))
            copied = np.flatnonzero(inside & ~new)
            last[copied, d] = last[node[copied], d]
        back_order = np.empty_like(order)
        back_order[order] = index
        # Read back from the leaves, all words a token at a time.
        steps, at, live = [], n_sorted.copy(), index
        while live.size:
            token = last[live, at[live]]
            steps.append((live, token))
            at[live] -= self.length[token]
            live = live[at[live] > 0]
        counts = np.zeros(len(rows), np.int64)
        for live, _ in steps:
            counts[live] += 1
        ends = np.cumsum(counts[back_order])
        out = np.empty(int(ends[-1]), np.int32)
        place = ends[order]  # where each sorted word's tokens end
        for k, (live, token) in enumerate(steps):
            out[place[live] - 1 - k] = token
        return out, counts[back_order]

    def learn(self, words: list[bytes], data: np.ndarray, n: np.ndarray) -> None:
        """Encode new words, which stand one after the other in ``data``, and remember them."""
        if len(self.words) + len(words) > KNOWN:
            self.forget()
        end = np.cumsum(n)
        start = end - n
        parts, at = [self.word_ids], len(self.word_ids)
        word_at, word_n = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        low = 0
        for high in (8, 16, 32, LONG):
            own = np.flatnonzero((n > low) & (n <= high))
            low = high
            for part in np.array_split(own, max(1, len(own) * high // (2 << 20) + 1)):
                if not part.size:
                    continue
                ids, counts = self.encode_words(data, start[part], end[part])
                word_n[part], word_at[part] = counts, at + np.cumsum(counts) - counts
                parts.append(ids)
                at += len(ids)
        for i in np.flatnonzero(n > LONG):
            ids = self.encode_long(words[i])
            word_n[i], word_at[i] = len(ids), at
            parts.append(np.array(ids, np.int32))
            at += len(ids)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.word_ids = np.concatenate(parts)
        self.word_at = np.concatenate((self.word_at, word_at))
        self.word_n = np.concatenate((self.word_n, word_n))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts one after the other, and where each text's begin."""
        special, start, end = split(data, offsets, self.special)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        whole = binaries(data, end - start).dictionary_encode()
        inverse, words = whole.indices.to_numpy(), whole.dictionary.to_pylist()
        at = self.find(words)
        new = np.flatnonzero(at < 0)
        if new.size:
            if len(self.words) + len(new) > KNOWN:
                self.forget()
                new = np.arange(len(words))
            self.learn([words[i] for i in new], *joined(whole.dictionary.take(pa.array(new))))
            at = self.find(words)
        word_at, word_n = self.word_at[at][inverse], self.word_n[at][inverse]
        if special.size:  # one token; its place is beyond the remembered ones
            word_n[special] = 1
        ids = np.empty(int(word_n.sum()), np.int32)
        begin = np.cumsum(word_n) - word_n
        ids[:] = self.word_ids[ranges(word_at, word_n)]
        for i in special:
            ids[begin[i]] = self.special[data[start[i] : end[i]].tobytes()]
        return ids, np.append(begin, len(ids))[np.searchsorted(start, offsets)]

    def find(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts and where each begins."""
        n = self.length[ids]
        ends = np.append(0, np.cumsum(n))
        return self.bytes[ranges(self.at[ids], n)], ends[offsets]


def split(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are special tokens, and each word's first byte and end: runs of letters, of numbers and of other
    characters, each with one blank before it; contractions after an apostrophe; what white space is left."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, none
    raw = data.tobytes()
    edges, marks = [offsets], []
    for word in special:
        at = raw.find(word)
        while at >= 0:
            i = np.searchsorted(offsets, at, "right")
            if i == len(offsets) or at + len(word) <= offsets[i]:
                marks.append((at, at + len(word)))
                at = raw.find(word, at + len(word))
            else:
                at = raw.find(word, at + 1)
    if marks:
        edges.append(np.array(marks).ravel())
    edge_bytes = np.unique(np.concatenate(edges))
    chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)  # of each character
    kind = char_kinds()[chars]
    edge = np.zeros(len(chars) + 1, bool)
    edge[np.searchsorted(byte_of, edge_bytes)] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    run_end = np.append(run[1:], len(chars))
    run_kind = kind[run]
    last_of_text = edge[run_end]
    # A run of white space before another run gives up its last character: a blank to that run, others stand alone.
    gives = (run_kind == SPACE) & ~last_of_text
    blank = gives & (chars[run_end - 1] == 32)
    takes = np.append(False, blank[:-1])
    starts = [run[~takes & ~gives], (run - 1)[takes], run[gives & (run_end - run > 1)], (run_end - 1)[gives & ~blank]]
    # Contractions: a lone apostrophe without a blank before it, then letters.
    lone = np.flatnonzero((run_kind == OTHER) & (run_end - run == 1) & (chars[run] == 39) & ~takes & ~last_of_text)
    lone = lone[run_kind[lone + 1] == LETTER] if lone.size else lone
    joined = []
    for i in lone:
        a, b = run[i + 1], run_end[i + 1]
        head = "".join(map(chr, chars[a : min(b, a + 2)]))
        for c in CONTRACTIONS:
            if head.startswith(c):
                joined.append((a, a + len(c) if a + len(c) < b else -1))
                break
    first = np.zeros(len(chars) + 1, bool)
    for s in starts:
        first[s] = True
    for a, rest in joined:
        first[a] = False
        if rest >= 0:
            first[rest] = True
    start = byte_of[np.flatnonzero(first[:-1])]
    if marks:
        inside = np.zeros(len(start), bool)
        for a, b in marks:
            inside[np.searchsorted(start, a) : np.searchsorted(start, b)] = True
        start = np.sort(np.concatenate((start[~inside], np.array([a for a, _ in marks]))))
    end = np.append(start[1:], n)
    return (np.searchsorted(start, np.array([a for a, _ in marks])) if marks else none), start, end


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bpe(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """Each document's tokens and the text that they decode to, with their digests. path: a vocabulary file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in pieces(offsets, CHUNK):
                ids, at = e.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                text, text_at = e.decode(ids, at)
                raw, plain = ids.astype("<u4").tobytes(), text.tobytes()
                spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
                texts = [plain[x:y] for x, y in zip(text_at[:-1].tolist(), text_at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in spans], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array([ids[x:y] if keep else None for x, y in spans], pa.list_(pa.int32())),
                        pa.array([t.decode(errors="replace") if keep else None for t in texts], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed tokenizer files have it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe(docs, vocabulary(), keep=False).drop("ids", "decoded")
