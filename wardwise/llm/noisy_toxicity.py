"""Operator 6: toxicity of restored text.

Words written to deceive (digits and signs for letters, repeated letters, letters
with white space or signs between them) are read as what left a noisy channel. Each
character may stand for some letters, be a repeat, or be nothing; Viterbi finds the
likeliest letters under a character model, trigrams counted over all documents. Words
of one character in a row are read as a whole, each gap as the end of a word or as
nothing; they count as the words so found and as one word without gaps.
The restored text is scored by a logistic model over whole words and their
beginnings, as a word's ending often varies.

Labels are learned from rows whose crc32 of the doc_id is not 0 modulo 5, at most
``TOXIC`` and ``CLEAN`` of them (in order of a hash); the model's constant is set
right by the odds among all of them, so scores do not depend on the bounds. Nulls and empty texts get the
score of a text without known words; without labels of both kinds every score is
0; rows that are repeated are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import U64, mix, pieces, text_bytes, word_bounds, word_hashes

TOXIC, CLEAN = 3000, 6000  # labelled rows learned from, at most
FEATURES = 3000
PREFIXES = (5, 6, 7)  # bytes
LEAST = 4  # toxic rows that a feature is in
LETTERS = 27  # a to z and the end of a word

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True
PLAIN = np.zeros(256, bool)
PLAIN[97:123] = True
SIGN = np.zeros(256, bool)
SIGN[[*b"0123456789@$!|+_*-."]] = True
#: Letters that a sign may stand for (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
STANDS = np.zeros(256, bool)
STANDS[[ord(c) for c in STANDS_FOR]] = True
#: First bytes of what may be a word of one character; letters of more bytes begin with 0xC3 or more, E2 and EF begin signs.
ALONE = PLAIN | STANDS
ALONE[[*range(0xC3, 0xE2), *range(0xE3, 0xEF)]] = True
WIDTH = np.ones(256, np.int64)  # bytes of a character by its first
WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 2, 3, 4
OPENING, TAIL = np.zeros(256, bool), np.zeros(256, bool)
OPENING[[*b"\"'(["]] = True
TAIL[[*b".,;:!?#%&*$\"')]"]] = True
REPEAT, SWAP, DROP = -1.5, -2.5, -1.0  # log chances of the channel
_tail = re.compile(r"[.,;:!?#%&*$\"')]+$")
_triple = re.compile(r"(.)\1\1")


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in small letters."""
    low = LOWER[data]
    after = np.append(False, data[:-1] == 0xC3)
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return low


def cores(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the first to the last letter of each word that has any, and the words' numbers."""
    n = len(low)
    letter = LETTER[low]
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1]
    leading = np.maximum.accumulate(np.where(letter, at, -1))
    first, last = following[starts], leading[ends - 1] + 1
    ok = np.flatnonzero(first < last)
    return first[ok], last[ok], ok


def trigrams(docs: DataFrame) -> np.ndarray:
    """Log chances of a letter after two others, from all words of plain letters in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts = np.zeros(LETTERS**3, np.int64)
            for a, b in pieces(offsets):
                low = LOWER[data[offsets[a] : offsets[b]]]
                if not len(low):
                    continue
                # Letters as 1 to 26, all else as 0: a word's edges.
                c = np.append(np.append([0, 0], np.where(PLAIN[low], low - 96, 0)), 0).astype(np.int64)
                before = np.where(c[1:-1] == 0, 0, c[:-2])  # nothing is known beyond an edge
                code = (before * LETTERS + c[1:-1]) * LETTERS + c[2:]
                counts += np.bincount(code, minlength=LETTERS**3)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # 27 ** 3 rows at most
    counts = np.full(LETTERS**3, 0.5)
    counts[rows["code"].to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    return np.log(counts / counts.sum(2, keepdims=True))


class Restorer:
    """Viterbi over the letters that a word's characters may stand for."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.tolist(), {}

    def word(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._word(word)
        return self.known[word]

    def run(self, letters: str) -> list[str]:
        """The words that characters which stood alone in a row make, and all of them as one word."""
        return [x for x in {*self._likeliest(letters, True).split(" "), self._word(letters)} if x]

    def _word(self, word: str) -> str:
        word = _tail.sub("", word.lower())
        letters = sum(c.isalpha() for c in word)
        odd = any(c in STANDS_FOR or c in "_*-." for c in word)
        if not word or (letters >= len(word) and not _triple.search(word)) or not (odd or _triple.search(word)):
            return word
        return self._likeliest(word)

    def _likeliest(self, word: str, gaps: bool = False) -> str:
        # A state is the last two letters; it holds its chance and its text, as a chain from its end.
        states = {(0, 0): (0.0, None)}
        for i, c in enumerate(word):
            options = []
            if "a" <= c <= "z":
                options.append((ord(c) - 96, c, 0.0))
            elif c in STANDS_FOR:
                options += [(ord(x) - 96, x, SWAP) for x in STANDS_FOR[c]]
            nothing = DROP if c in "_*-. " or c not in STANDS_FOR and not c.isalnum() else REPEAT if i and c == word[i - 1] else -4.0 if not options else None
            other = not options and c.isalpha()
            if gaps:
                ended = max(((chance + self.model[p][q][0], text) for (p, q), (chance, text) in states.items() if q), key=lambda x: x[0], default=None)
                if ended and ((0, 0) not in states or states[0, 0][0] < ended[0]):
                    states[0, 0] = (ended[0], (ended[1], " "))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (chance, text) in states.items():
                moves = [((q, x), chance + cost + self.model[p][q][x], (text, s)) for x, s, cost in options]
                if other:
                    moves.append(((0, 0), chance, (text, c)))
                elif nothing is not None:
                    moves.append(((p, q), chance + nothing, text))
                for state, value, text_after in moves:
                    if state not in after or after[state][0] < value:
                        after[state] = (value, text_after)
            states = after
        ends = [(chance + self.model[p][q][0], text) for (p, q), (chance, text) in states.items()]
        best = max(x for x, _ in ends)
        return max(_spelt(text) for x, text in ends if x == best)


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


def feature_hashes(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, and the row of each."""
    rows = np.arange(len(first))
    out, of = [word_hashes(low, first, last)], [rows]
    for n in PREFIXES:
        ok = last - first >= n
        out.append(mix(word_hashes(low, first[ok], first[ok] + n) + U64(n)))
        of.append(rows[ok])
    return np.concatenate(out), np.concatenate(of)


def features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of restored texts; a document may have a feature more than once."""
    low = lowered(data)
    starts, ends, at = word_bounds(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    first, last, word = cores(low, starts, ends)
    hashes, row = feature_hashes(low, first, last)
    docs, out = [doc[word][row]], [hashes]
    # Words that may hide others.
    letters = np.concatenate(([0], np.cumsum(LETTER[low])))
    signs = np.concatenate(([0], np.cumsum(SIGN[low])))
    stands = np.concatenate(([0], np.cumsum(STANDS[low])))
    triple = np.zeros(len(low) + 1, np.int64)
    triple[3:] = np.cumsum((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & LETTER[low[2:]]) if len(low) > 2 else 0
    n_letters = letters[ends] - letters[starts]
    has_triple = (ends - starts > 2) & (triple[ends] > triple[np.minimum(starts + 2, ends)])
    hidden = np.flatnonzero((n_letters + stands[ends] - stands[starts] >= 2) & ((signs[ends] > signs[starts]) | has_triple))
    # Single characters in a row, with or without signs around them.
    at = np.arange(len(low))
    begin = np.minimum.accumulate(np.where(OPENING[low], len(low), at)[::-1])[::-1][starts]
    begin = np.where(begin < ends, begin, starts)
    single = ALONE[low[begin]] & (np.maximum.accumulate(np.where(TAIL[low], -1, at))[ends - 1] < begin + WIDTH[low[begin]])
    run = single & np.append(False, single[:-1]) & (doc == np.append(-1, doc[:-1]))
    raw = low.tobytes()
    texts, of = [], []
    for i in hidden.tolist():
        text = restorer.word(raw[starts[i] : ends[i]].decode(errors="replace"))
        if text:
            texts.append(text)
            of.append(doc[i])
    edge = np.flatnonzero(~run)
    sizes = np.diff(np.append(edge, len(run)))
    for i, n in zip(edge[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        found = restorer.run(b"".join(raw[a : a + w] for a, w in zip(begin[i : i + n].tolist(), WIDTH[low[begin[i : i + n]]].tolist())).decode(errors="replace"))
        texts += found
        of += [doc[i]] * len(found)
    if texts:
        coded = [t.encode() for t in texts]
        size = np.array([len(t) for t in coded])
        begin = np.cumsum(size) - size
        joined = np.frombuffer(b"".join(coded), np.uint8)
        f, l, w = cores(joined, begin, begin + size)
        # Letters of the next word are not this word's.
        inside = (f >= begin[w]) & (l <= (begin + size)[w])
        h, row = feature_hashes(joined, f[inside], l[inside])
        docs.append(np.array(of)[w[inside]][row])
        out.append(h)
    return np.concatenate(docs), np.concatenate(out)


class Model:
    """Hashes of known features in order, their weights, and the constant."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, constant: float):
        self.hashes, self.weights, self.constant = hashes, weights, constant

    def scores(self, docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.constant)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(docs[hit] * len(self.hashes) + at[hit])
            total += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], n)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(texts: list[np.ndarray], toxic: np.ndarray, rounds: int = 400) -> Model:
    """Logistic regression over the features that lean most to toxic rows. texts: each row's different features."""
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, U64), np.zeros(0), -60.0)
    inside, count_toxic = np.unique(np.concatenate([t for t, y in zip(texts, toxic) if y]), return_counts=True)
    inside, count_toxic = inside[count_toxic >= LEAST], count_toxic[count_toxic >= LEAST]
    clean = np.concatenate([t for t, y in zip(texts, toxic) if not y])
    at = np.searchsorted(inside, clean)
    ok = at < len(inside)
    ok[ok] = inside[at[ok]] == clean[ok]
    count_clean = np.bincount(at[ok], minlength=len(inside))
    lean = np.log((count_toxic + 0.5) / (n_toxic + 1)) - np.log((count_clean + 0.5) / (n_clean + 1))
    best = np.argsort(-(lean * np.sqrt(count_toxic)), kind="stable")[:FEATURES]
    best = np.sort(best[lean[best] > 1])
    hashes = inside[best]
    rows, cols = [], []
    for i, t in enumerate(texts):
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, t), len(hashes) - 1)
            hit = at[hashes[at] == t]
            rows.append(np.full(len(hit), i))
            cols.append(hit)
    rows, cols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    w, b = np.zeros(len(hashes)), np.log(n_toxic / n_clean)
    seen_w, seen_b = np.full(len(hashes), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], len(texts)), -60, 60)))
        error = toxic - p
        g = np.bincount(cols, error[rows], len(hashes)) - 0.1 * w
        seen_w += g * g
        seen_b += error.sum() ** 2
        w += 0.5 * g / np.sqrt(seen_w)
        b += 0.5 * error.sum() / np.sqrt(seen_b)
    return Model(hashes, w, float(b))


def learned(docs: DataFrame, labels: DataFrame, restorer_model: np.ndarray) -> Model:
    rows = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    n_toxic, n_clean = (x or 0 for x in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    chosen = rows.where("toxic = 1").orderBy(*order).limit(TOXIC).unionByName(rows.where("toxic = 0").orderBy(*order).limit(CLEAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(restorer_model)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            own = [x for a, b in pieces(offsets) for x in _by_doc(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], restorer), b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.binary())], names=["toxic", "features"])

    # The sample is of bounded size (TOXIC + CLEAN ids), so it is broadcast and what is gathered is bounded too.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(run, "toxic int, features binary").toArrow()
    model = fit([np.frombuffer(x.as_buffer(), U64) if x.as_py() else np.zeros(0, U64) for x in got["features"]], got["toxic"].to_numpy().astype(np.float64))
    if n_toxic and n_clean:
        # The bounds take a share of each kind; the sample's odds become those of all rows.
        model.constant += float(np.log(n_toxic / min(n_toxic, TOXIC)) - np.log(n_clean / min(n_clean, CLEAN)))
    return model


def _by_doc(doc: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    at = np.searchsorted(doc, np.arange(n + 1))
    return [hashes[a:b].tobytes() for a, b in zip(at, at[1:])]


def _scorer(docs: DataFrame, labels: DataFrame):
    """A function from a batch with a column text to its scores."""
    spark: SparkSession = docs.sparkSession
    letters = trigrams(docs)
    model = learned(docs, labels, letters)
    shared = spark.sparkContext.broadcast((letters, model))  # 27 ** 3 chances and FEATURES weights

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        restorer, scorer = Restorer(shared.value[0]), shared.value[1]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            parts = [scorer.scores(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], restorer), b - a) for a, b in pieces(offsets)]
            yield batch, np.concatenate(parts) if parts else np.zeros(0)

    return scores


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scores = _scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scores(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents whose score is below ``most``, with all their columns."""
    scores = _scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scores(batches):
            yield batch.filter(pa.array(score < most))

    return docs.mapInArrow(run, docs.schema)


def op6_query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
