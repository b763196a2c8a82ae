"""Operator 13: spelling variants of words, found in a frequency-vector trie.

Words are runs of letters; of one in ``PLANT`` occurrences (by a checksum of document
and run) a letter is deleted. Words of two occurrences or more are arranged by their
frequency vectors: how often each letter group occurs, the commonest letters in groups
of their own and first. Of two words one edit apart, the vectors differ by a surplus
of one, a deficit of one, or one of each. A pair is looked for from its shorter word,
of equally long ones from that whose first differing count is the smaller, so the
search down the trie spends its surplus before its deficit and finds a pair once. It
goes depth first, blocks of words at a time; the words of the leaves it ends in are
verified by their common beginnings and endings.

The trie is cut into shards by its first levels. A word is in the shard of its own
counts, and is sent as a query to the shards within the budget. Shards with more than
``SHARD`` words are cut again, some levels deeper, and the queries of a shard are dealt
out in parts of about ``QUERIES``. What is near a word is counted, and the most frequent
of it chosen, with map-side combining; roots are found by doubling the way along forms,
whose counts grow at least tenfold a step.

Null texts have no words; very long texts are read in pieces, and words of any length
are compared; a null doc_id is written as the empty text in the checksum; repeated rows
count each; of equally frequent near words the first in code-point order is the form;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .columns import LOWER, U64, mix, pieces, ranges, text_bytes, word_bounds
from .store import written

PLANT = 31
GROUPS, ALONE = 12, 8  # letter groups, of which so many hold one letter
LEVELS = (3, 6, 9, GROUPS)  # levels that shards are cut at
SHARD, QUERIES = 1 << 16, 1 << 18
CHUNK = 1 << 19  # states of a search that are moved together
HELD = 1 << 24  # bytes of words counted together
WIDE = 64  # letters of words that are compared as rows of a matrix

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32_from(state: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of what had these values before, continued by each range of bytes."""
    crc = ~state.astype(np.uint32)
    long = size > 256
    for step in range(int(size[~long].max(initial=0))):
        live = np.flatnonzero((size > step) & ~long)
        crc[live] = _CRC[(crc[live] ^ data[starts[live] + step]) & np.uint32(255)] ^ (crc[live] >> np.uint32(8))
    crc = ~crc
    for i in np.flatnonzero(long):
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]].tobytes(), int(state[i]))
    return crc


def strings(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    """The ranges of bytes as texts."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, size)]))


def spelled(ids: list[str], data: np.ndarray, offsets: np.ndarray, least: int) -> list[pa.Array]:
    """The words of some texts, one each occurrence, of ``least`` letters or more."""
    data = LOWER[data]
    # The letters beyond ASCII, U+00C0 to U+00FF, are the two-byte characters that begin with C3.
    head = data == 0xC3
    inside = _LETTER[data] | head
    inside[1:] |= head[:-1]
    starts, ends, at = word_bounds(np.where(inside, 0x61, 0x20).astype(np.uint8), offsets)
    heads = np.append(0, np.cumsum(head, dtype=np.int64))
    length = ends - starts - heads[ends] + heads[starts]
    of = np.repeat(np.arange(len(ids)), np.diff(at))
    keep = length >= least
    starts, size, length, of = starts[keep], (ends - starts)[keep], length[keep], of[keep]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc32_from(before[of], data, starts, size)
    cut = h % PLANT == 0
    short = []
    for i in np.flatnonzero(cut & (length > least)):
        word = data[starts[i] : starts[i] + size[i]].tobytes().decode()
        k = int(h[i]) % len(word)
        short.append(word[:k] + word[k + 1 :])
    return [strings(data, starts[~cut], size[~cut]), pa.array(short, pa.string())]


def words(docs: DataFrame, least: int = 7, twice: int = 2) -> DataFrame:
    """word and n (occurrences) of all words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def counted() -> pa.RecordBatch:
            found = pc.value_counts(pa.concat_arrays(held))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("id").to_pylist()
            for a, b in pieces(offsets):
                held += spelled(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                if sum(h.nbytes for h in held) > HELD:
                    yield counted()
        if held:
            yield counted()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words (all below 256), and where each word begins."""
    data, offsets = text_bytes(column)
    head = data == 0xC3
    codes = data.copy()
    codes[1:][head[:-1]] += 0x40
    return codes[~head], offsets - np.append(0, np.cumsum(head))[offsets]


def letter_groups(table: DataFrame) -> np.ndarray:
    """Group of each code point: the commonest alone, in order, the others dealt to the groups left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(letters(batch.column("word"))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["code", "n"])

    total = np.zeros(256, np.int64)
    for r in table.select("word").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # 256 rows at most
        total[r["code"]] = r["n"]
    rank = np.empty(256, np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(256)
    return np.where(rank < ALONE, rank, ALONE + (rank - ALONE) % (GROUPS - ALONE))


def vectors(column: pa.Array, groups: np.ndarray) -> np.ndarray:
    """Frequency vector of each word."""
    codes, offsets = letters(column)
    of = np.repeat(np.arange(len(column)), np.diff(offsets))
    return np.bincount(of * GROUPS + groups[codes], minlength=len(column) * GROUPS).reshape(-1, GROUPS)


def node_of(counts: np.ndarray) -> np.ndarray:
    """Number of the trie's node with these first counts. Nodes that share one by chance share a shard, no more."""
    h = np.zeros(len(counts), U64)
    for g in range(counts.shape[1]):
        h = mix(h * U64(0x9E3779B97F4A7C15) + counts[:, g].astype(U64) + U64(1))
    return h.view(np.int64)


def nodes(table: DataFrame, groups: np.ndarray, levels: int, within: bool) -> DataFrame:
    """node, word and n: the node that a word lies in, or all that its search goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(batch.column("word"), groups)[:, :levels]
            found, row = [node_of(own)], [np.arange(len(own))]
            for i in range(levels) if within else ():
                more = own.copy()
                more[:, i] += 1
                found.append(node_of(more))
                row.append(row[0])
                for j in range(i + 1, levels):
                    some = np.flatnonzero(own[:, j])
                    less = more[some]
                    less[:, j] -= 1
                    found.append(node_of(less))
                    row.append(some)
            pairs = np.unique(np.stack((np.concatenate(row), np.concatenate(found))), axis=1) if within else np.stack((row[0], found[0]))
            at = pa.array(pairs[0])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), batch.column("word").take(at), batch.column("n").take(at)], names=["node", "word", "n"])

    return table.select("word", "n").mapInArrow(run, "node long, word string, n long")


class Trie:
    """Words in order of their vectors; a level's nodes are the ranges of words with equal first counts."""

    def __init__(self, column: pa.Array, groups: np.ndarray) -> None:
        v = vectors(column, groups)
        self.order = np.lexsort(v.T[::-1]) if len(v) else np.zeros(0, np.int64)
        v = v[self.order]
        self.base = int(v.max(initial=0)) + 2
        new = np.zeros(len(v), bool)
        new[:1] = True
        parent = np.zeros(len(v), np.int64)
        self.children = []  # of each level: parent and count of its nodes, as one number
        for g in range(GROUPS):
            new[1:] |= v[1:, g] != v[:-1, g]
            first = np.flatnonzero(new)
            self.children.append(parent[first] * self.base + v[first, g])
            parent = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), len(v))  # of each leaf

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child of that count, and the child."""
        known = self.children[level]
        want = node * self.base + count
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        ok = np.flatnonzero((known[at] == want) & (count >= 0) & (count < self.base))
        return ok, at[ok]

    def search(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, place in ``order`` and budget spent (0 none, 1 the surplus, 2 both) of all words of the leaves within the budget."""
        stack = [(0, np.lexsort(v.T[::-1]), np.zeros(len(v), np.int64), np.zeros(len(v), np.int8))]
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > CHUNK:
                half = len(query) // 2
                stack += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
            elif level == GROUPS:
                size = self.first[node + 1] - self.first[node]
                bounds = np.cumsum(size)
                for a, b in pieces(np.append(0, bounds), CHUNK):
                    yield np.repeat(query[a:b], size[a:b]), ranges(self.first[node[a:b]], size[a:b]), np.repeat(spent[a:b], size[a:b])
            elif len(query):
                count, found = v[query, level], []
                for step, before in ((0, None), (1, 0), (-1, 1)):
                    some = np.arange(len(query)) if before is None else np.flatnonzero(spent == before)
                    ok, to = self.child(level, node[some], count[some] + step)
                    some = some[ok]
                    found.append((query[some], to, spent[some] + np.int8(before is not None)))
                stack.append((level + 1, *(np.concatenate(x) for x in zip(*found))))


def matrix(codes: np.ndarray, offsets: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Words as rows of letters, from the front or the back, zeros beyond their ends; longer ones are cut."""
    n = np.diff(offsets)
    out = np.zeros((len(n), width), np.uint8)
    for k in range(width):
        some = np.flatnonzero(n > k)
        out[some, k] = codes[offsets[some + 1] - 1 - k if back else offsets[some] + k]
    return out


class Words:
    """Words that can be compared."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column
        self.codes, self.offsets = letters(column)
        self.n = np.diff(self.offsets)

    def rows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return matrix(self.codes, self.offsets, width, False), matrix(self.codes, self.offsets, width, True)


def one_edit(short: str, other: str) -> bool:
    """Whether one inserted or replaced letter makes the other, different word of a word that is not longer."""
    a = next((i for i, (x, y) in enumerate(zip(short, other)) if x != y), len(short))
    return len(other) - len(short) <= 1 and short[a + (len(short) == len(other)) :] == other[a + 1 :]


def near_pairs(index: pa.Table, trie: Trie, known: Words, batch: pa.Table, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of queries and of indexed words that are one edit apart."""
    asked = Words(batch["word"].combine_chunks())
    width = -(-min(WIDE, max(int(known.n.max()), int(asked.n.max()))) // 8) * 8
    ours, theirs = asked.rows(width), known.rows(width)
    half = min(4, int(known.n.min()) // 2, int(asked.n.min()) // 2)
    our_ends, their_ends = ([np.pad(m[:, :half], ((0, 0), (0, 4 - half))).view("<u4")[:, 0] for m in both] for both in (ours, theirs))
    for query, place, spent in trie.search(vectors(asked.column, groups)):
        row = trie.order[place]
        # What is one edit away has a common beginning or end of half its letters.
        likely = (our_ends[0][query] == their_ends[0][row]) | (our_ends[1][query] == their_ends[1][row])
        query, row, spent = query[likely], row[likely], spent[likely]
        same = spent == 0
        # Words with one vector meet twice, and each meets itself.
        if same.any():
            text = lambda c, at: c.take(pa.array(at))
            less = pc.less(text(asked.column, query[same]), text(known.column, row[same])).to_numpy(zero_copy_only=False)
            ok = ~same
            ok[same] = less
            query, row = query[ok], row[ok]
        common = np.zeros(len(query), np.int64)
        for mine, other in zip(ours, theirs):
            differ = mine[query] != other[row]
            common += np.where(differ.any(1), differ.argmax(1), width)
        n, m = asked.n[query], known.n[row]
        ok = common >= n - (n == m)
        for i in np.flatnonzero(m > width):
            ok[i] = one_edit(asked.column[int(query[i])].as_py(), known.column[int(row[i])].as_py())
        yield query[ok], row[ok]


def nearest(parts: DataFrame, groups: np.ndarray) -> DataFrame:
    """word, other and other_n of both words of each near pair, from rows of shards: node, part, query, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, trie, known = None, [], None, None
        for batch in batches:
            shards = batch.select(["node", "part", "query"])
            node, part, query = (shards.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])))
            for a, b in zip(new, np.append(new[1:], len(node))):
                rows = pa.Table.from_batches([batch.slice(int(a), int(b - a)).select(["word", "n"])])
                if (node[a], part[a]) != shard:
                    shard, index, trie = (node[a], part[a]), [], None
                if not query[a]:
                    index.append(rows)
                    continue
                if not index:
                    continue
                if trie is None:
                    table = pa.concat_tables(index).combine_chunks()
                    known = Words(table["word"].combine_chunks())
                    trie = Trie(known.column, groups)
                for q, r in near_pairs(table, trie, known, rows, groups):
                    q, r = rows.take(pa.array(q)), table.take(pa.array(r))
                    for x, y in ((q, r), (r, q)):
                        yield from pa.table({"word": x["word"], "other": y["word"], "other_n": y["n"]}).to_batches()

    ordered = parts.repartition("node", "part").sortWithinPartitions("node", "part", "query")
    return ordered.select("node", "part", "query", "word", "n").mapInArrow(run, "word string, other string, other_n long")


def near_words(table: DataFrame) -> DataFrame:
    """word, n_near and best (minus its n, and itself) of the words that have near words."""
    groups, pairs, index, queries = letter_groups(table), None, table, table
    for levels in LEVELS:
        sizes = nodes(index, groups, levels, False).groupBy("node").agg(F.count("*").alias("size"))
        sizes = written(sizes, "nodes")
        closed = sizes if levels == GROUPS else sizes.where(F.col("size") <= SHARD)
        sent = nodes(queries, groups, levels, True)
        dealt = sent.join(closed, "node").groupBy("node").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        dealt = written(dealt, "parts")
        asked = sent.join(dealt, "node").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("query", F.lit(True))
        held = nodes(index, groups, levels, False).join(dealt, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(False))
        found = nearest(asked.unionByName(held), groups)
        pairs = found if pairs is None else pairs.unionByName(found)
        if levels == GROUPS or not sizes.where(F.col("size") > SHARD).limit(1).count():
            break
        large = sizes.where(F.col("size") > SHARD).select("node")
        index = written(nodes(index, groups, levels, False).join(large, "node", "left_semi").select("word", "n"), "deeper")
        queries = written(sent.join(large, "node", "left_semi").select("word", "n").distinct(), "queries")
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the way along forms ends. forms: word, form."""
    way = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation()
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        way = written(further.observe(seen, F.count_if("moved").alias("moved")), "roots").select("word", "root")
        if not seen.get["moved"]:
            return way


def variants(docs: DataFrame, least: int = 7, twice: int = 2, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    table = written(words(docs, least, twice), "words")
    near = table.join(near_words(table), "word", "left")
    is_form = -F.col("best.minus") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    near = written(near, "forms")
    return near.join(roots(near.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")
