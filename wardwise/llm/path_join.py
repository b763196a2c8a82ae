"""Operator 8: near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class and only its
smallest document goes on. Each tree starts with all classes; a node picks one or
two of the minwise tokens (one third of the nodes two, so that a pair at the
threshold is expected to go on in one child) and sends every document to the child
that its token names. A path is a hash, so a document follows its own first ``DEPTH``
picks alone, and only then are nodes counted. Small nodes are compared exhaustively.
All members of large ones are first compared with three pivots. What is linked then
needs no more comparing: nodes that hold one component end, the others branch on until
the pairs across their components are few, and these are compared exhaustively. Up to
``MID`` documents a node is branched inside a task; larger nodes are branched by
Spark, a level a round, and what stays larger after ``MORE`` levels is compared in
full, in blocks, so no limit loses a link. Trees are independent; with ``trees`` of
them a pair at the threshold is missed with a probability of about 0.4 ** trees.

Candidates are sifted by their minwise estimate (four deviations below the
threshold), then confirmed on full sets: those of small nodes and pivots by joins,
first one partner of each document, then one candidate of any two components, then all
that still lie in different components, so a group of many near copies gives rows for
its documents and not for its pairs; those of large nodes in the task that has the node,
to which its sets are sent.

Null and empty texts have no shingles, are linked with nothing and kept; texts of
fewer words than a shingle are one shingle; rows without doc_id are left out; rows
that share a doc_id share its component; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import LOWER, U64, grams, mix, pieces, ranges, text_bytes, word_bounds, word_hashes
from .store import written

TOKENS = 64
SEEDS = mix(np.arange(1, TOKENS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
DEPTH = 3  # picks before nodes are counted
LEAF = 24
SURE = 56  # shared tokens from which candidates are taken as equally good
MID = 2048  # documents of a node that a task branches by itself
MORE = 6  # levels of larger nodes
DEEPEST = 40  # levels in a task; documents that still share all tokens are compared exhaustively
ROWS = 1 << 15  # memberships of whole nodes that a task looks at together
PAIRS = 1 << 14  # pairs that are compared together
COLUMNS = 4096  # shingles whose bits are compared together
BLOCK = 1024  # documents of a cluster that are compared with as many others at a time


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in order, and where each text's begin."""
    data = LOWER[data]
    starts, ends, at = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = np.diff(at)
    every = grams(hashes, words)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    shingle = every[ranges(at[:-1], np.maximum(n - words + 1, 0))]
    short = np.flatnonzero((n > 0) & (n < words))
    whole = hashes[at[short]]
    for k in range(1, words - 1):  # fewer words: the whole sequence
        more = n[short] > k
        whole[more] = grams(np.column_stack((whole[more], hashes[at[short][more] + k])).ravel(), 2)[::2]
    doc, shingle = np.append(doc, short), np.append(shingle, mix(whole + U64(1)))
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    doc, shingle = doc[new], shingle[new]
    return shingle, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, and its minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in pieces(offsets):
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                tokens = np.zeros((b - a, TOKENS), np.uint16)
                sums = [np.zeros(b - a, np.int64) for _ in range(2)]
                if len(full):
                    begin = at[:-1][full]
                    for i, seed in enumerate(SEEDS):
                        tokens[full, i] = mix(np.minimum.reduceat((sets ^ (seed >> U64(7))) * (seed | U64(1)), begin)) >> U64(48)
                    for s, salt in zip(sums, (1, 2)):
                        s[full] = np.add.reduceat(mix(sets + U64(salt)), begin).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([row.tobytes() for row in tokens], pa.binary())],
                    names=["doc_id", "n_shingles", "digest1", "digest2", "tokens"],
                )

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n_shingles long, digest1 long, digest2 long, tokens binary")


def _tokens(column: pa.Array) -> np.ndarray:
    data, _ = text_bytes(column.cast(pa.binary()))
    return data.view(np.uint16).reshape(-1, TOKENS)


def children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of documents at nodes, and the row that each is of."""
    picks = mix(nodes + U64(1)), mix(nodes + U64(2))
    rows = np.arange(len(nodes))
    two = rows[(mix(nodes + U64(3)) % U64(3) == 0) & (picks[0] % U64(TOKENS) != picks[1] % U64(TOKENS))]
    row = np.concatenate((rows, two))
    pick = np.concatenate((picks[0], picks[1][two])) % U64(TOKENS)
    value = tokens[row, pick.astype(np.int64)].astype(U64)
    return mix(nodes[row] ^ mix((pick << U64(32) | value) + U64(11))), row


def roots(classes: DataFrame, trees: int) -> DataFrame:
    """(node, doc_id) after the first picks of every tree."""
    start = mix(np.arange(1, trees + 1, dtype=U64) * U64(0xE7037ED1A0B428DB))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column("tokens"))
            for root in start:
                node, row = np.full(len(tokens), root), np.arange(len(tokens))
                for _ in range(DEPTH):
                    node, of = children(node, tokens[row])
                    row = row[of]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("doc_id").take(pa.array(row))], names=["node", "doc_id"])

    return classes.select("doc_id", "tokens").mapInArrow(run, "node long, doc_id long")


def counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two documents or more, with the node's size."""
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node")


def _alike(doc: np.ndarray, tokens: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs of rows those that share enough tokens: (smaller doc, larger doc, shared tokens)."""
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        same = (tokens[x] == tokens[y]).sum(1)
        ok = (same >= least) & (doc[x] != doc[y])
        x, y = doc[x[ok]], doc[y[ok]]
        yield np.minimum(x, y), np.maximum(x, y), same[ok]


def explored(node: np.ndarray, doc: np.ndarray, component: np.ndarray, tokens: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates across components of nodes, branched until their pairs are few. All nodes of a level together."""
    row = np.arange(len(doc))
    for level in range(DEEPEST + 1):
        order = np.lexsort((component[row], node))
        node, row = node[order], row[order]
        edge = np.append(True, node[1:] != node[:-1])[: len(node)]
        first = np.flatnonzero(edge)
        if not len(first):
            return
        inner = np.flatnonzero(edge | np.append(True, component[row][1:] != component[row][:-1])[: len(node)])
        run = np.diff(np.append(inner, len(node)))
        n = np.diff(np.append(first, len(node)))
        across = (n * n - np.add.reduceat(run * run, np.searchsorted(inner, first))) // 2
        small = np.repeat((across <= LEAF * n // 2) | (level == DEEPEST), n)
        # Each one's partners: those of its node behind its own component.
        run_end, node_end = np.repeat(inner + run, run), np.repeat(first + n, n)
        count = np.where(small, node_end - run_end, 0)
        ends = np.cumsum(count)
        for i in range(0, int(ends[-1]), PAIRS):
            lo, hi = int(np.searchsorted(ends, i, "right")), int(np.searchsorted(ends, i + PAIRS))
            own = slice(lo, min(hi + 1, len(count)))
            begin = np.maximum(ends[own] - count[own], i)
            k = np.minimum(ends[own], i + PAIRS) - begin
            offset = begin - (ends[own] - count[own])
            yield from _alike(doc, tokens, np.repeat(row[own], k), row[ranges(run_end[own] + offset, k)], least)
        go = ~small & np.repeat(across > 0, n)
        node, of = children(node[go], tokens[row[go]])
        row = row[go][of]


def by_nodes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole nodes, of about ``most`` rows, from rows in order of their node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            part = batch.slice(i, most)
            node = part.column("node").to_numpy()
            # What is held ends where the last node of this part begins.
            cut = int(np.searchsorted(node, node[-1]))
            if cut or (held and held[-1].column("node")[-1].as_py() != node[0]):
                held.append(part.slice(0, cut))
                if sum(h.num_rows for h in held) >= most:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(part.slice(cut))
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(t: pa.Table, least: int) -> list[np.ndarray]:
    """Distinct candidates of a table of whole nodes: two rows of it, and their shared tokens."""
    doc, row = np.unique(t["doc_id"].to_numpy(), return_index=True)
    tokens = _tokens(t["tokens"])
    parts = list(explored(t["node"].to_numpy().view(U64), t["doc_id"].to_numpy(), t["component_id"].to_numpy(), tokens, least))
    a, b, same = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((-same, b, a))
    a, b, same = a[order], b[order], same[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return [row[np.searchsorted(doc, a[new])], row[np.searchsorted(doc, b[new])], same[new]]


def _of_nodes(members: DataFrame, found, schema: str) -> DataFrame:
    """What ``found`` gives of tables of whole nodes, whose members are node, doc_id, component_id, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_nodes(batches, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(t)], names=[f.split()[0] for f in schema.split(", ")])

    return members.select("node", "doc_id", "component_id", "tokens").repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def partners_of(members: DataFrame, least: int) -> DataFrame:
    """Of each document one candidate of its nodes in a task (doc_id, other, same): the smallest of those that share SURE tokens, else the best."""

    def found(t: pa.Table) -> list[np.ndarray]:
        a, b, same = _candidates(t, least)
        ids = t["doc_id"].to_numpy()
        doc, other, same = np.append(ids[a], ids[b]), np.append(ids[b], ids[a]), np.append(same, same).astype(np.int32)
        first = _firsts(doc, order=np.lexsort((other, -np.minimum(same, SURE), doc)))
        return [doc[first], other[first], same[first]]

    return _of_nodes(members, found, "doc_id long, other long, same int")


def between(members: DataFrame, least: int) -> DataFrame:
    """Of any two components that meet in nodes of a task the best candidate (ca, cb, a, b, same)."""

    def found(t: pa.Table) -> list[np.ndarray]:
        a, b, same = _candidates(t, least)
        ids, component = t["doc_id"].to_numpy(), t["component_id"].to_numpy()
        low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
        first = _firsts(low, high, order=np.lexsort((ids[b], ids[a], -same, high, low)))
        return [low[first], high[first], ids[a][first], ids[b][first], same[first].astype(np.int32)]

    return _of_nodes(members, found, "ca long, cb long, a long, b long, same int")


def _firsts(*keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first row of each different key, of rows in that order."""
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))[: len(order)]
    return order[new]


def pairs_of(members: DataFrame, least: int) -> DataFrame:
    """All candidates (a, b) across components of nodes."""

    def found(t: pa.Table) -> list[np.ndarray]:
        a, b, _ = _candidates(t, least)
        ids = t["doc_id"].to_numpy()
        return [ids[a], ids[b]]

    return _of_nodes(members, found, "a long, b long").distinct()


def shared_shingles(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of sets the shingles that both have, by bits of some columns at a time."""
    n = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, ok = np.repeat(np.arange(len(sets)), n), count[column] > 1
    row, column = row[ok], (np.cumsum(count > 1) - 1)[column[ok]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros(len(a), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        ones = np.zeros((len(sets), COLUMNS), bool)
        ones[row[part], column[part] - first] = True
        bits = np.packbits(ones, axis=1).view(np.uint64)
        for i in range(0, len(a), PAIRS):
            out[i : i + PAIRS] += np.bitwise_count(bits[a[i : i + PAIRS]] & bits[b[i : i + PAIRS]]).sum(1).astype(np.int64)
    return out


def links_of(members: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes of up to MID documents, confirmed on full sets where the nodes are: one for two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_nodes(batches, MID):
            a, b, _ = _candidates(t, least)
            used = np.unique(np.append(a, b))
            shingles = [np.frombuffer(x.as_buffer(), U64) for x in t["shingles"].take(pa.array(used))]
            if not len(a):
                continue
            n = np.array([len(x) for x in shingles])
            x, y = np.searchsorted(used, a), np.searchsorted(used, b)
            near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            a, b, x, y = a[near], b[near], x[near], y[near]
            both = shared_shingles(shingles, x, y)
            ok = 100 * both >= percent * (n[x] + n[y] - both)
            component = t["component_id"].to_numpy()
            ends = np.sort(np.column_stack((component[a[ok]], component[b[ok]])), axis=1)
            once = np.unique(ends, axis=0, return_index=True)[1]
            ids = t["doc_id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok][once]]), pa.array(ids[b[ok][once]])], names=["a", "b"])

    whole = members.select("node", "doc_id", "component_id", "tokens").join(sets, "doc_id")
    return whole.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def stars(large: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Candidates of large nodes (doc_id, other, same): every member with three pivots."""
    pivot = [F.min(F.struct(F.xxhash64("node", "doc_id", F.lit(k)).alias("h"), "doc_id"))["doc_id"].alias(f"pivot{k}") for k in range(3)]
    pivots = large.groupBy("node").agg(F.array_distinct(F.array(*[p for p in pivot])).alias("p")).select("node", F.explode("p").alias("pivot"))
    pivots = pivots.join(classes.select(F.col("doc_id").alias("pivot"), F.col("tokens").alias("theirs")), "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_tokens(batch.column("tokens")) == _tokens(batch.column("theirs"))).sum(1)
            a, b = batch.column("doc_id").to_numpy(), batch.column("pivot").to_numpy()
            ok = (same >= least) & (a != b)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(same[ok], pa.int32())], names=["doc_id", "other", "same"])

    both = large.join(pivots, "node").select("doc_id", "tokens", "pivot", "theirs")
    return both.mapInArrow(run, "doc_id long, other long, same int").distinct()


def branched(members: DataFrame) -> DataFrame:
    """One level of children, with what belongs to each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, row = children(batch.column("node").to_numpy().view(U64), _tokens(batch.column("tokens")))
                rest = batch.select(["doc_id", "component_id", "tokens"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *rest.columns], names=["node", "doc_id", "component_id", "tokens"])

    return members.select("node", "doc_id", "component_id", "tokens").mapInArrow(run, "node long, doc_id long, component_id long, tokens binary")


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of nodes that hold more than one component, with their components."""
    at = members.drop("component_id").join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    several = at.groupBy("node").agg((F.min("component_id") < F.max("component_id")).alias("several")).where("several").select("node")
    return at.join(several, "node", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and the whole set of those documents, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in pieces(offsets):
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([sets[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough: 100 * shared >= percent * all."""
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """doc_id and the smallest document that links reach from it, for documents that have links.

    Every round takes the least label of the neighbours and then its own label's label, until nothing changes.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("component_id")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("component_id").alias("m"))
        low = labels.join(seen.withColumnRenamed("a", "doc_id"), "doc_id").select("doc_id", "component_id", F.least("component_id", "m").alias("low"))
        jump = labels.select(F.col("doc_id").alias("low"), F.col("component_id").alias("far"))
        after = written(low.join(jump, "low").select("doc_id", "component_id", F.least("low", "far").alias("next")), "labels")
        labels = after.select("doc_id", F.col("next").alias("component_id"))
        if not after.where("component_id <> next").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that these join are walked through."""
    joins = written(across(links, labels, keep="ca, cb").selectExpr("least(ca, cb) as a", "greatest(ca, cb) as b").distinct(), "joins")
    if not joins.limit(1).count():
        return labels
    roots = components(joins).select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("root"))
    alone = joins.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("component_id", F.col("doc_id"))
    known = labels.unionByName(alone.join(labels, "doc_id", "left_anti"))
    return written(known.join(roots, "component_id", "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id")), "labels")


def ends(pairs: DataFrame) -> DataFrame:
    """The documents of pairs."""
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def across(pairs: DataFrame, labels: DataFrame, keep: str = "a, b") -> DataFrame:
    """Pairs whose documents lie in different components."""
    both = pairs.join(labels.withColumnsRenamed({"doc_id": "a", "component_id": "ca"}), "a", "left").join(labels.withColumnsRenamed({"doc_id": "b", "component_id": "cb"}), "b", "left")
    return both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb").select(*keep.split(", "))


def links_in_blocks(large: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is left of large nodes, compared in full: links (a, b) across components, one for each document and component.

    Nodes that share documents make a cluster; its documents are dealt into blocks, and two
    blocks at a time count their common shingles by products of 0-1 matrices, some columns at a time.
    """
    star = large.join(large.groupBy("node").agg(F.min("doc_id").alias("a")), "node").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()
    clusters = components(star).withColumnRenamed("component_id", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    at = clusters.join(sizes, "cluster").join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).join(sets, "doc_id")
    at = at.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        n = np.array([len(x.as_buffer()) // 8 for x in t["shingles"]], np.int64)
        blobs = t["doc_id"].to_numpy(), t["component_id"].to_numpy(), n, np.frombuffer(b"".join(t["shingles"].to_pylist()), U64)
        return pa.table({"cluster": [key[0].as_py()], "block": [key[1].as_py()], "blocks": [t["blocks"][0].as_py()], **{f"x{i}": pa.array([x.tobytes()], pa.binary()) for i, x in enumerate(blobs)}})

    packed = written(at.groupBy("cluster", "block").applyInArrow(pack, "cluster long, block long, blocks long, x0 binary, x1 binary, x2 binary, x3 binary"), "blocks")
    left = packed.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = packed.select("cluster", F.col("block").alias("other"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(4)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = ([np.frombuffer(row[f"{c}{i}"], kind) for i, kind in enumerate((np.int64, np.int64, np.int64, U64))] for c in "xy")
                columns = np.intersect1d(x[3], y[3])
                common = np.zeros((len(x[0]), len(y[0])), np.float32)
                for first in range(0, len(columns), 4096):
                    part = columns[first : first + 4096]
                    sides = []
                    for ids, _, n, shingles in (x, y):
                        at = np.minimum(np.searchsorted(part, shingles), len(part) - 1)
                        hit = part[at] == shingles
                        ones = np.zeros((len(ids), len(part)), np.float32)
                        ones[np.repeat(np.arange(len(ids)), n)[hit], at[hit]] = 1
                        sides.append(ones)
                    common += sides[0] @ sides[1].T
                whole = x[2][:, None] + y[2][None] - common
                i, j = np.nonzero((100 * common >= percent * whole) & (x[1][:, None] != y[1][None]))
                once = np.union1d(np.unique(np.column_stack((i, y[1][j])), axis=0, return_index=True)[1], np.unique(np.column_stack((j, x[1][i])), axis=0, return_index=True)[1])
                ends = np.sort(np.column_stack((x[0][i[once]], y[0][j[once]])), axis=1) if len(i) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return left.join(right, ["cluster", "other"]).repartition("cluster", "block", "other").select(*[f"x{i}" for i in range(4)], *[f"y{i}" for i in range(4)]).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, trees: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.where("doc_id is not null")
    all_sets = written(signatures(docs, words), "sets")
    key = ["digest1", "digest2", "n_shingles"]
    firsts = all_sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    classes = written(all_sets.where("n_shingles > 0").join(firsts.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "tokens"), "classes")
    least = int(TOKENS * percent / 100 - 4 * (TOKENS * percent * (100 - percent)) ** 0.5 / 100)  # four deviations below

    members = written(counted(roots(classes, trees)).join(classes, "doc_id").withColumn("component_id", F.col("doc_id")), "members")
    small, large = members.where(F.col("n") <= LEAF), members.where(F.col("n") > LEAF)
    star = written(stars(large, classes, least), "stars")
    # First one partner of each document.
    one = partners_of(small, least).unionByName(star).groupBy("doc_id").agg(F.max_by("other", F.struct(F.least("same", F.lit(SURE)), -F.col("other"))).alias("other"))
    one = written(one.selectExpr("least(doc_id, other) as a", "greatest(doc_id, other) as b").distinct(), "partners")
    labels = components(written(confirmed(one, written(full_sets(docs, ends(one), words), "full"), percent), "links"))
    # Then what still lies in different components: the best candidate of any two of them, and all of those left after it.
    star = star.select(F.col("doc_id").alias("a"), F.col("other").alias("b"), "same")
    small, star = written(mixed(small, labels), "small"), written(across(star, labels, "a, b, same, ca, cb"), "stars")
    if small.limit(1).count() or star.limit(1).count():
        sets = written(full_sets(docs, small.select("doc_id").union(ends(star)).distinct(), words), "full")
        best = between(small, least).unionByName(star.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "a", "b", "same"))
        best = best.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("same", -F.col("a"), -F.col("b"))).alias("m")).select("m.*")
        labels = merged(labels, written(confirmed(best, sets, percent), "links"))
        rest = pairs_of(mixed(small, labels), least).unionByName(across(star.select("a", "b"), labels)).selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
        labels = merged(labels, written(confirmed(rest, sets, percent), "links"))
    # Large nodes go on while they hold several components; only pairs across these are of use.
    large = written(mixed(large, labels), "large")
    sets = written(full_sets(docs, large.select("doc_id").distinct(), words), "full")
    found = []
    for level in range(MORE + 1):
        if not large.limit(1).count():
            break
        found.append(links_of(large.where(F.col("n") <= MID), sets, least, percent))
        large = large.where(F.col("n") > MID)
        if level < MORE and large.limit(1).count():
            large = written(mixed(counted(branched(large)), labels), f"level{level}")
    if found:
        labels = merged(labels, written(reduce(DataFrame.unionByName, found), "links"))
        large = mixed(large, labels)
        if large.limit(1).count():
            large = written(large.select("node", "doc_id"), "rest")
            labels = merged(labels, written(links_in_blocks(large, labels, sets, percent), "links"))
    of_class = firsts.join(labels.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select(*key, F.coalesce("component_id", "class_id").alias("component_id"))
    out = all_sets.select("doc_id", *key).join(of_class, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
