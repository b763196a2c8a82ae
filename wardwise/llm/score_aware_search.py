"""Operator 3: maximum inner product search with score-aware anisotropic codes.

A vector is cut into subspaces of two dimensions, each with 16 centres, so a code
is four bits. Error along the vector changes its largest inner products most, so
codebooks and codes minimise ``eta`` times the parallel part of the error plus the
rest. Codebooks are fitted on a sample of bounded size, then every vector gets its
code. Queries and candidates meet in blocks: a table of each query's products with
all centres, two codes a look-up, gives approximate scores of a block; the best of
them are scored exactly on the original vectors, in double precision, and the
blocks' best are merged by rank.

Vectors that are null, zero, hold null or non-finite components, or have another
length than most, take no part; candidates with the query's own vec_id are left
out; ties go to the smaller vec_id; fewer candidates than asked for give as many
rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CENTRES = 16
SAMPLE = 8192  # vectors that codebooks are fitted on, at most
BLOCK, QUERIES = 8192, 512  # rows of a candidate and of a query block
TOGETHER = 8  # query blocks that look through one copy of a candidate block
THRESHOLD = 0.2  # cosine above which inner products matter


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector as doubles, of rows that take part."""
    v = F.col(column).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).select("vec_id", v.alias("v")).where(good)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


class Codebooks:
    """centres: subspaces x 16 x 2; eta: weight of the parallel error."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
        return padded.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, passes: int = 3) -> np.ndarray:
        """Codes by descent over subspaces, each chosen with the others' parallel error at hand."""
        parts = self._split(x)
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        codes = ((parts[:, :, None] - self.centres[None]) ** 2).sum(3).argmin(2)
        error = parts - self.centres[np.arange(parts.shape[1]), codes]
        along = (error * unit).sum(2)
        total = along.sum(1)
        for _ in range(passes):
            for m in range(parts.shape[1]):
                rest = total - along[:, m]
                left = parts[:, m, None] - self.centres[m]
                parallel = (left * unit[:, m, None]).sum(2)
                cost = (left**2).sum(2) + (self.eta - 1) * (rest[:, None] + parallel) ** 2
                codes[:, m] = cost.argmin(1)
                along[:, m] = np.take_along_axis(parallel, codes[:, m, None], 1)[:, 0]
                total = rest + along[:, m]
        return codes.astype(np.uint8)

    def fit(self, x: np.ndarray, rounds: int = 6) -> None:
        parts = self._split(x)
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        for _ in range(rounds):
            codes = self.encode(x, 1)
            along = ((parts - self.centres[np.arange(parts.shape[1]), codes]) * unit).sum(2)
            total = along.sum(1)
            for m in range(parts.shape[1]):
                rest = total - along[:, m]
                u, p = unit[:, m], parts[:, m]
                for c in range(CENTRES):
                    own = codes[:, m] == c
                    if not own.any():
                        continue
                    a = own.sum() * np.eye(2) + (self.eta - 1) * u[own].T @ u[own]
                    b = p[own].sum(0) + (self.eta - 1) * u[own].T @ (rest[own] + (u[own] * p[own]).sum(1))
                    self.centres[m, c] = np.linalg.solve(a, b)
                along[:, m] = ((p - self.centres[m, codes[:, m]]) * u).sum(1)
                total = rest + along[:, m]

    def table(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with the centres of two subspaces at a time: queries x bytes x 256."""
        parts = self._split(queries)
        one = np.einsum("qmd,mcd->qmc", parts, self.centres)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), -1, 256).astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, by byte and row."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)


def fitted(sample: np.ndarray) -> Codebooks:
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(0)
    parts = np.pad(sample, ((0, 0), (0, d % 2))).reshape(len(sample), -1, 2)
    centres = np.stack([parts[rng.choice(len(parts), CENTRES, len(parts) < CENTRES), m] for m in range(parts.shape[1])])
    books = Codebooks(centres.astype(np.float64), eta)
    books.fit(sample)
    return books


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 160) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products found for each query. Both tables as from ``usable``."""
    spark = vectors.sparkSession
    common = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = common["d"]
    vectors, queries = vectors.where(F.size("v") == d), queries.where(F.size("v") == d)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    books = fitted(matrix(sample["v"]))
    blocks = vectors.count() // BLOCK + 1
    query_blocks = queries.count() // QUERIES + 1

    def encoded(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x = matrix(t["v"])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([t["vec_id"].to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "codes": pa.array([pack_codes(books.encode(x)).tobytes()], pa.binary())})

    def packed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return pa.table({"query_block": pa.array([key[0].as_py()], pa.int64()), "query_ids": pa.array([t["vec_id"].to_numpy().tobytes()], pa.binary()), "q": pa.array([matrix(t["v"]).tobytes()], pa.binary())})

    candidates = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).groupBy("block").applyInArrow(encoded, "block long, ids binary, x binary, codes binary")
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).groupBy("query_block").applyInArrow(packed, "query_block long, query_ids binary, q binary")
    # Candidates, which are many, are copied once for each ``TOGETHER`` query blocks; queries, which are few, once for each candidate block.
    last = (query_blocks - 1) // TOGETHER
    candidates = candidates.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    asked = asked.withColumn("part", F.expr(f"query_block div {TOGETHER}")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    meet = candidates.join(asked, ["part", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                x, q = np.frombuffer(row["x"]).reshape(len(ids), d), np.frombuffer(row["q"]).reshape(len(qids), d)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(ids))
                best_q, best_v, best_s = [], [], []
                for i in range(len(q)):
                    table = books.table(q[i : i + 1])[0]
                    score = table[0].take(codes[0])
                    for b in range(1, len(codes)):
                        score += table[b].take(codes[b])
                    score[ids == qids[i]] = -np.inf
                    # All that tie with the last one to be reranked are too: equal vectors have equal codes.
                    top = np.flatnonzero(score >= np.partition(score, -rerank)[-rerank]) if len(score) > rerank else np.arange(len(score))
                    top = top[ids[top] != qids[i]]
                    exact = (x[top] * q[i]).sum(1)  # row by row, so equal vectors have equal scores wherever they lie
                    top, exact = (y[np.lexsort((ids[top], -exact))[:k]] for y in (top, exact))
                    best_q.append(np.full(len(top), qids[i]))
                    best_v.append(ids[top])
                    best_s.append(exact)
                if best_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (best_q, best_v, best_s)], names=["query_id", "vec_id", "score"])

    found = meet.select("ids", "x", "codes", "query_ids", "q").mapInArrow(scan, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
