"""Operator 11: whitening of vectors by shifted Cholesky QR.

Vectors become whole numbers x (a fixed grid), so their sums are exact. The centred
rows X are never gathered: each pass sums a Gram matrix over all rows, and its
Cholesky factor R makes the rows of the next pass, X R^-1, by triangular solves
inside the tasks. The first Gram matrix is shifted by Fukaya's bound, so that
rounding cannot spoil its factor; passes go on until the rows are orthonormal. X is
then Q times the product of all factors, and the singular value decomposition of
that product (d x d) has the components, with their variances, without the squaring
of the condition that a covariance has.

Rows of a fixed diagonal, a 1e-10th of the data's size, are added to X: they keep the
factors of full rank where the data are not (fewer vectors than dimensions, constant
or repeated dimensions), turn no component and are taken out of the variances again.
Components without variance beyond rounding cannot be whitened and are left out.

Left out are rows whose vector is null or holds null or non-finite entries, entries of
2**43 or more (no double has their x) among these, and vectors whose length is not the
commonest (of equally common ones the shorter); empty vectors have no components.
Repeated rows count and are returned as often as they are there, null vec_ids like any
other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid and offset of the whole numbers.
GRID, OFFSET = 1024, 100_000
BIGGEST = float(2**43)
#: Size of the added rows, as a part of the data's norm.
RIDGE = 1e-10
#: Variances below this part of the largest are rounding.
LEAST = 1e-13
CHUNK = 1 << 20  # entries worked on at a time
EPS = np.finfo(np.float64).eps


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and v (doubles) of the rows that take part, and their dimension (0 if there are none)."""
    v = F.col(column).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(BIGGEST)))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))
    commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = commonest["d"] if commonest else 0
    return rows.where(F.size("v") == d), d


def whole(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their whole numbers, one row a vector."""
    step = max(1, CHUNK // max(1, d))
    for first in range(0, batch.num_rows, step):
        part = batch.slice(first, step)
        c = part.column("v").flatten().to_numpy().reshape(part.num_rows, d)
        yield part, np.floor(c * GRID).astype(np.int64) + OFFSET


def solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor in turn, by substitution."""
    for r in factors:
        for j in range(r.shape[0]):
            if j:
                y[:, j] -= y[:, :j] @ r[:j, j]
            y[:, j] /= r[j, j]
    return y


def summed(rows: DataFrame, d: int, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of an array of that shape: each task adds up its own, Spark adds these by entry."""
    dtype, entries = np.int64 if kind == "long" else np.float64, int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            for _, x in whole(batch, d):
                total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(entries)), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(entries, dtype)
    for r in rows.select("v").mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many as the shape has
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def totals(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each dimension, exactly."""
    found = summed(rows, d, (d + 1,), lambda x: np.append(x.sum(0), len(x)), "long")
    return int(found[d]), found[:d]


def factorised(rows: DataFrame, d: int, n: int, mean: np.ndarray, most: int = 12) -> tuple[np.ndarray, float]:
    """The triangular factor R of the centred rows with a diagonal of ``mu`` added below them, and mu."""
    factors: list[np.ndarray] = []
    r, mu = np.eye(d), 0.0
    for _ in range(most):

        def gram(x: np.ndarray, factors: list[np.ndarray] = factors) -> np.ndarray:
            q = solved(x - mean, factors)
            return q.T @ q

        g = summed(rows, d, (d, d), gram)
        if not factors:
            mu = RIDGE * float(np.sqrt(np.trace(g)))
            if not mu > 0:
                return np.zeros((d, d)), 0.0  # all rows are equal
        below = solved(mu * np.eye(d), factors)
        g += below.T @ below
        near = np.abs(g - np.eye(d)).max() < 0.5
        shift = 0.0 if near else 11 * (n * d + d * (d + 1)) * EPS * float(np.trace(g))
        factors = [*factors, np.linalg.cholesky(g + min(shift, 0.01 * float(np.trace(g))) * np.eye(d)).T]
        r = factors[-1] @ r
        if near:
            return r, mu
    raise RuntimeError("the rows have not become orthonormal")


def components(rows: DataFrame, d: int, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """Number of rows, sums, component vectors (d x k), their variances, and the trace of the covariance."""
    n, sums = totals(rows, d) if d else (0, np.zeros(0, np.int64))
    if not n:
        return 0, sums, np.zeros((d, 0)), np.zeros(0), 0.0
    r, mu = factorised(rows, d, n, sums / n)
    _, size, turned = np.linalg.svd(r)
    variance = np.maximum(size**2 - mu**2, 0) / n
    k = int(min(most, (variance > LEAST * variance[0]).sum()))
    vectors = turned[:k].T
    at = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[at, np.arange(k)] < 0, -1.0, 1.0)
    return n, sums, vectors, variance[:k], float(variance.sum())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 of each row, exactly."""
    away = n * x - sums if n * (int(np.abs(x).max(initial=0)) + 1) < 2**62 else None
    if away is not None and x.shape[1] * int(np.abs(away).max(initial=0)) ** 2 < 2**63:
        return pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums))) for row in x], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, column: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every usable row and component."""
    rows, d = usable(vectors, column)
    n, sums, turn, variance, trace = components(rows, d, most)
    k = len(variance)
    mean = sums / max(n, 1)
    scaled = turn / np.sqrt(variance)
    error = float("nan")
    if k:

        def products(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ scaled
            return np.column_stack((w.T @ w, w.sum(0)))

        found = summed(rows, d, (k, k + 1), products) / n
        error = float(np.abs(found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k)).max())
    explained = variance / trace if trace else variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in whole(batch, d) if k else ():
                m = len(x)
                rows_of = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(rows_of),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        deviations(x, n, sums).take(rows_of),
                        pa.array(((x - mean) @ scaled).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op11_query(spark, sf_dir: str) -> DataFrame:
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
