"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from wardwise.llm.qr_whitening import op11_query, whitened

SCHEMA = "vec_id long, embedding array<float>, whitened int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def plain(x):
    """Variances, components and their share, from the covariance of the whole numbers."""
    whole = np.floor(x.astype(np.float64) * 1024) + 100000
    centred = whole - whole.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return centred, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("n, d", [(400, 12), (60, 3), (5, 9)])
def test_components_are_those_of_the_covariance(spark, n, d):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, d)) @ np.diag(0.5 ** np.arange(d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 3).astype(np.float32)
    x[1] = x[0]  # repeated rows count
    left_out = [(None, None), (900, [float("nan")] * d), (901, [None] + [1.0] * (d - 1)), (902, [float("inf")] * d), (903, [1.0] * (d + 1)), (904, [3e38] * d), (905, [])]
    rows = [(None if i == 2 else i, [float(c) for c in v]) for i, v in enumerate(x)]
    out = whitened(table(spark, rows + left_out)).collect()
    centred, e, v = plain(x)
    k = min(8, d, n - 2 if n <= d else d)  # one row is there twice
    assert len(out) == n * k and {r.n for r in out} == {n}
    by = {(r.vec_id, r.component): r for r in out}
    assert {c for _, c in by} == set(range(1, k + 1))
    for c in range(k):
        got = np.array([by[None if i == 2 else i, c + 1].whitened for i in range(n)])
        want = centred @ v[:, c] / np.sqrt(e[c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert abs(by[0, c + 1].explained / (e[c] / e.sum()) - 1) < 1e-9
    whole = [[int(np.floor(float(c) * 1024)) + 100000 for c in v] for v in x]
    sums = [sum(col) for col in zip(*whole)]
    for i in range(n):
        assert int(by[None if i == 2 else i, 1].deviation) == sum((n * a - s) ** 2 for a, s in zip(whole[i], sums))
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def test_dimensions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    x = [(i, [float(t), float(t), 7.0, float(u)]) for i, (t, u) in enumerate(zip(a, rng.normal(size=200) * 1e-2))]
    out = whitened(table(spark, x)).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    assert abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-9


def test_tables_that_have_nothing_to_whiten(spark):
    assert whitened(table(spark, [])).collect() == []
    assert whitened(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitened(table(spark, [(1, [1.0, 2.0])])).collect() == []  # no variance
    assert whitened(table(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect() == []


def test_deviations_beyond_a_long_are_exact(spark):
    x = [(1, [4e12, 1.0]), (2, [-4e12, 0.0])]
    out = whitened(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    assert {int(r.deviation) for r in out} == {(2 * 1024 * 4 * 10**12) ** 2 + 1024**2}


def test_registered_query(spark):
    out = op11_query(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert out.count() == 8 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
