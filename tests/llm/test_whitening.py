"""Polarised covariance and whitened rows against numpy and exact integers."""

import os
import sys
from fractions import Fraction

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np  # noqa: E402
import pytest  # noqa: E402

from labeltide.llm.whitening import _exact_rows, _limbs, integer_vectors, polarised_sums, vector_sums, whiten_embeddings, whitening_report  # noqa: E402

NAN, INF = float("nan"), float("inf")


def vectors(n=120, d=20, seed=0):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d)) * 0.2 + rnd.normal(size=d)).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_against_numpy(spark):
    e = vectors()
    rows = [(k, v.tolist(), 1) for k, v in enumerate(e)] + [(500, e[3].tolist(), None), (500, e[3].tolist(), 2), (None, e[4].tolist(), 0)]
    bad = [(900, None, 0), (901, [NAN] + e[0].tolist()[1:], 0), (902, [None] + e[0].tolist()[1:], 0), (903, [INF] + e[0].tolist()[1:], 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    got = whitening_report(frame(spark, rows + bad)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = [[int(c // 1) + 1_000_000 for c in 64 * np.asarray(v, dtype=np.float64)] for _, v, _ in rows]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert n == 120 and len(got) == 16 * len(rows) and (got.n == n).all()
    cov = np.cov((np.array(fit) - np.array(fit).mean(axis=0)).T, bias=True)
    values, unit = np.linalg.eigh(cov)
    values, unit = values[::-1][:16], unit.T[::-1][:16]
    whitened = (np.array(x) - np.array(sums) / n) @ unit.T / np.sqrt(values)
    for (i, v, _), xi, w in zip(rows, x, whitened):
        mine = got[got.vec_id.isna() if i is None else got.vec_id == i].sort_values("component")
        assert (mine.deviation == sum((n * c - s) ** 2 for c, s in zip(xi, sums))).all()
        assert np.allclose(np.abs(mine.whitened.to_numpy()[-16:]) if i != 500 else np.abs(mine.whitened.to_numpy()[::2]), np.abs(w), atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first(), values / np.trace(cov), rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def test_polarised_sums_are_exact(spark):
    """Covariances from sums of squares equal those from products, as fractions; entries of very different size."""
    rows = [(k, [float(k % 7), 3.0e9 * (k % 5), -float(k) / 64, 1e-3 * k * k, 1e30], 0) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fit = integer_vectors(table).select("_x").distinct()
    x = [r["_x"] for r in fit.collect()]
    n, sums = vector_sums(fit, 5)
    assert n == len(x) == 40 and sums == [sum(c) for c in zip(*x)]
    assert sums[4] == 40 * ((1 << 47) + 1_000_000)  # held at the limit
    centre = np.array([s // n for s in sums])
    q, rest = polarised_sums(fit, centre, 5), [s % n for s in sums]
    for i in range(5):
        for j in range(i + 1, 5):
            var = lambda s, r: Fraction(n * s - r * r, n * n)
            both = var(q[i, j], rest[i] + rest[j]) - var(q[i, i], rest[i]) - var(q[j, j], rest[j])
            want = sum((v[i] - Fraction(sums[i], n)) * (v[j] - Fraction(sums[j], n)) for v in x) / n
            assert both / 2 == want


def test_limbs():
    values = [0, 1, -1, (1 << 62) + 5, -(1 << 63)]
    big = np.array(values + [1 << 90, -(1 << 100) - 3], dtype=object)
    for v in (np.array(values, dtype=np.int64), big):
        assert [sum(int(c) << 31 * k for k, c in enumerate(col)) for col in _limbs(v).T] == [int(a) for a in v]
    a = np.array([[1 << 40, -(1 << 41)]])
    assert list(_exact_rows(a, a)) == [(1 << 80) + (1 << 82)]


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0), (2, [], 1)], [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)]])
def test_nothing_to_whiten(spark, rows):
    """Empty tables, no vector, no dimension, no spread: no component, so no row of the report."""
    assert whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() == 0


def test_rows_keep_their_columns(spark):
    e = vectors(30, 3)
    table = spark.createDataFrame([(k, v.tolist(), "t", k, k) for k, v in enumerate(e)], "vec_id long, embedding array<float>, _x string, _v int, n int")
    out, fit, error = whiten_embeddings(table)
    rows = out.collect()
    assert out.columns == ["vec_id", "embedding", "_x", "_v", "n", "whitened", "deviation"] and len(rows) == 30
    assert fit.n == 30 and len(fit.eigenvalues) == 3 and error < 1e-9 and abs(fit.explained.sum() - 1) < 1e-12
    assert np.allclose(np.cov(np.array([r["whitened"] for r in rows]).T, bias=True), np.eye(3), atol=1e-9)


def test_flat_dimensions_have_no_component(spark):
    e = vectors(50, 3)
    rows = [(k, [*v.tolist(), 1.0, float(v[0])], 0) for k, v in enumerate(e)]
    out, fit, _ = whiten_embeddings(frame(spark, rows))
    assert len(fit.eigenvalues) == 3 and all(len(r["whitened"]) == 3 for r in out.collect())
