"""Whitening against numpy's eigenvectors and exact sums on small tables."""

from fractions import Fraction

import numpy as np
import pytest

from sortdesk.llm import whitening as W
from sortdesk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(spark, rows, extra=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("x", "n", "v", "i", "component") if extra else ():
        df = df.withColumn(name, F.lit(name))
    return df


def checked(rows, got, components=4, scale=256):
    """The contract's columns, computed plainly from rows (id, vector)."""
    x = {(i, tuple(v)): [int(np.floor(scale * c)) for c in v] for i, v in rows}
    fit = sorted({tuple(w) for w in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(w[j] for w in fit) for j in range(d)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(w, sums)] for w in fit])
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(components, d)) if values[k] > 1e-12 * values.sum()]
    assert sorted((r.vec_id, r.component) for r in got) == sorted(
        (i, k + 1) for i, _ in rows for k in kept)
    by = {(r.vec_id, r.component): r for r in got}
    for k in kept:
        mine = np.array([by[i, k + 1].whitened for i, _ in rows])
        want = np.array([(np.array([float(Fraction(n * c - s, n)) for c, s in zip(x[i, tuple(v)], sums)])
                          @ vectors[:, k]) / np.sqrt(values[k]) for i, v in rows])
        if len(kept) == 1 or min(abs(values[k] - np.delete(values, k))) > 1e-3 * values[0]:
            sign = np.sign(mine @ want)
            assert np.allclose(mine, sign * want, atol=1e-8, rtol=1e-8)
    for i, v in rows:
        for k in kept:
            r = by[i, k + 1]
            assert r.n == n
            assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[i, tuple(v)], sums))
            assert abs(r.explained - values[k] / values.sum()) <= 1e-10 * r.explained
            assert 0 <= r.identity_error <= 1e-9
    assert len({r.identity_error for r in got}) == 1


@pytest.mark.parametrize("n,d,seed", [(300, 8, 1), (40, 64, 2), (3, 5, 3), (500, 2, 4)])
def test_components_match_numpy(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * (0.7 ** np.arange(d))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, d)) @ mix + 3)]
    rows += [(n + i, v) for i, (_, v) in enumerate(rows[:n // 3])]      # the same vectors again
    checked(rows, W.whiten(table(spark, rows, extra=True)).collect())


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet")
            .selectExpr("vec_id", "cast(embedding as array<double>)").collect()]
    checked(rows, QUERIES["op12_spectrum_slicing"](spark, SF).collect())


def test_close_pairs_and_large_offsets(spark):
    """Two nearly equal leading variances far from the origin."""
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 40, (400, 6)) + np.array([10 ** 7] * 6)
    x[:, 0] = 10 ** 7 + 30 * np.tile([1, -1], 200)
    x[:, 1] = 10 ** 7 + 30 * np.repeat([1, -1], 200)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(float))]
    got = W.whiten(table(spark, rows), scale=1).collect()
    checked(rows, got, scale=1)
    white = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]]).reshape(-1, 4)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 0.5   # repeated rows weigh more


def test_equal_eigenvalues(spark):
    """A cross: all variances equal, so any orthonormal vectors will do."""
    rows = [(2 * i + s, [3.0 * (1 - 2 * s) if j == i else 0.0 for j in range(5)])
            for i in range(5) for s in (0, 1)]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) == 40 and {round(r.explained, 9) for r in got} == {0.2}
    assert got[0].identity_error < 1e-9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [-3.0, 0.5]), (None, [0.0, 0.0]), (4, [-0.0, 7.25])]
    bad = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [])]
    got = W.whiten(table(spark, good + bad, extra=True)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted(
        (i or 0, k) for i, _ in good for k in (1, 2))
    assert {r.n for r in got} == {4}
    same = [r for r in got if r.vec_id in (1, 2) and r.deviation == got[0].deviation]
    assert len({(r.component, r.whitened) for r in same}) == 2


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert W.whiten(table(spark, rows)).collect() == []
    one = W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 5.0])])).collect()
    assert [(r.component, round(abs(r.whitened), 12)) for r in one] == [(1, 1.0), (1, 1.0)]


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, -2.0])]
    got = {(r.vec_id, r.component): r for r in W.whiten(table(spark, rows)).collect()}
    assert {i for i, _ in got} == {1, 2, 3}
    assert got[1, 1].deviation is None
    assert all(np.isfinite(r.whitened) for r in got.values())


def test_counts_match_eigenvalues():
    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*rng.uniform(-8, 8, 10), 0.0]:
            assert W.count_above(a, shift) == (values > shift).sum()
    assert W.count_above(np.zeros((3, 3)), 0.0) == 0
    assert W.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_leading_components_of_clusters():
    """Eigenvalues that differ by little or not at all keep their numbers."""
    rng = np.random.default_rng(9)
    basis = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    for values in ([5, 5 - 1e-9, 5 - 2e-9, 1], [7, 7, 7, 7], [3, 2, 2, 2], [1e6, 1, 1e-3, 1e-6]):
        full = np.array([*values, *np.linspace(0.5, 0, 16) * min(values)])
        matrix = (basis * full) @ basis.T
        matrix = (matrix + matrix.T) / 2
        found = W.leading_components(matrix, 4)
        assert np.allclose([e for e, _ in found], values, rtol=1e-12, atol=1e-9)
        axes = np.array([v for _, v in found])
        assert np.allclose(axes @ axes.T, np.eye(4), atol=1e-12)
        assert np.allclose(matrix @ axes.T, axes.T * [e for e, _ in found], atol=1e-8 * max(values))
