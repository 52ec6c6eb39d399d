"""Whitening against numpy's eigenvectors, and its defined cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

ROWS = "vec_id long, embedding array<float>, label int, whitened string, _x int"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 1, "old", 5) for k, v in enumerate(vectors)], ROWS).repartition(5)


def test_jacobi_against_numpy():
    from tidemark.llm.whitening import jacobi

    rng = np.random.default_rng(1)
    for shape in ((9, 7), (6, 6), (1, 1), (3, 5)):
        a = rng.normal(size=shape) * np.logspace(0, -6, shape[1])
        sigma, v = jacobi(a)
        want = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(sigma[: len(want)], want, rtol=1e-10, atol=1e-15)
        assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)


def test_whitening_against_brute_force(spark, monkeypatch):
    from tidemark.llm import whitening
    from tidemark.llm.whitening import fit_whitening, whitened

    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(80, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1]) @ rng.normal(size=(6, 6))).astype(np.float32).tolist()
    odd = [None, [], [1.0], [math.nan] * 6, [math.inf] + [0.0] * 5, [None] + [0.0] * 5]
    vectors = base + base[:7] + [base[0]] * 30 + odd
    df = table(spark, vectors)
    model = fit_whitening(df)
    x = {k: np.floor(256.0 * np.array(v, dtype=float)).astype(int) for k, v in enumerate(vectors) if k < len(vectors) - len(odd)}
    fit = np.array(sorted({tuple(r) for r in x.values()}))
    n, sums = len(fit), fit.sum(0)
    cov = (fit - sums / n).T @ (fit - sums / n) / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    got = {r.vec_id: r for r in whitened(df, model).collect()}
    assert set(got) == set(x) and model.n == n and model.sums == sums.tolist()
    assert np.allclose(model.explained[:4], e[:4] / cov.trace(), rtol=1e-9) and model.identity_error < 1e-9
    signs = np.sign((vec * model.components).sum(0))
    for k, r in got.items():
        assert r.deviation == int(((n * x[k] - sums) ** 2).sum())
        assert np.allclose(r.whitened, ((x[k] - sums / n) @ (vec * signs) / np.sqrt(e))[:4], atol=1e-8)


def test_whitening_without_variance(spark):
    from tidemark.llm.whitening import fit_whitening, whitened

    same = table(spark, [[1.0, 2.0]] * 4)
    model = fit_whitening(same)
    assert model.n == 1 and [r.whitened for r in whitened(same, model).collect()] == [[None, None]] * 4
    line = table(spark, [[float(k), 2.0 * k] for k in range(5)])
    model = fit_whitening(line)
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in whitened(line, model).collect()) and model.explained[1] == 0
    none = table(spark, [None])
    assert whitened(none, fit_whitening(none)).count() == 0
    empty = same.limit(0)
    assert whitened(empty, fit_whitening(empty)).columns == ["vec_id", "embedding", "label", "_x", "deviation", "whitened"]


def test_deviations_are_exact_or_null():
    from tidemark.llm.whitening import deviations

    x = np.array([[3, -2], [1 << 40, 5]])
    assert deviations(x, 1000, [7, 9]) == [(3000 - 7) ** 2 + (-2000 - 9) ** 2, None]


@pytest.mark.parametrize("size", ["0.001"])
def test_op13_query(spark, size):
    from tidemark.llm.queries import QUERIES

    rows = QUERIES["op13_whitening"](spark, f"/root/testdata/sf{size}").toPandas()
    assert sorted(rows.component.unique()) == [1, 2, 3, 4] and (rows.identity_error < 1e-6).all()
    assert len(rows) == 4 * spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet").count()
