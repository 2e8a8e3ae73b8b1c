"""Whitening against plain arithmetic and a full eigendecomposition."""

import math
import random

import numpy as np
import pytest

from edgeprobe.llm import whiten


def plain_numbers(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in kept]
    return [i for i, _ in kept], x


def vectors(n, d, rng, rank=None):
    a = rng.standard_normal((n, rank or d)) @ (rng.standard_normal((rank or d, d)) * (0.9 ** np.arange(d)))
    return a.round(4).tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [*enumerate(vectors(400, 30, rng)), (900, None), (901, [1.0, None] + [0.0] * 28), (902, [math.nan] * 30), (903, [math.inf] * 30), (904, [0.5] * 12), (None, [0.25] * 30), (905, [])]
    rows += [rows[3]] * 60
    ids, x = plain_numbers(rows)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    got = whiten.by_component(frame(spark, rows).repartition(5)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 8 * n and set(got.n) == {n}
    centred = np.array([[(n * v - s) / n for v, s in zip(r, sums, strict=True)] for r in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    deviation = {i: sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in zip(ids, x, strict=True)}
    whitened = centred @ (u / np.sqrt(e))
    of = {i: w for i, w in zip(ids, whitened, strict=True)}
    first = got[got.vec_id == 5].set_index("component").whitened
    signs = np.array([np.sign(first[k + 1] * of[5][k]) for k in range(8)])
    for r in got.itertuples():
        i = None if r.vec_id != r.vec_id else int(r.vec_id)
        assert r.deviation == deviation[i]
        assert abs(r.whitened - signs[r.component - 1] * of[i][r.component - 1]) < 1e-9
        assert abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-10
        assert r.identity_error < 1e-10


def test_few_passes_when_values_fall(spark):
    """It ends by its residuals, long before the basis is full, and never forms the matrix."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    e = np.r_[100 * 0.5 ** np.arange(12), np.full(288, 1e-3)]
    a = (q * e) @ q.T
    values, axes, residuals, passes = whiten.block_lanczos(lambda b: a @ b, 300, 8, 16)
    assert passes <= 8 and residuals.max() <= 1e-13 * 100
    np.testing.assert_allclose(values, e[:8], rtol=1e-12)
    np.testing.assert_allclose(np.abs((axes * q[:, :8]).sum(axis=0)), 1, rtol=1e-12)


def test_breakdowns_restart():
    """A block that falls into an invariant subspace finds the others by random directions."""
    a = np.diag(np.r_[np.full(5, 3.0), np.full(5, 2.0), np.zeros(30)])
    values, axes, _, _ = whiten.block_lanczos(lambda b: a @ b, 40, 8, 8)
    np.testing.assert_allclose(values, [3] * 5 + [2] * 3, atol=1e-12)
    np.testing.assert_allclose(axes.T @ axes, np.eye(8), atol=1e-12)
    zero, _, _, _ = whiten.block_lanczos(lambda b: 0 * b, 6, 3, 4)
    assert np.abs(zero).max() == 0


@pytest.mark.parametrize("n,most", [(3, 2**10), (10**6, 2**20), (10**9, 2**40), (10**13, 2**50)])
def test_deviations_are_exact(n, most):
    rng = random.Random(n)
    sums = [rng.randrange(-most, most) * n + rng.randrange(n) for _ in range(40)]
    x = [[rng.randrange(-most, most) for _ in range(40)] for _ in range(20)]
    assert whiten.Centre(n, sums).deviations(np.array(x, np.int64)) == [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]


def test_odd_tables(spark):
    assert whiten.by_component(frame(spark, [])).collect() == []
    assert whiten.by_component(frame(spark, [(1, None)])).collect() == []
    assert whiten.by_component(frame(spark, [(1, [])])).collect() == []
    assert whiten.by_component(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []  # no variance
    got = whiten.by_component(frame(spark, [(1, [0.5, 0.1]), (2, [0.25, 0.1]), (3, [3e38, 0.1])])).collect()
    assert {r.component for r in got} == {1} and len(got) == 3
    low = whiten.by_component(frame(spark, [*enumerate(vectors(50, 20, np.random.default_rng(1), rank=3))]))
    assert {r.component for r in low.collect()} >= {1, 2, 3}
    own = spark.createDataFrame([("a", [0.5, 1.0], "x", 1), ("b", [0.0, 3.0], None, 2)], "vec_id string, embedding array<double>, whitened string, own int")
    out = whiten.whiten(own, whiten.fit(own))
    assert out.columns == ["vec_id", "own_whitened", "own", "whitened", "deviation"] and {r.own_whitened for r in out.collect()} == {"x", None}
