import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramweave.functions import kernels


def population(seed, n=6, rank=3, count=3):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        x = r.normal(size=(n, rank))
        out.append(x / np.sqrt((x * x).sum()))
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_distances(seed):
    f, g, h = population(seed)
    a, b, c = (x @ x.T for x in (f, g, h))
    sv = kernels.spectrum_dense(a[None], b[None])[0]
    values, vectors = kernels.lowrank_system(f, g)
    assert np.allclose(np.sort(np.abs(values))[::-1], np.sort(sv)[::-1][: len(values)], atol=1e-9)
    assert np.allclose(np.sort(kernels.spectra_lowrank(f[None], g[None])[0]), np.sort(sv)[-6:], atol=1e-9)
    grid = [1.0, 1.5, 2.0, 4.0, 16.0, np.inf]
    d = [kernels.schatten(sv, p) for p in grid]
    assert all(x >= y - 1e-12 for x, y in zip(d, d[1:], strict=False))
    assert np.isclose(d[2], np.linalg.norm(a - b))
    for p in grid[:-1]:
        assert kernels.schatten(sv, p) <= kernels.schatten(kernels.spectrum_dense(a[None], c[None])[0], p) + kernels.schatten(kernels.spectrum_dense(c[None], b[None])[0], p) + 1e-12
    dense = np.linalg.eigh(a - b)
    assert np.allclose(kernels.contributions(values, vectors, grid[:-1]), kernels.contributions(*dense, grid[:-1]), atol=1e-8)
    with pytest.raises(ValueError):
        kernels.schatten(sv, 0.5)


def test_contribution_is_the_gradient():
    f, g, _ = population(3)
    delta = f @ f.T - g @ g.T
    for p in (1.0, 2.0, 3.0):
        c = kernels.contributions(*np.linalg.eigh(delta), [p])[0]
        for node in range(6):
            keep = np.ones((6, 6))
            eps = 1e-6
            keep[node] *= 1 - eps
            keep[:, node] *= 1 - eps
            keep[node, node] = 1 - eps
            moved = kernels.schatten(np.abs(np.linalg.eigvalsh(delta * keep)), p)
            assert np.isclose((kernels.schatten(np.abs(np.linalg.eigvalsh(delta)), p) - moved) / eps, c[node], atol=1e-4)


def test_support_vector_machine():
    r = np.random.default_rng(5)
    x = np.r_[r.normal(size=(40, 2)) - 1, r.normal(size=(40, 2)) + 1]
    y = np.r_[np.zeros(40, int), np.ones(40, int)]
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2))
    for c in (0.1, 1.0, 100.0):
        dual, bias, done = kernels.fit_svc(k, y, c)
        s = np.where(y > 0, 1, -1)
        assert done and abs(dual.sum()) < 1e-8 and (dual * s >= -1e-12).all() and (dual * s <= c + 1e-9).all()
        margin = s * (k @ dual + bias)
        free = (dual * s > 1e-6) & (dual * s < c - 1e-6)
        assert np.allclose(margin[free], 1, atol=5e-3)
        assert (margin[dual * s < 1e-9] > 1 - 5e-3).all()
    assert kernels.auc(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])) == 0.75
    assert np.isnan(kernels.auc(np.ones(2), np.ones(2)))


def test_support_vector_machine_runs_to_its_tolerance():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3)) * 0.02
    y = r.integers(0, 2, 300)
    k = np.exp(-100 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert not kernels.fit_svc(k, y, 1000.0, limit=20_000)[2]
    assert kernels.fit_svc(k, y, 1000.0)[2]


@pytest.mark.parametrize("n", [6, 25, 60])
def test_many_machines_are_each_as_one(n):
    """Every machine of a batch has the duals, intercept and verdict of its own fit; those of another kernel, training set or start are apart."""
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 2))
    y = (x[:, 0] + r.normal(size=n) > 0).astype(int)
    y[:2] = 0, 1
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    k = np.exp(-np.array([1e-4, 0.5, 1e3])[:, None, None] * d)
    group, fold = (v.ravel() for v in np.meshgrid(np.arange(3), np.arange(4), indexing="ij"))
    train = (np.arange(n)[None] % 4 != fold[:, None]) | (np.arange(n)[None] < 2)
    train[5] = y == 1
    start = None
    for c in (0.01, 1.0, 1000.0):
        duals, bias, done = kernels.fit_svc_many(k, group, y, train, c, alpha=start)
        for row in range(len(group)):
            own = np.flatnonzero(train[row])
            dual, b, closed = kernels.fit_svc(k[group[row]][np.ix_(own, own)], y[own], c, alpha=None if start is None else start[row, own])
            inner, signs = k[group[row]][np.ix_(own, own)], np.where(y[own] > 0, 1, -1)
            goal = lambda v: 0.5 * v @ inner @ v - v @ signs  # noqa: B023, E731
            # Both stop within the tolerance of the optimum; where rounding breaks a tie they may take other steps to it.
            assert abs(goal(duals[row, own]) - goal(dual)) <= 1e-3 * max(1, abs(goal(dual))) and not duals[row, ~train[row]].any()
            assert np.allclose(inner @ duals[row, own] + bias[row], inner @ dual + b, atol=5e-3) and done[row] == closed
            assert abs(duals[row].sum()) < 1e-8 * max(1, c) and (np.abs(duals[row]) <= c + 1e-12).all()
        start = np.abs(duals)
    short = kernels.fit_svc_many(k, group, y, train, 1000.0, limit=2)
    assert not short[2].all()
