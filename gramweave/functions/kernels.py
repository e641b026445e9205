"""NumPy kernels without Spark: spectra, node contributions, quality control and a kernel support-vector machine."""

from __future__ import annotations

import numpy as np


def spectrum_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|eigenvalues| of a - b for stacks [pairs, n, n] of symmetric matrices (GEO2)."""
    return np.abs(np.linalg.eigvalsh(a - b))


def eigenvalues3(xx: np.ndarray, yy: np.ndarray, zz: np.ndarray, xy: np.ndarray, xz: np.ndarray, yz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of symmetric 3 x 3 matrices given by their cells, in rising order, in closed form: some 20 times less work than a solver's.

    Two that nearly coincide may be off by 1e-8 of the matrix's size each, in opposite directions, so sums of their powers are not.
    """
    q = (xx + yy + zz) / 3
    xx, yy, zz = xx - q, yy - q, zz - q
    r = np.sqrt((xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    cube = 2 * r * r * r
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(cube > 0, det / cube, np.where(np.isnan(cube), np.nan, 1.0))
    phi = np.arccos(np.clip(ratio, -1.0, 1.0)) / 3
    big, small = 2 * r * np.cos(phi), 2 * r * np.cos(phi + 2 * np.pi / 3)
    return q + small, q - big - small, q + big


def lowrank_system(fs: np.ndarray, ft: np.ndarray, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero eigenvalues of Fs Fs' - Ft Ft' and their vectors, from the small Gram matrix of [Fs, Ft] (GEO3)."""
    u = np.concatenate([fs, ft], axis=1)
    g, v = np.linalg.eigh(u.T @ u)
    keep = g > tol * max(float(g.max(initial=0.0)), 1.0)
    root = np.sqrt(g[keep])
    v = v[:, keep]
    sign = np.r_[np.ones(fs.shape[1]), -np.ones(ft.shape[1])]
    values, w = np.linalg.eigh(root[:, None] * (v.T @ (sign[:, None] * v)) * root[None, :])
    return values, (u @ v / root) @ w


def spectra_lowrank(fs: np.ndarray, ft: np.ndarray, tol: float = 1e-11) -> np.ndarray:
    """|eigenvalues| for stacks [pairs, n, r] of factors; modes of the Gram matrix that are dropped give zeros."""
    u = np.concatenate([fs, ft], axis=2)
    g, v = np.linalg.eigh(np.einsum("mni,mnj->mij", u, u))
    root = np.sqrt(np.where(g > tol * np.maximum(g.max(axis=1, keepdims=True), 1.0), g, 0.0))
    sign = np.r_[np.ones(fs.shape[2]), -np.ones(ft.shape[2])]
    inner = np.einsum("mki,k,mkj->mij", v, sign, v)
    return np.abs(np.linalg.eigvalsh(root[:, :, None] * inner * root[:, None, :]))


def spectra_rank_one(uu: np.ndarray, vv: np.ndarray, uv: np.ndarray) -> list[np.ndarray]:
    """``spectra_lowrank`` of factors of rank one in closed form, from |u|^2, |v|^2 and <u, v>: the larger and the smaller of the two."""
    gap = np.abs(uu - vv)
    root = np.sqrt(gap * gap + 4 * np.maximum(uu * vv - uv * uv, 0.0))
    return [(root + gap) / 2, (root - gap) / 2]


def schatten(sigma: np.ndarray, p: float) -> np.ndarray:
    """(sum sigma**p)**(1/p) along the last axis; the maximum for p = inf (GEO5)."""
    if not p >= 1:
        raise ValueError(f"p is {p}; Schatten distances need p >= 1")
    if np.isinf(p):
        return sigma.max(axis=-1, initial=0.0)
    return (sigma**p).sum(axis=-1) ** (1 / p)


def _power(x: np.ndarray, p: float) -> np.ndarray:
    """x**p for x >= 0, by products and roots where p is a small multiple of a half."""
    if not (2 * p).is_integer() or p > 64:
        return x**p
    out, square = (np.sqrt(x) if p % 1 else None), x
    for bit in bin(int(p))[:1:-1]:
        if bit == "1":
            out = square if out is None else out * square
        square = square * square
    return out


def schatten_of(sigma: list[np.ndarray], p: float) -> np.ndarray:
    """``schatten`` of singular values that lie in one array each."""
    if not p >= 1:
        raise ValueError(f"p is {p}; Schatten distances need p >= 1")
    if np.isinf(p):
        return np.maximum.reduce(sigma)
    total = sum(_power(x, p) for x in sigma[1:]) + _power(sigma[0], p)
    while p > 1 and p % 2 == 0:
        total, p = np.sqrt(total), p / 2
    return total if p == 1 else total ** (1 / p)


def contributions(values: np.ndarray, vectors: np.ndarray, grid: list[float]) -> np.ndarray:
    """First-order change of the Schatten distance when a node is left out, [p, node], from the eigensystem of the difference (XAI1, XAI2)."""
    diagonal = (vectors**2) @ values
    size = np.abs(values)
    out = np.zeros((len(grid), vectors.shape[0]))
    for i, p in enumerate(grid):
        d = schatten(size, p)
        if d > 0:
            ratio = (size / d) ** (p - 1) if p > 1 else np.ones_like(size)
            ratio = np.where(size > 0, ratio, 0.0)
            out[i] = 2 * (vectors**2) @ (size * ratio) - diagonal * ((vectors**2) @ (np.sign(values) * ratio))
    return out


def contributions_of(d: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Schatten distances [pairs] and ``contributions`` [pairs, node] of a stack of differences [pairs, n, n].  At p = 2 both are sums over cells: no eigensystem is made."""
    diagonal = np.einsum("mii->mi", d)
    if p == 2:
        square = (d * d).sum(axis=2)
        size, whole = np.sqrt(square.sum(axis=1)), 2 * square - diagonal * diagonal
        return size, np.where(size[:, None] > 0, whole / np.where(size > 0, size, 1.0)[:, None], 0.0)
    values, vectors = np.linalg.eigh(d)
    sigma = np.abs(values)
    size = schatten(sigma, p)
    ratio = (sigma / np.where(size > 0, size, 1.0)[:, None]) ** (p - 1) if p > 1 else np.ones_like(sigma)
    ratio = np.where((sigma > 0) & (size[:, None] > 0), ratio, 0.0)
    weight = vectors**2
    return size, 2 * np.einsum("mik,mk->mi", weight, sigma * ratio) - diagonal * np.einsum("mik,mk->mi", weight, np.sign(values) * ratio)


def quality(a: np.ndarray) -> tuple[float, float, float, int]:
    """Least and largest eigenvalue, trace and numeric rank (eigenvalues over 1e-10) of a symmetric matrix (OPR3, OPR8)."""
    e = np.linalg.eigvalsh((a + a.T) / 2)
    return float(e[0]), float(e[-1]), float(np.trace(a)), int((e > 1e-10).sum())


def fit_svc(k: np.ndarray, y: np.ndarray, c: float, tol: float = 1e-3, limit: int | None = None, alpha: np.ndarray | None = None) -> tuple[np.ndarray, float, bool]:
    """C-SVC on a precomputed kernel (LRN4): signed dual coefficients, intercept, and whether the optimality gap fell below ``tol``.

    Sequential minimal optimisation with second-order working sets, until the gap is closed or after ``limit`` steps, by default
    libsvm's: 10,000,000 or 100 a row, if that is more.  y is 0 or 1; ``alpha`` (unsigned) warm-starts the duals.
    """
    n, s = len(y), np.where(y > 0, 1.0, -1.0)
    a = np.zeros(n) if alpha is None else np.clip(alpha, 0, c)
    if alpha is not None and abs(s @ a) > 1e-9:
        a = np.zeros(n)
    grad = s * (k @ (a * s)) - 1.0
    diagonal = np.diag(k)
    done = False
    for _ in range(max(10_000_000, 100 * n) if limit is None else limit):
        violation = -s * grad
        up = ((s > 0) & (a < c - 1e-12)) | ((s < 0) & (a > 1e-12))
        low = ((s < 0) & (a < c - 1e-12)) | ((s > 0) & (a > 1e-12))
        if not up.any() or not low.any():
            done = True
            break
        i = int(np.argmax(np.where(up, violation, -np.inf)))
        if violation[i] - np.where(low, violation, np.inf).min() < tol:
            done = True
            break
        gap = violation[i] - violation
        curve = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap**2 / curve, -np.inf)))
        step = gap[j] / curve[j]
        room_i = c - a[i] if s[i] > 0 else a[i]
        room_j = a[j] if s[j] > 0 else c - a[j]
        step = min(step, room_i, room_j)
        a[i] += s[i] * step
        a[j] -= s[j] * step
        grad += s * step * (k[i] - k[j])
    return a * s, _bias(a, s, grad, c), done


def _bias(a: np.ndarray, s: np.ndarray, grad: np.ndarray, c: float) -> float:
    """The intercept: the mean over free duals, or the middle of what the bounds leave."""
    free = (a > 1e-9) & (a < c - 1e-9)
    violation = -s * grad
    if free.any():
        return float(violation[free].mean())
    up = ((s > 0) & (a < c)) | ((s < 0) & (a > 0))
    low = ((s < 0) & (a < c)) | ((s > 0) & (a > 0))
    return float((violation[up].max(initial=-1e300) + violation[low].min(initial=1e300)) / 2) if up.any() and low.any() else 0.0


def fit_svc_many(k: np.ndarray, group: np.ndarray, y: np.ndarray, train: np.ndarray, c: float, tol: float = 1e-3, limit: int | None = None, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_svc`` of many machines at once: one on each row of ``train``, the members of a training set, with the kernel ``k[group]``.

    The machines take their steps together, so a step costs a few array operations for all of them, and one whose gap is closed drops out.  Gives signed
    duals (0 outside the training set), intercepts and whether the gaps were closed.
    """
    s = np.where(y > 0, 1.0, -1.0)
    a = np.zeros(train.shape) if alpha is None else np.where(train, np.clip(alpha, 0, c), 0.0)
    a[np.abs(a @ s) > 1e-9] = 0.0
    grad = np.empty_like(a)
    for g in np.unique(group):
        own = group == g
        grad[own] = s * ((a[own] * s) @ k[g]) - 1.0
    diagonal = np.einsum("gii->gi", k)
    duals, bias, done = np.zeros_like(a), np.zeros(len(a)), np.zeros(len(a), bool)
    live, positive = np.arange(len(a)), s > 0
    limit = max(10_000_000, 100 * len(y)) if limit is None else limit

    def keep(gone: np.ndarray) -> None:
        for row in np.flatnonzero(gone):
            members = train[row]
            duals[live[row]] = a[row] * s
            bias[live[row]] = _bias(a[row, members], s[members], grad[row, members], c)

    for _ in range(limit):
        if not len(live):
            break
        rows = np.arange(len(live))
        above, below = a > 1e-12, a < c - 1e-12
        violation = -s * grad
        reach = np.where(train & np.where(positive, below, above), violation, -np.inf)
        low = train & np.where(positive, above, below)
        i = reach.argmax(axis=1)
        top = reach[rows, i]
        gone = ~(top - np.where(low, violation, np.inf).min(axis=1) >= tol)
        if gone.any():
            keep(gone)
            done[live[gone]] = True
            a, grad, train, group, live = (x[~gone] for x in (a, grad, train, group, live))
            continue
        ki = k[group, i]
        gap = top[:, None] - violation
        curve = np.maximum(diagonal[group, i][:, None] + diagonal[group] - 2 * ki, 1e-12)
        j = np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax(axis=1)
        si, sj, ai, aj = s[i], s[j], a[rows, i], a[rows, j]
        step = np.minimum(np.minimum(gap[rows, j] / curve[rows, j], np.where(si > 0, c - ai, ai)), np.where(sj > 0, aj, c - aj))
        a[rows, i] = ai + si * step
        a[rows, j] = aj - sj * step
        grad += s * step[:, None] * (ki - k[group, j])
    keep(np.ones(len(live), bool))
    return duals, bias, done


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean."""
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[at]


def rank_correlation(x: np.ndarray, y: np.ndarray, least: int = 3) -> float | None:
    """Spearman; None for fewer than ``least`` values or a constant side."""
    if len(x) < least:
        return None
    a, b = average_ranks(x), average_ranks(y)
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / size if size > 0 else None


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """ROC area with ties counted half; NaN with one class."""
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return float("nan")
    return float((average_ranks(score)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
