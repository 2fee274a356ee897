"""Covariance kernels and small matrices: as column expressions, and as numpy for whole batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: diagonal of a neighbour block, unit variance and a nugget.
DIAGONAL = 1.00001
SMOOTHNESS = (0.5, 1.5)


def _check(smoothness: float) -> None:
    if smoothness not in SMOOTHNESS:
        raise ValueError("smoothness must be 0.5 or 1.5")


def matern(d, smoothness: float = 1.5):
    """Matern correlation of a scaled distance, for a Column or an array."""
    _check(smoothness)
    exp = F.exp if isinstance(d, Column) else np.exp
    return exp(-d) if smoothness == 0.5 else exp(-d) * (1 + d)


def log_sum_exp(x: Column, y: Column) -> Column:
    """log(e^x + e^y) without overflow."""
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


# ----------------------------------------------------------------------------- symmetric matrices and exponentials


def symmat_places(length: int) -> np.ndarray:
    """Which coordinate each entry of a symmetric matrix is: its diagonal first, then its lower triangle, column by column."""
    n = (math.isqrt(8 * length + 1) - 1) // 2
    if n * (n + 1) // 2 != length:
        raise ValueError("length of coords incompatible with a symetric matrix")
    out = np.diag(np.arange(n))
    rows, cols = np.triu_indices(n, 1)  # (col, row) of the lower triangle, column-major
    out[cols, rows] = out[rows, cols] = np.arange(n, length)
    return out


def symmat(coords) -> np.ndarray:
    """The symmetric matrix of the coordinates, see symmat_places."""
    coords = np.asarray(coords, float)
    return coords[symmat_places(len(coords))]


def expmat(coords, eps: float = 1e-4) -> np.ndarray:
    """Matrix exponential of symmat(coords), eps added to the diagonal."""
    values, vectors = np.linalg.eigh(symmat(coords))
    return (vectors * np.exp(values)) @ vectors.T + eps * np.eye(len(values))


def derivative_chol_expmat(coords, eps: float = 1e-5) -> np.ndarray:
    """Forward differences of the upper Cholesky factor of expmat by each coordinate; last axis: coordinate."""
    coords = np.asarray(coords, float)
    upper = np.linalg.cholesky(expmat(coords)).T
    steps = []
    for k in range(len(coords)):
        moved = coords.copy()
        moved[k] += eps
        steps.append(1e5 * (np.linalg.cholesky(expmat(moved)).T - upper))
    return np.stack(steps, axis=2)


def derivative_field_wrt_scale(field, coords) -> np.ndarray:
    """Derivative of a field whose columns are scaled by the factor of expmat(coords), by each coordinate."""
    field = np.atleast_2d(np.asarray(field, float))
    white = field @ np.linalg.inv(np.linalg.cholesky(expmat(coords)).T)
    return np.einsum("ij,jkc->ikc", white, derivative_chol_expmat(coords))


def expm2(a: Column, c: Column, b: Column) -> tuple[Column, Column, Column]:
    """(xx, yy, xy) of the exponential of the 2 x 2 matrix [[a, b], [b, c]], in closed form."""
    mean, half = (a + c) / 2, (a - c) / 2
    delta = F.sqrt(half * half + b * b)
    ratio = F.when(delta > 1e-12, F.sinh(delta) / delta).otherwise(F.lit(1.0))
    scale = F.exp(mean)
    return scale * (F.cosh(delta) + ratio * half), scale * (F.cosh(delta) - ratio * half), scale * ratio * b


def expm2_np(a, c, b) -> np.ndarray:
    """The same for arrays: ... x 2 x 2."""
    mean, half = (a + c) / 2, (a - c) / 2
    delta = np.sqrt(half * half + b * b)
    ratio = np.where(delta > 1e-12, np.sinh(delta) / np.where(delta > 1e-12, delta, 1), 1.0)
    scale, ch = np.exp(mean), np.cosh(delta)
    xy = scale * ratio * b
    return np.stack([np.stack([scale * (ch + ratio * half), xy], -1), np.stack([xy, scale * (ch - ratio * half)], -1)], -2)


# ----------------------------------------------------------------------------- nonstationary covariances


def nonstat_iso(dx: Column, dy: Column, r1: Column, r2: Column, smoothness: float = 1.5, prefactor: str = "reference") -> Column:
    """Covariance of two points with squared ranges r1, r2; the default prefactor is the one-dimensional form."""
    mid = (r1 + r2) / 2
    power = (0.25, -0.5) if prefactor == "reference" else (0.5, -1.0)
    return F.pow(r1 * r2, F.lit(power[0])) * F.pow(mid, F.lit(power[1])) * matern(F.sqrt((dx * dx + dy * dy) / mid), smoothness)


def range_matrix(b1: Column, b2: Column, b3: Column) -> tuple[Column, Column, Column]:
    """(xx, yy, xy) of a point's squared range matrix from its determinant and anisotropy components."""
    return expm2(2 * (b1 + b2), 2 * (b1 - b2), 2 * b3)


def nonstat_aniso(dx, dy, s1, s2, smoothness: float = 1.5) -> Column:
    """Paciorek-Schervish covariance of two points with range matrices s1, s2, each (xx, yy, xy)."""
    det = lambda s: s[0] * s[1] - s[2] * s[2]
    mid = tuple((u + v) / 2 for u, v in zip(s1, s2))
    d = det(mid)
    q = (dx * dx * mid[1] - 2 * dx * dy * mid[2] + dy * dy * mid[0]) / d
    return F.pow(det(s1) * det(s2), F.lit(0.25)) * F.pow(d, F.lit(-0.5)) * matern(F.sqrt(F.greatest(q, F.lit(0.0))), smoothness)


def covariance(h: np.ndarray, f1: np.ndarray, f2: np.ndarray, smoothness: float, prefactor: str = "reference") -> np.ndarray:
    """Covariances of batches: h ... x 2 offsets, f1 and f2 ... x 1 (log squared range) or ... x 3
    (log range matrix: xx, yy, and xy times root two, so that the components have equal norms)."""
    if f1.shape[-1] == 1:
        r1, r2 = np.exp(f1[..., 0]), np.exp(f2[..., 0])
        mid = (r1 + r2) / 2
        front = np.sqrt(np.sqrt(r1 * r2) / mid) if prefactor == "reference" else np.sqrt(r1 * r2) / mid
        return front * matern(np.sqrt((h**2).sum(-1) / mid), smoothness)
    s1, s2 = (expm2_np(f[..., 0], f[..., 1], f[..., 2] / math.sqrt(2)) for f in (f1, f2))
    mid = (s1 + s2) / 2
    det = lambda s: s[..., 0, 0] * s[..., 1, 1] - s[..., 0, 1] ** 2
    d = det(mid)
    q = (h[..., 0] ** 2 * mid[..., 1, 1] - 2 * h[..., 0] * h[..., 1] * mid[..., 0, 1] + h[..., 1] ** 2 * mid[..., 0, 0]) / d
    return (det(s1) * det(s2)) ** 0.25 * d**-0.5 * matern(np.sqrt(np.maximum(q, 0)), smoothness)


def canonical_range(beta: np.ndarray) -> np.ndarray:
    """Coefficients in the (determinant, anisotropy) basis -> those of the log range as covariance() takes it."""
    beta = np.asarray(beta, float)
    if beta.shape[1] == 1:
        return 2 * beta
    return 2 * beta @ np.array([[1.0, 1.0, 0.0], [1.0, -1.0, 0.0], [0.0, 0.0, math.sqrt(2)]])
