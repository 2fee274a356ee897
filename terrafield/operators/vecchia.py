"""Sparse inverse-Cholesky (Vecchia) factors of nonstationary Matern fields, with gradients."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.functions.kernels import DIAGONAL, canonical_range, covariance

STEP = 1e-5


def neighbourhoods(nn_self: DataFrame, locs: DataFrame, columns=("x", "y")) -> DataFrame:
    """(child, near): per child its neighbours in the order of k, the child first, with the given columns of locs(id, ...)."""
    at = locs.select(F.col("id").alias("parent"), *columns)
    rows = nn_self.select("child", "k", "parent").join(at, "parent")
    return rows.groupBy("child").agg(F.sort_array(F.collect_list(F.struct("k", "parent", *columns))).alias("near"))


def factor_rows(xy: np.ndarray, f: np.ndarray, smoothness: float, grad: bool = False, prefactor: str = "reference"):
    """Rows of the factor of a batch of equal neighbourhoods: xy b x (k+1) x 2, f b x (k+1) x d log ranges, child first.

    Returns coef b x (k+1): g for the child, -g s for its parents; and, with grad, b x (k+1) x (k+1) x d: the derivative of each
    coefficient by each log range component of each member. A child without parents has the row 1.
    """
    b, n, d = f.shape
    coef = np.ones((b, n))
    dcoef = np.zeros((b, n, n, d))
    if n == 1:
        return (coef, dcoef) if grad else (coef, None)
    # each pair once; what stands on the diagonal is never read
    i, j = np.triu_indices(n, 1)
    c = np.empty((b, n, n))
    c[:, i, j] = c[:, j, i] = covariance(xy[:, i] - xy[:, j], f[:, i], f[:, j], smoothness, prefactor)
    c[:, np.arange(n), np.arange(n)] = DIAGONAL
    s11 = c[:, 1:, 1:]
    s12 = c[:, 1:, 0]
    inv = np.linalg.inv(s11) if grad else None
    s = (inv @ s12[..., None])[..., 0] if grad else np.linalg.solve(s11, s12[..., None])[..., 0]
    v = DIAGONAL - (s * s12).sum(1)
    g = v**-0.5
    coef = np.concatenate([g[:, None], -g[:, None] * s], axis=1)
    if not grad:
        return coef, None
    for p in range(n):
        for j in range(d):
            moved = f[:, p].copy()
            moved[:, j] += STEP
            # only the covariances with member p change; its own variance doesn't
            line = covariance(xy - xy[:, p : p + 1], moved[:, None], f, smoothness, prefactor)
            dl = (line - c[:, p]) / STEP
            dl[:, p] = 0
            d12 = dl[:, 1:] if p == 0 else np.zeros((b, n - 1))
            if p:
                d12[:, p - 1] = dl[:, 0]
            d11s = np.zeros((b, n - 1))
            if p:
                row = dl[:, 1:]
                d11s = row * s[:, p - 1 : p]
                d11s[:, p - 1] += (row * s).sum(1)
            ds = (inv @ (d12 - d11s)[..., None])[..., 0]
            dv = -(2 * (s * d12).sum(1) - (s * d11s).sum(1))
            dg = -0.5 * v**-1.5 * dv
            dcoef[:, :, p, j] = np.concatenate([dg[:, None], -(dg[:, None] * s + g[:, None] * ds)], axis=1)
    return coef, dcoef


def _blocks(near: pa.ListArray, names: list[str], rows_at_once: int = 2048):
    """Batches of rows with equally many neighbours: (row numbers, parents, columns b x (k+1) x names), from the Arrow list's own buffers."""
    at, flat = near.offsets.to_numpy(), near.values
    parent = flat.field("parent").to_numpy(zero_copy_only=False)
    cols = np.column_stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
    size = np.diff(at)
    for n in np.unique(size):
        every = np.nonzero(size == n)[0]
        for s in range(0, len(every), rows_at_once):
            rows = every[s : s + rows_at_once]
            place = at[rows][:, None] + np.arange(n)
            yield rows, parent[place].astype(np.int64), cols[place]


def _lists(a: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    a = np.ascontiguousarray(a.reshape(len(a), -1))
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel()))


def _factor(batches, d, smoothness, grad, prefactor, names=None, beta=None):
    """names, beta: neighbours carry design columns in place of log ranges, which follow from them."""
    names = names or [f"lr{j}" for j in range(d)]
    for b in batches:
        child = b.column("child")
        for rows, parents, cols in _blocks(b.column("near"), ["x", "y", *names]):
            f = cols[..., 2:] if beta is None else cols[..., 2:] @ beta
            coef, dcoef = factor_rows(cols[..., :2], f, smoothness, grad, prefactor)
            out = [child.take(pa.array(rows)), _lists(parents), _lists(coef)]
            if grad:
                out.append(_lists(dcoef))
            yield pa.RecordBatch.from_arrays(out, ["child", "parents", "coef", *["deriv"] * grad])


def factor_at(near: DataFrame, names: list[str], beta: np.ndarray, smoothness: float = 1.5, prefactor: str = "reference") -> DataFrame:
    """vecchia(child, parents, coef) at range coefficients beta; near: neighbourhoods() with x, y and the design columns `names`. Nothing is shuffled."""
    b = canonical_range(np.asarray(beta, float))
    run = partial(_factor, d=b.shape[1], smoothness=smoothness, grad=False, prefactor=prefactor, names=list(names), beta=b)
    return near.select("child", "near").mapInArrow(run, "child long, parents array<long>, coef array<double>")


def range_sums(near: DataFrame, names: list[str], beta: np.ndarray, smoothness: float = 1.5, log_det: bool = False, prefactor: str = "reference") -> tuple[float, float, np.ndarray]:
    """(sum of (L r)^2, sum of log L_ii, X'g) of near(child, near, r array[, l]): r are the neighbours' values in their order, and
    g is the sandwich of l and r by the log range of each member; without l it is that of -(L r), plus with log_det the logs' gradient, turned to -g.

    Rows, derivatives and sums are made batch by batch where the neighbourhoods are; a row per batch and sum is shuffled.
    """
    b = canonical_range(np.asarray(beta, float))
    run = partial(_range_sums, names=list(names), beta=b, smoothness=smoothness, log_det=log_det, prefactor=prefactor)
    got = {r.k: r.value for r in near.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()}  # p d + 2 rows
    p, d = len(names), b.shape[1]
    g = np.array([got.get(k + 2, 0.0) for k in range(p * d)]).reshape(p, d)
    return got.get(0, 0.0), got.get(1, 0.0), g


def _range_sums(batches, names, beta, smoothness, log_det, prefactor):
    for b in batches:
        squares = logs = 0.0
        g = np.zeros((len(names), beta.shape[1]))
        near, r = b.column("near"), b.column("r")
        at, values = r.offsets.to_numpy(), r.values.to_numpy(zero_copy_only=False)
        left = b.column("l").to_numpy() if "l" in b.schema.names else None
        for rows, _, cols in _blocks(near, ["x", "y", *names]):
            x = cols[..., 2:]
            coef, deriv = factor_rows(cols[..., :2], x @ beta, smoothness, True, prefactor)
            right = values[at[rows][:, None] + np.arange(x.shape[1])]
            lr = (coef * right).sum(1)
            squares += float((lr**2).sum())
            logs += float(np.log(coef[:, 0]).sum())
            by = (left[rows] if left is not None else -lr)[:, None, None] * np.einsum("ikpj,ik->ipj", deriv, right)
            if log_det:
                by = by + deriv[:, 0] / coef[:, 0, None, None]
            g += np.einsum("ipn,ipj->nj", x, by if left is not None else -by)
        out = np.concatenate([[squares, logs], g.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["k", "value"])


def factor(nn_self: DataFrame, locs: DataFrame, components: int = 1, smoothness: float = 1.5, grad: bool = False, prefactor: str = "reference") -> DataFrame:
    """vecchia(child, parents, coef[, deriv]); locs(id, x, y, lr0[, lr1, lr2]) with log ranges as canonical_range gives them.

    Neighbourhoods come from one join and one grouping by child; each row is then solved by itself, in batches.
    deriv is flattened: coefficient, member, component.
    """
    lr = [f"lr{j}" for j in range(components)]
    near = neighbourhoods(nn_self, locs, ("x", "y", *lr))
    fields = "child long, parents array<long>, coef array<double>" + ", deriv array<double>" * grad
    return near.mapInArrow(partial(_factor, d=components, smoothness=smoothness, grad=grad, prefactor=prefactor), fields)


def log_range(locs: DataFrame, beta: np.ndarray, names, basis: DataFrame | None = None) -> DataFrame:
    """locs with lr0.. = (X | basis) beta in the canonical basis; names are the design's columns on locs, the intercept as `intercept`.

    basis: (id, values of the predictive process as pp0.., one a component), added to the regression.
    """
    b = canonical_range(np.asarray(beta, float))
    out = locs.join(basis, "id") if basis is not None else locs
    for j in range(b.shape[1]):
        v = sum((F.col(n) * float(b[i, j]) for i, n in enumerate(names)), F.lit(0.0))
        out = out.withColumn(f"lr{j}", v + F.col(f"pp{j}") if basis is not None else v)
    return out


def entries(vecchia: DataFrame) -> DataFrame:
    """L(row, col, value) in coordinate form."""
    z = F.arrays_zip("parents", "coef")
    return vecchia.select(F.col("child").alias("row"), F.explode(z).alias("e")).select("row", F.col("e.parents").alias("col"), F.col("e.coef").alias("value"))


def sandwiches(vecchia: DataFrame, left: DataFrame, right: DataFrame, components: int, log_det: bool = False) -> DataFrame:
    """(id, component, grad): sum over rows i of left_i dL_ij / dtheta right_j, by the member whose log range theta is.

    left(id, value), right(id, value). With log_det the derivative of log L_ii is added. Rows meet their right-hand values by an
    explode, an equi-join and a grouping; the result is summed by member with map-side combining.
    """
    flat = vecchia.select("child", F.posexplode("parents").alias("pos", "id"))
    r = flat.join(right.withColumnRenamed("value", "r"), "id").groupBy("child").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("r"))
    rows = vecchia.join(r, "child").join(left.select(F.col("id").alias("child"), F.col("value").alias("l")), "child")
    got = rows.select("parents", "coef", "deriv", "l", F.col("r.r").alias("r")).mapInArrow(partial(_sandwich, d=components, log_det=log_det), "id long, component int, grad double")
    return got.groupBy("id", "component").agg(F.sum("grad").alias("grad"))


def _sandwich(batches, d, log_det):
    for b in batches:
        left, every = b.column("l").to_numpy(), []
        at, member = (f(b.column("parents")) for f in (lambda c: c.offsets.to_numpy(), lambda c: c.values.to_numpy(zero_copy_only=False)))
        coef, deriv, r = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("coef", "deriv", "r"))
        starts = {c: b.column(c).offsets.to_numpy() for c in ("coef", "deriv", "r")}
        size = np.diff(at)
        for n in np.unique(size):
            rows = np.nonzero(size == n)[0]
            pick = lambda v, c, m: v[starts[c][rows][:, None] + np.arange(m)]
            dc = pick(deriv, "deriv", n * n * d).reshape(len(rows), n, n, d)
            g = left[rows, None, None] * np.einsum("ikpj,ik->ipj", dc, pick(r, "r", n))
            if log_det:
                g = g + dc[:, 0] / pick(coef, "coef", n)[:, 0, None, None]
            every.append((np.repeat(member[at[rows][:, None] + np.arange(n)], d), np.tile(np.arange(d, dtype=np.int32), len(rows) * n), g.ravel()))
        cols = [np.concatenate(c) for c in zip(*every)] if every else [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["id", "component", "grad"])


def stationary_rows(xy: np.ndarray, variance: float, scale: float, nugget: float) -> np.ndarray:
    """Rows of the factor of a stationary Matern-3/2 covariance: b x (k+1), child first."""
    d = np.sqrt(((xy[:, :, None] - xy[:, None, :]) ** 2).sum(-1)) / scale
    c = variance * (1 + d) * np.exp(-d)
    n = xy.shape[1]
    c[:, np.arange(n), np.arange(n)] = variance * (1 + nugget)
    if n == 1:
        return c[:, :, 0] ** -0.5
    s = np.linalg.solve(c[:, 1:, 1:], c[:, 1:, :1])[..., 0]
    g = (c[:, 0, 0] - (s * c[:, 1:, 0]).sum(1)) ** -0.5
    return np.concatenate([g[:, None], -g[:, None] * s], axis=1)
