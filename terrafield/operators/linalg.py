"""Linear algebra on coordinate-form matrices and design tables; small dense parts on the driver."""

from __future__ import annotations

import warnings
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matvec(entries: DataFrame, v: DataFrame) -> DataFrame:
    """(id, value) of L v; entries(row, col, value), v(id, value)."""
    j = entries.join(v.select(F.col("id").alias("col"), F.col("value").alias("v")), "col")
    return j.groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def tmatvec(entries: DataFrame, v: DataFrame) -> DataFrame:
    return matvec(entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), v)


def posterior_precision(entries: DataFrame, sd: DataFrame, obs_precision: DataFrame) -> DataFrame:
    """(a, b, value) of L'L / (sd_a sd_b) + diag(sums of 1 / noise variance); sd(id, sd), obs_precision(id, value)."""
    l = entries.select("row", F.col("col").alias("a"), F.col("value").alias("va"))
    r = entries.select("row", F.col("col").alias("b"), F.col("value").alias("vb"))
    q = l.join(r, "row").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("value"))
    q = q.join(sd.select(F.col("id").alias("a"), F.col("sd").alias("sa")), "a").join(sd.select(F.col("id").alias("b"), F.col("sd").alias("sb")), "b")
    q = q.select("a", "b", (F.col("value") / (F.col("sa") * F.col("sb"))).alias("value"))
    own = obs_precision.select(F.col("id").alias("a"), F.col("id").alias("b"), "value")
    return q.unionByName(own).groupBy("a", "b").agg(F.sum("value").alias("value"))


def gram(design: DataFrame, names, y: str | None = None, weight: str | None = None) -> DataFrame:
    """(i, j, value) of X'WX, i <= j, and X'Wy as j = 'y', from one aggregation over the rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]] + ([(a, y) for a in names] if y else [])
    one = design.agg(*[F.sum(w * F.col(a) * F.col(b)).alias(f"g{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("i"), F.lit("y" if b == y else b).alias("j"), F.col(f"g{k}").alias("value")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def gram_np(design: DataFrame, names, y: str | None = None, weight: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The same as p x p and p arrays on the driver."""
    at = {n: k for k, n in enumerate(names)}
    xx, xy = np.zeros((len(names),) * 2), np.zeros(len(names))
    for r in gram(design, names, y, weight).collect():
        if r.j == "y" and y:
            xy[at[r.i]] = r.value
        else:
            xx[at[r.i], at[r.j]] = xx[at[r.j], at[r.i]] = r.value
    return xx, xy if y else None


def ols(design: DataFrame, names, y: str) -> np.ndarray:
    xx, xy = gram_np(design, names, y)
    return np.linalg.solve(xx, xy)


def crossprod(x: DataFrame, names, y: str, basis=None, on: str = "id") -> np.ndarray:
    """(X | basis)' y: X'y, then the basis part of y summed per location."""
    _, xy = gram_np(x, names, y)
    if basis is None:
        return xy
    per = x.groupBy(on).agg(F.sum(y).alias("value"))
    return np.concatenate([xy, basis.transpose_times(per)])


# ----------------------------------------------------------------------------- the factor on the driver, as padded arrays


class Graph:
    """What solves need of a neighbour graph, whatever the coefficients: which entries there are, and the levels of its rows.

    A row's level is one more than the greatest of its parents', so the rows of a level can be solved at once.
    """

    def __init__(self, parents: np.ndarray):
        self.ok = parents >= 0
        self.safe = np.where(self.ok, parents, 0)
        level = np.full(len(parents), -1, np.int64)
        todo = np.arange(len(parents))
        while len(todo):  # a round settles the rows whose parents are settled; as many rounds as levels
            near = np.where(self.ok[todo, 1:], level[self.safe[todo, 1:]], 0)
            ready = ((near >= 0) | ~self.ok[todo, 1:]).all(axis=1)
            if not ready.any():
                raise ValueError("the neighbour graph has a cycle")
            rows = todo[ready]
            has = self.ok[rows, 1:]
            level[rows] = np.where(has.any(axis=1), np.where(has, level[self.safe[rows, 1:]], -1).max(axis=1, initial=-1) + 1, 0)
            todo = todo[~ready]
        self.order = order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(level))[:-1]) if len(level) else []
        self._level = level

    @cached_property
    def upward(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """(entries, their parents' places within a level, (first row, last, first entry, last) per level in `order`): the entries of rows on other
        rows, by their parents' level, for solves from the last level to the first. An entry is a place in the flattened parents[:, 1:]."""
        entries = np.nonzero(self.ok[:, 1:].ravel())[0]
        parent = self.safe[:, 1:].ravel()[entries]
        by = np.argsort(self._level[parent], kind="stable")
        sizes = np.array([len(rows) for rows in self.levels], np.int64)
        ends, start = np.cumsum(sizes), np.empty(len(self.order), np.int64)
        start[self.order] = np.arange(len(self.order)) - np.repeat(ends - sizes, sizes)
        last = np.cumsum(np.bincount(self._level[parent], minlength=len(sizes)))
        spans = [(int(e - n), int(e), int(a), int(b)) for e, n, a, b in zip(ends, sizes, np.concatenate([[0], last[:-1]]), last)]
        return entries[by], start[parent[by]], spans


class Factor:
    """A factor's rows as arrays: parents n x (k+1) (own index first, -1 where none) and coefficients.

    The sequential solves of the sampler need it in one place; 12 bytes times n (m + 1), checked against `limit`.
    """

    def __init__(self, parents: np.ndarray, coef: np.ndarray, deriv: np.ndarray | None = None, graph: Graph | None = None):
        self.parents, self.coef, self.deriv = parents, coef, deriv
        graph = graph or Graph(parents)
        self.graph = graph
        self.ok, self.safe, self.levels = graph.ok, graph.safe, graph.levels

    @cached_property
    def _by_level(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, diagonal, parents, coefficients over the diagonal) of each level; coefficients are 0 where there is no neighbour."""
        every = []
        for rows in self.levels:
            diag = self.coef[rows, 0]
            every.append((rows, diag, self.safe[rows, 1:], np.where(self.ok[rows, 1:], self.coef[rows, 1:], 0) / diag[:, None]))
        return every

    @cached_property
    def _upward(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, diagonal, places of entries' parents among the rows, entries' own rows, coefficients) of each level, for solves from the last to the first."""
        entries, place, spans = self.graph.upward
        child, coef = entries // max(1, self.coef.shape[1] - 1), self.coef[:, 1:].ravel()[entries]
        return [(self.graph.order[a:b], self.coef[self.graph.order[a:b], 0], place[c:d], child[c:d], coef[c:d]) for a, b, c, d in spans]

    @classmethod
    def collect(cls, vecchia: DataFrame, limit: int = 2_000_000) -> Factor:
        t = vecchia.orderBy("child").limit(limit + 1).toArrow()
        if t.num_rows > limit:
            raise ValueError(f"more than {limit} locations for a factor on the driver")
        ids = t.column("child").to_numpy()
        parents, coef = t.column("parents").to_pylist(), t.column("coef").to_pylist()
        width = max(map(len, parents), default=1)
        p = np.full((len(ids), width), -1, np.int64)
        c = np.zeros((len(ids), width))
        for i, (a, b) in enumerate(zip(parents, coef)):
            p[i, : len(a)] = np.searchsorted(ids, a)
            c[i, : len(b)] = b
        return cls(p, c)

    def times(self, v: np.ndarray) -> np.ndarray:
        return (self.coef * np.where(self.ok, v[self.safe], 0)).sum(1)

    def transpose_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.safe.ravel(), np.where(self.ok, self.coef * v[:, None], 0).ravel(), len(v))

    def solve(self, z: np.ndarray) -> np.ndarray:
        """L^-1 z, level by level of the neighbour graph."""
        x = np.zeros(len(z))
        for rows, diag, near, coef in self._by_level:
            x[rows] = z[rows] / diag - np.einsum("ij,ij->i", coef, x[near])
        return x

    def transpose_solve(self, z: np.ndarray) -> np.ndarray:
        """L^-T z, from the last level to the first."""
        x = np.zeros(len(z))
        for rows, diag, place, child, coef in reversed(self._upward):
            x[rows] = (z[rows] - np.bincount(place, coef * x[child], len(rows))) / diag
        return x

    def sandwich(self, left: np.ndarray, right: np.ndarray, log_det: bool = False) -> np.ndarray:
        """n x d: sum over rows of left_i dL_ij right_j by the member whose log range moves; see operators.vecchia."""
        d = self.deriv.shape[-1]
        g = left[:, None, None] * np.einsum("ikpj,ik->ipj", self.deriv, np.where(self.ok, right[self.safe], 0))
        if log_det:
            g = g + self.deriv[:, 0] / self.coef[:, 0, None, None]
        out = np.zeros((len(left), d))
        np.add.at(out, self.safe[self.ok], g[self.ok])
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.coef),) * 2)
        rows = np.broadcast_to(np.arange(len(self.coef))[:, None], self.parents.shape)
        out[rows[self.ok], self.parents[self.ok]] = self.coef[self.ok]
        return out


def conjugate_gradient(times, b: np.ndarray, scale, tol: float = 1e-10, most: int = 2000) -> np.ndarray:
    """Solves Q x = b for a symmetric positive definite Q given by its products, scaled by its diagonal or by products with a matrix near its inverse."""
    near = scale if callable(scale) else lambda r: r / scale
    x = np.zeros_like(b)
    r = b.copy()
    z = near(r)
    p, rz = z.copy(), r @ z
    stop = tol * max(1e-300, np.linalg.norm(b))
    for _ in range(most):
        if np.linalg.norm(r) <= stop:
            return x
        q = times(p)
        a = rz / (p @ q)
        x, r = x + a * p, r - a * q
        z = near(r)
        new = r @ z
        p, rz = z + new / rz * p, new
    if np.linalg.norm(r) > stop:
        warnings.warn(f"{most} steps of conjugate gradients left {np.linalg.norm(r) / np.linalg.norm(b):.1e} of the right-hand side", stacklevel=2)
    return x


#: White components of the field that a draw's scaling solves for together, and rows a component that their sums come from, at most.
COARSE, COARSE_ROWS = 1024, 16


def _coarse(factor: Factor, weight: np.ndarray, most: int, rows: int) -> np.ndarray | None:
    """Inverse of the first rows and columns of I + L^-T diag(weight) L^-1, `most` of them, summed over the first `rows` times as many
    rows, which stand for the others: the result scales gradients, whose solution doesn't hang on it. Nothing if those rows hang on later ones."""
    n = min(len(weight), most * rows)
    total = weight[:n].sum()
    if total <= 0 or (factor.parents[:n] >= n).any():
        return None
    k = min(n, most)
    a = np.zeros((n, k))
    a[np.arange(k), np.arange(k)] = 1 / factor.coef[:k, 0]
    for level, _, near, coef in factor._by_level:
        some = level < n
        level, near, coef = level[some], near[some], coef[some]
        for j in range(coef.shape[1]):
            a[level] -= coef[:, j, None] * a[near[:, j]]
    a *= np.sqrt(weight[:n] * (weight.sum() / total))[:, None]
    return np.linalg.inv(np.eye(k) + a.T @ a)


def draw_field(factor: Factor, sd: np.ndarray, precision: np.ndarray, rhs: np.ndarray, rng, coarse: int = COARSE) -> np.ndarray:
    """An exact draw from N(Q^-1 rhs, Q^-1), Q = diag(1/sd) L'L diag(1/sd) + diag(precision): perturb, then solve.

    Gradients are scaled by the prior's covariance with a correction for the first `coarse` white components, which say the field's large shapes: what is left
    of Q to solve for is near the identity, so the number of steps hardly grows as the locations get denser.
    """
    n = len(sd)
    noise = factor.transpose_times(rng.standard_normal(n)) / sd + np.sqrt(precision) * rng.standard_normal(n)
    times = lambda v: factor.transpose_times(factor.times(v / sd)) / sd + precision * v
    weight = sd * sd * precision
    first = _coarse(factor, weight, coarse, COARSE_ROWS)
    k = 0 if first is None else len(first)
    # a later component moves the locations that come to lie about its own, n / rank of them, the less the farther they are
    rest = 1 / (1 + 0.3 * weight / factor.coef[:, 0] ** 2 * (n / np.arange(1, n + 1)))[k:]

    def near(r):
        v = factor.transpose_solve(sd * r)
        if k:
            v[:k] = first @ v[:k]
        v[k:] *= rest
        return sd * factor.solve(v)

    return conjugate_gradient(times, rhs + noise, near)


# ----------------------------------------------------------------------------- low-rank basis rows


def basis_times(rows: DataFrame, u: np.ndarray) -> DataFrame:
    """(id, pp0..): per location -(sum_k coef_k u_knot) / diag, for rows(id, knot array, coef array, diag); u: knots x columns."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(u, float))
    fields = ", ".join(f"pp{j} double" for j in range(u.shape[1]))
    return rows.mapInArrow(partial(_basis, u=shared), f"id long, {fields}")


def _basis(batches, u):
    u = u.value
    for b in batches:
        knots, coef = (b.column(c) for c in ("knot", "coef"))
        k = knots.flatten().to_numpy()
        n = np.diff(knots.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), n)
        c = coef.flatten().to_numpy()
        diag = b.column("diag").to_numpy()
        cols = [pa.array(-np.bincount(row, c * u[k, j], b.num_rows) / diag) for j in range(u.shape[1])]
        yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", *[f"pp{j}" for j in range(u.shape[1])]])
