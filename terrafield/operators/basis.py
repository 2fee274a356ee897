"""Predictive-process bases: knots, their factor, and basis rows of locations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.operators.linalg import basis_times
from terrafield.operators.spatial import MAXMIN_POINTS, maxmin_order
from terrafield.operators.vecchia import stationary_rows
from terrafield.session import cut

# Nugget of a basis, and its knots if not told.
NUGGET = 1e-6
DEFAULT_KNOTS = 100


def _earlier(xy: np.ndarray, m: int) -> list[np.ndarray]:
    """For each point its m nearest earlier ones, ties by index."""
    out = []
    for i in range(len(xy)):
        d = ((xy[:i] - xy[i]) ** 2).sum(1)
        out.append(np.lexsort((np.arange(i), d))[:m])
    return out


def knots_from_kmeans(locs: DataFrame, n: int, seed: int = 1234) -> np.ndarray:
    """n x 2 k-means centres of the first MAXMIN_POINTS locations by id, jittered by a twentieth of their greatest distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    head = locs.orderBy("id").limit(MAXMIN_POINTS)
    xy = np.array(head.select("x", "y").toPandas(), float)
    sd = max_distance(xy) / 20
    noisy = head.select((F.col("x") + F.randn(seed) * sd).alias("x"), (F.col("y") + F.randn(seed + 1) * sd).alias("y"))
    data = VectorAssembler(inputCols=["x", "y"], outputCol="xy").transform(noisy)
    model = KMeans(k=n, seed=seed, maxIter=50, featuresCol="xy").fit(data)
    return np.array(model.clusterCenters())


def max_distance(xy: np.ndarray, block: int = 512) -> float:
    return float(max((np.sqrt(((xy[i : i + block, None] - xy[None]) ** 2).sum(-1)).max() for i in range(0, len(xy), block)), default=0.0))


def hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the points' convex hull, by monotone chains."""
    if len(xy) > 64:  # what lies within the octagon of the outermost points is no corner
        ways = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]], float)
        ring = xy[(xy @ ways.T).argmax(0)]
        edge, after = np.roll(ring, -1, 0) - ring, xy[:, None] - ring[None]
        cross = edge[None, :, 0] * after[..., 1] - edge[None, :, 1] * after[..., 0]
        xy = xy[~((cross > 1e-9 * np.abs(cross).max()) | ((edge == 0).all(1))[None]).all(1)]
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy
    out = []
    for part in (xy, xy[::-1]):
        chain: list = []
        for x, y in part.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (x - chain[-2][0]):
                chain.pop()
            chain.append((x, y))
        out += chain[:-1]
    return np.array(out)


def _hulls(batches):
    held = np.empty((0, 2))
    for b in batches:
        new = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
        held = hull(np.concatenate([held, new[np.isfinite(new).all(axis=1)]]))
    yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["x", "y"])


#: Corners whose distances the driver compares, at most; those of more are compared by tasks.
CORNERS = 10_000


def diameter(points: DataFrame, corners: int = CORNERS) -> float:
    """The greatest distance between any two of points(x, y): both ends are corners of a partition's convex hull."""
    points = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = cut(points.mapInArrow(_hulls, "x double, y double"))
    if ends.count() > corners:
        ends = cut(ends.repartition(8).mapInArrow(_hulls, "x double, y double"))
    if ends.count() <= corners:
        return max_distance(hull(np.array(ends.toPandas(), float)))
    far = ends.crossJoin(ends.toDF("u", "v")).agg(F.max((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2).alias("d")).first().d
    return float(np.sqrt(far or 0.0))


def times(y: np.ndarray, x: DataFrame | None = None, names=(), pp: PredictiveProcess | None = None, on: str | None = None, key: str = "id") -> DataFrame:
    """(key, value0..): (X | basis) Y, X the columns `names` of x(key, ...), Y with a row for each of them and then for each knot.

    Without `on`, x has a row per location, whose id is the key; with it, rows of x hang on locations by that column, so the basis part is
    spread over observations. Without x the rows are those of the basis's locations. Names of three columns, or of one, are those of a range's.
    """
    if x is None and pp is None:
        raise ValueError("there is neither a design nor a basis to multiply")
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    names = list(names) if x is not None else []
    want = len(names) + (len(pp.knots) if pp is not None else 0)
    if len(y) != want:
        raise ValueError(f"the coefficients should have {want} rows, they have {len(y)}")
    top, low = y[: len(names)], y[len(names) :]
    cols = range(y.shape[1])
    part = lambda j: sum((F.col(f"`{n}`") * F.lit(float(top[i, j])) for i, n in enumerate(names)), F.lit(0.0))
    if pp is None:
        return x.select(key, *[part(j).alias(f"value{j}") for j in cols])
    basis = pp.times(low).withColumnRenamed("id", "_id")
    if x is None:
        return basis.select(F.col("_id").alias(key), *[F.col(f"pp{j}").alias(f"value{j}") for j in cols])
    rows = x.join(basis, F.col(f"`{on or key}`") == F.col("_id"))
    return rows.select(key, *[(part(j) + F.col(f"pp{j}")).alias(f"value{j}") for j in cols])


@dataclass
class PredictiveProcess:
    """Knots in max-min order, their lower factor (driver, knots squared) and the rows of the locations.

    rows(id, knot array, coef array, diag): a location hangs on its nearest knots only, so rows are independent of each other.
    """

    knots: np.ndarray
    matern_range: float
    knot_factor: np.ndarray
    rows: DataFrame

    @classmethod
    def fit(cls, locs: DataFrame, m: int, knots=None, matern_range: float | None = None, seed: int = 1234, n_obs: int | None = None) -> PredictiveProcess:
        """locs(id, x, y); knots: an array, a number of them (n_obs - 1 at most), or None for min(100, n_locs - 1)."""
        n = locs.count()
        if knots is None:
            knots = min(DEFAULT_KNOTS, n - 1)
        if np.isscalar(knots):
            knots = knots_from_kmeans(locs, int(min(knots, (n_obs or n) - 1)), seed)
        knots = np.asarray(knots, float)
        knots = knots[maxmin_order(knots)]
        rho = matern_range or max_distance(knots) / 5
        full = np.zeros((len(knots), len(knots)))
        for i, near in enumerate(_earlier(knots, m)):
            row = stationary_rows(knots[np.concatenate(([i], near)).astype(int)][None], 1.0, rho, NUGGET)[0]
            full[i, i], full[i, near] = row[0], row[1:]
        return cls(knots, rho, full, cls.rows_of(locs, knots, rho, m))

    @staticmethod
    def rows_of(locs: DataFrame, knots: np.ndarray, rho: float, m: int) -> DataFrame:
        shared = locs.sparkSession.sparkContext.broadcast((knots, rho, min(m, len(knots))))
        return locs.select("id", "x", "y").mapInArrow(partial(_rows, shared=shared), "id long, knot array<int>, coef array<double>, diag double")

    def knot_values(self, y: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.knot_factor, np.asarray(y, float).reshape(len(self.knots), -1))

    def times(self, y: np.ndarray) -> DataFrame:
        """(id, pp0..): the basis times coefficients y, knots x columns."""
        return basis_times(self.rows, self.knot_values(y))

    def transpose_times(self, y: DataFrame) -> np.ndarray:
        """Basis' y for y(id, value): partial sums per knot, the rest on the driver."""
        j = self.rows.join(y, "id").select((F.col("value") / F.col("diag")).alias("w"), F.explode(F.arrays_zip("knot", "coef")).alias("e"))
        out = np.zeros(len(self.knots))
        for r in j.groupBy(F.col("e.knot").alias("knot")).agg(F.sum(-F.col("w") * F.col("e.coef")).alias("value")).collect():
            out[r.knot] = r.value
        return np.linalg.solve(self.knot_factor.T, out)

    def dense_rows(self) -> DataFrame:
        """(id, phi array): the basis values of every location."""
        inv = np.linalg.inv(self.knot_factor)
        shared = self.rows.sparkSession.sparkContext.broadcast(inv)
        return self.rows.mapInArrow(partial(_dense, inv=shared), "id long, phi array<double>, own double")

    def variance_loss(self) -> DataFrame:
        """(id, loss): per cent of the unit prior variance that the basis misses at each location."""
        return self.dense_rows().select("id", loss_of(F.col("phi")).alias("loss"))

    def knot_loss(self) -> np.ndarray:
        """The same at the knots, in their order: only rounding, as a knot's own value is in the basis."""
        phi = np.linalg.inv(self.knot_factor)
        return 100 * np.maximum(0, 1 + NUGGET - (phi**2).sum(axis=1)) / (1 + NUGGET)

    def every_loss(self) -> DataFrame:
        """(kind, id, loss): the knots, numbered from 1, and the locations."""
        knots = self.rows.sparkSession.createDataFrame([("knot", k + 1, float(v)) for k, v in enumerate(self.knot_loss())], "kind string, id long, loss double")
        return knots.unionByName(self.variance_loss().select(F.lit("location").alias("kind"), "id", "loss"))

    def mean_loss(self) -> float:
        """Over knots and locations alike."""
        return float(self.every_loss().agg(F.avg("loss")).first()[0])

    def verdict(self) -> str:
        """Fixed words for a mean loss above 10, above 3 and below."""
        mean = self.mean_loss()
        return "quite a bit of loss" if mean > 10 else "fairly good" if mean > 3 else "great"

    def summary(self) -> DataFrame:
        """(name, value) rows that describe the basis."""
        rows = [("knots", str(len(self.knots))), ("locations", str(self.rows.count())), ("matern_range", str(self.matern_range)), ("mean_loss", str(round(self.mean_loss(), 1))), ("verdict", self.verdict())]
        return self.rows.sparkSession.createDataFrame(rows, "name string, value string")

    def __str__(self) -> str:
        return f"basis of {len(self.knots)} knots, range {self.matern_range:.4g}"


def loss_of(phi):
    """100 max(0, 1 + 1e-6 - sum of squares of the basis row) / (1 + 1e-6)."""
    total = F.aggregate(phi, F.lit(0.0), lambda a, v: a + v * v)
    return F.lit(100.0) * F.greatest(F.lit(0.0), F.lit(1 + NUGGET) - total) / F.lit(1 + NUGGET)


def _rows(batches, shared):
    knots, rho, k = shared.value
    for b in batches:
        xy = np.column_stack([b.column("x").to_numpy(), b.column("y").to_numpy()])
        d = ((xy[:, None] - knots[None]) ** 2).sum(-1)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        # a location on a knot has only the nugget to itself, so its row stays solvable
        row = stationary_rows(np.concatenate([xy[:, None], knots[near]], axis=1), 1.0, rho, NUGGET)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(row[:, 1:].tolist(), pa.list_(pa.float64())), pa.array(row[:, 0])], ["id", "knot", "coef", "diag"]
        )


def _dense(batches, inv):
    inv = inv.value
    for b in batches:
        diag = b.column("diag").to_numpy()
        # every row hangs on equally many knots
        knots, coef = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("knot", "coef"))
        for s in range(0, b.num_rows, 1024):
            q = slice(s, s + 1024)
            phi = -np.einsum("ik,ikj->ij", coef[q], inv[knots[q]]) / diag[q, None]
            ends = np.arange(len(phi) + 1, dtype=np.int32) * phi.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("id").slice(s, 1024), pa.ListArray.from_arrays(ends, pa.array(phi.ravel())), pa.array(1 / diag[q])], ["id", "phi", "own"])
