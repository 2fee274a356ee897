"""Chains whose locations stay on the cluster, too: the field is a table, and a step of a chain is a run of joins and aggregations.

The kernels of operators.sampler ask a model for products, solves, draws and potentials; FieldTables answers by tables. Neighbourhoods are grouped
once, with the coordinates and range design of each member, so the factor at other coefficients, its derivatives and the
gradients are made where the neighbourhoods are; a vector that meets them is one join and one grouping. The driver holds the
coefficients, sums of their sizes, and one row per level of the neighbour graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafield.operators import linalg, sampler, triangular, vecchia
from terrafield.operators.cholesky import FRONT, Cholesky, dissect
from terrafield.operators.distributed import ObservationTable
from terrafield.operators.noise import normal
from terrafield.session import cut

#: Locations of a block whose part of a precision matrix is inverted, about.
BLOCK = 768
#: Conjugate gradients stop at this share of the right-hand side's norm, or after so many steps.
TOLERANCE, STEPS = 1e-8, 1000


def _sum(df: DataFrame, **of: Column) -> dict[str, float]:
    """Sums of columns, 0 for none."""
    row = df.agg(*[F.sum(c).alias(k) for k, c in of.items()]).first()
    return {k: row[k] or 0.0 for k in of}


class TableFactor:
    """A factor as a table vecchia(child, parents, coef): products by joins, solves by bands of levels."""

    def __init__(self, rows: DataFrame, level: DataFrame, band_rows: int = triangular.BAND_ROWS):
        self.rows, self.level, self.band_rows, self._solver, self._by = rows, level, band_rows, None, {}

    def entries(self, by: str) -> DataFrame:
        """L(row, col, value), written once partitioned by `by`, so that products shuffle vectors only."""
        if by not in self._by:
            self._by[by] = cut(vecchia.entries(self.rows).repartition(by))
        return self._by[by]

    def times(self, v: DataFrame, columns=("value",)) -> DataFrame:
        """L v, for each of the columns of v(id, ...)."""
        j = self.entries("col").withColumnRenamed("value", "_l").join(v.withColumnRenamed("id", "col"), "col")
        return j.groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col("_l") * F.col(c)).alias(c) for c in columns])

    def transpose_times(self, v: DataFrame, columns=("value",)) -> DataFrame:
        j = self.entries("row").withColumnRenamed("value", "_l").join(v.withColumnRenamed("id", "row"), "row")
        return j.groupBy(F.col("col").alias("id")).agg(*[F.sum(F.col("_l") * F.col(c)).alias(c) for c in columns])

    def _triangular(self) -> triangular.Triangular:
        if self._solver is None:
            self._solver = triangular.Triangular.of(self.rows, self.level, self.band_rows)
        return self._solver

    def solve(self, z: DataFrame) -> DataFrame:
        return self._triangular().solve(z)

    def transpose_solve(self, z: DataFrame) -> DataFrame:
        return self._triangular().solve(z, backward=True)

    def close(self) -> None:
        """Deletes what solves have written."""
        if self._solver is not None:
            self._solver.close()
            self._solver = None


def _inverse(entries: pd.DataFrame, sites: pd.DataFrame) -> pd.DataFrame:
    """A block of Q inverted: entries(block, a, b, value) of L'L, sites(block, id, sd, precision)."""
    sites = sites.sort_values("id")
    ids, sd = sites["id"].to_numpy(), sites["sd"].to_numpy(float)
    q = np.zeros((len(ids),) * 2)
    if len(entries):
        q[np.searchsorted(ids, entries["a"].to_numpy()), np.searchsorted(ids, entries["b"].to_numpy())] = entries["value"].to_numpy(float)
    q = q / np.outer(sd, sd) + np.diag(sites["precision"].to_numpy(float))
    return pd.DataFrame({"block": [int(sites["block"].iloc[0])], "ids": [ids], "sd": [sd], "precision": [sites["precision"].to_numpy(float)], "inverse": [np.linalg.inv(q).ravel()]})


def _products(batches):
    """q = t / sd + precision p and its block's inverse times q, beside the vectors of a block; t are rows (id, t) that came back from the products."""
    for b in batches:
        q, u = [], []
        column = lambda c, i: b.column(c)[i].values.to_numpy(zero_copy_only=False)
        for i in range(b.num_rows):
            t = b.column("t")[i].values
            at, ids = t.field("id").to_numpy(), column("ids", i)
            values = np.zeros(len(ids))
            values[np.searchsorted(ids, at)] = t.field("t").to_numpy()
            q.append(values / column("sd", i) + column("precision", i) * column("p", i))
            u.append(column("inverse", i).reshape(len(ids), len(ids)) @ q[-1])
        yield pa.RecordBatch.from_arrays([b.column("block"), *[b.column(c) for c in "xrzp"], *[pa.array(v, pa.list_(pa.float64())) for v in (q, u)]], ["block", *"xrzpqu"])


def _scaled(batches):
    """z = the block's inverse times r."""
    for b in batches:
        z = [m.values.to_numpy().reshape(len(r.values), -1) @ r.values.to_numpy(zero_copy_only=False) for m, r in zip(b.column("inverse"), b.column("r"))]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("r"), pa.array(z, pa.list_(pa.float64()))], ["block", "r", "z"])


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _by_fronts(factor: TableFactor, sites: DataFrame, b: DataFrame, locs: DataFrame, front: int) -> DataFrame | None:
    """(id, value): the solution by Q's sparse Cholesky factor, or nothing if one of its fronts has more than `front` variables."""
    q = cut(linalg.posterior_precision(factor.entries("row"), sites.select("id", "sd"), sites.select("id", F.col("precision").alias("value"))))
    try:
        return cut(Cholesky.of(q, locs.select("id", "x", "y"), b.select("id", "value"), most=front).solve())
    except PythonException as e:
        if "draw such fields by conjugate gradients" not in str(e):
            raise
        return None


def conjugate_gradient(factor: TableFactor, sites: DataFrame, b: DataFrame, places: DataFrame, tol: float = TOLERANCE, most: int = STEPS, locs: DataFrame | None = None, front: int = FRONT) -> DataFrame:
    """(id, value): the solution of Q x = b, Q = diag(1 / sd) L'L diag(1 / sd) + diag(precision), scaled by the inverses of Q's blocks.

    sites(id, sd, precision); b(id, value); places(id, block): blocks of near locations, of a size that a task inverts. Vectors lie as an array
    per block beside the block's inverse, so only products shuffle. A step writes the vectors once and brings eight sums to the driver,
    whatever the number of locations. The number of steps grows as places get denser, so with locs(id, x, y) they start at the solution by Q's
    sparse factor, unless a front is larger than `front`: what it leaves of the right-hand side is computed, and solved for if it is beyond `tol`.
    """
    if locs is not None and (x := _by_fronts(factor, sites, b, locs, front)) is not None:
        v = sites.join(x.withColumnRenamed("value", "x"), "id").join(b.select("id", "value"), "id")
        t = factor.transpose_times(factor.times(v.select("id", (F.col("x") / F.col("sd")).alias("value")))).withColumnRenamed("value", "t")
        left = cut(v.join(t, "id").select("id", "value", (F.col("value") - F.col("t") / F.col("sd") - F.col("precision") * F.col("x")).alias("left")))
        got = _sum(left, b=F.col("value") * F.col("value"), r=F.col("left") * F.col("left"))
        if got["r"] <= tol * tol * got["b"]:
            return x
        more = conjugate_gradient(factor, sites, left.select("id", F.col("left").alias("value")), places, tol * np.sqrt(got["b"] / got["r"]), most)
        return x.join(more.withColumnRenamed("value", "more"), "id").select("id", (F.col("value") + F.col("more")).alias("value"))
    places = cut(places)
    half = factor.entries("row").join(places.withColumnRenamed("id", "col"), "col")
    x, y = (half.select("row", "block", F.col("col").alias(c), F.col("value").alias(f"v{c}")) for c in ("a", "b"))
    inside = x.join(y, ["row", "block"]).groupBy("block", "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("value"))
    own = sites.select("id", "sd", "precision").join(places, "id")
    blocks = inside.groupBy("block").cogroup(own.toDF(*own.columns).groupBy("block")).applyInPandas(_inverse, "block long, ids array<long>, sd array<double>, precision array<double>, inverse array<double>")
    blocks = cut(blocks.repartition("block"))
    r = b.select("id", F.col("value").alias("r")).join(places, "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "r"))).alias("r")).select("block", F.col("r.r").alias("r"))
    s = cut(r.join(blocks.select("block", "inverse"), "block").mapInArrow(_scaled, "block long, r array<double>, z array<double>"))
    s = s.select("block", F.transform("r", lambda v: v * 0.0).alias("x"), "r", "z", F.col("z").alias("p"))
    start = _sum(s, rr=_dot("r", "r"), rz=_dot("r", "z"))
    rr, rz = start["rr"], start["rz"]
    stop = tol * tol * rr
    for _ in range(most):
        if rr <= stop:
            break
        p = s.join(blocks.select("block", "ids", "sd"), "block").select(F.explode(F.arrays_zip("ids", "sd", "p")).alias("e"))
        t = factor.transpose_times(factor.times(p.select(F.col("e.ids").alias("id"), (F.col("e.p") / F.col("e.sd")).alias("value"))))
        t = t.join(places, "id").groupBy("block").agg(F.collect_list(F.struct("id", F.col("value").alias("t"))).alias("t"))
        s = cut(s.join(t, "block").join(blocks, "block").mapInArrow(_products, "block long, " + ", ".join(f"{c} array<double>" for c in "xrzpqu")))
        got = _sum(s, **{c: _dot(*c) for c in ("pq", "rr", "rq", "qq", "rz", "ru", "qz", "qu")})
        a = got["rz"] / got["pq"]
        rr = max(0.0, got["rr"] - 2 * a * got["rq"] + a * a * got["qq"])
        rz = got["rz"] - a * (got["ru"] + got["qz"]) + a * a * got["qu"]
        along = lambda c, d, f: F.zip_with(c, d, lambda v, w: v + F.lit(f) * w)
        s = s.select("block", along("x", "p", a).alias("x"), along("r", "q", -a).alias("r"), along("z", "u", -a).alias("z"), "p")
        s = s.withColumn("p", along("z", "p", rz / got["rz"]))
    out = s.join(blocks.select("block", "ids"), "block").select(F.explode(F.arrays_zip("ids", "x")).alias("e"))
    return out.select(F.col("e.ids").alias("id"), F.col("e.x").alias("value"))


def draw_field(factor: TableFactor, sites: DataFrame, rhs: DataFrame, places: DataFrame, seed: int, tol: float = TOLERANCE, locs: DataFrame | None = None) -> DataFrame:
    """(id, value): an exact draw from N(Q^-1 rhs, Q^-1): perturb the right-hand side, then solve. The noise is a function of seed and id."""
    white = factor.transpose_times(sites.select("id", normal("id", 2 * seed).alias("value"))).withColumnRenamed("value", "t")
    b = sites.join(white, "id").join(rhs.withColumnRenamed("value", "f"), "id")
    b = b.select("id", (F.col("f") + F.col("t") / F.col("sd") + F.sqrt("precision") * normal("id", 2 * seed + 1)).alias("value"))
    return conjugate_gradient(factor, sites, cut(b), places, tol, locs=locs)


def blocks_of(locs: DataFrame, rows: int = BLOCK) -> DataFrame:
    """(id, block) of locs(id, x, y): blocks of near locations, about `rows` each."""
    return dissect(locs, rows)[0].withColumnRenamed("leaf", "block")


@dataclass
class FieldTables(ObservationTable):
    """A model whose locations and observations are tables; a state's field is a table (id, value) and its factor a TableFactor.

    sites(id, x, y, design columns); near: neighbourhoods of sites with the range design; of ObservationTable's arrays only the numbers of columns are used.
    """

    sites: DataFrame = None
    near: DataFrame = None
    nn_self: DataFrame = None
    level: DataFrame = None
    places: DataFrame = None
    range_names: list[str] = field(default_factory=list)
    scale_names: list[str] = field(default_factory=list)
    loc_names: list[str] = field(default_factory=list)
    band_rows: int = triangular.BAND_ROWS
    tolerance: float = TOLERANCE
    _grams: dict = field(default_factory=dict)
    _stats: tuple = None
    _gathered: tuple = None

    @classmethod
    def build(cls, table: DataFrame, sites: DataFrame, nn: DataFrame, response, noise, range_names, scale_names, loc_columns=None, band_rows: int = triangular.BAND_ROWS, **more) -> FieldTables:
        """table(loc, z, response columns, noise columns); sites(id, x, y, columns); nn(child, k, parent), k from 1, parents earlier than children.

        loc_columns: {column of sites: place of the same regressor in `response`} of regressors that are constant within locations.
        """
        loc_columns = loc_columns or {}
        columns = list(dict.fromkeys(["id", "x", "y", *range_names, *scale_names, *loc_columns]))
        sites = cut(sites.select(F.col("id").cast("long").alias("id"), *columns[1:]).repartition("id"))
        own = sites.select(F.col("id").alias("child"), F.lit(0).alias("k"), F.col("id").alias("parent"))
        nn_self = cut(own.unionByName(nn.select(F.col("child").cast("long").alias("child"), F.col("k").cast("int").alias("k"), F.col("parent").cast("long").alias("parent"))).repartition("parent"))
        near = vecchia.neighbourhoods(nn_self, sites, tuple(dict.fromkeys(["x", "y", *range_names])))
        level = triangular.levels(nn_self.select(F.col("child").alias("row"), F.col("parent").alias("col")), sites.select("id"))
        table = cut(table.select(F.col("loc").cast("long").alias("loc"), F.col("z").cast("double").alias("z"), *dict.fromkeys([*response, *noise])).repartition("loc"))
        empty = lambda names: np.empty((0, len(names)))
        none = np.empty(0)
        return cls(
            empty("xy"), None, none, none, empty(response), empty(loc_columns), list(loc_columns.values()), empty(range_names), empty(scale_names), empty(noise),
            table=table, response=list(response), noise=list(noise), sites=sites, near=cut(near.repartition("child")), nn_self=nn_self, level=level, places=cut(blocks_of(sites)),
            range_names=list(range_names), scale_names=list(scale_names), loc_names=list(loc_columns), band_rows=band_rows, **more,
        )

    # ------------------------------------------------------------------------- locations

    def gram(self, name: str) -> np.ndarray:
        if name not in self._grams:
            names = self.range_names if name == "range" else self.scale_names
            pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
            one = self.sites.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
            self._grams[name] = self._symmetric(one, len(names), pairs)
        return self._grams[name]

    def factor(self, range_beta: np.ndarray) -> TableFactor:
        return TableFactor(cut(vecchia.factor_at(self.near, self.range_names, range_beta, self.smoothness)), self.level, self.band_rows)

    def _log_variance(self, beta: np.ndarray) -> Column:
        return self._dot(self.scale_names, beta)

    def with_sd(self, s: sampler.State) -> DataFrame:
        """sites with the field's standard deviation."""
        return self.sites.withColumn("sd", F.exp(0.5 * self._log_variance(s.scale_beta)))

    def prior_field(self, s: sampler.State, rng) -> DataFrame:
        white = self.sites.select("id", normal("id", int(rng.integers(1 << 60))).alias("value"))
        v = s.factor.solve(white)
        return cut(self.with_sd(s).join(v, "id").select("id", (F.col("sd") * F.col("value")).alias("value")))

    def posterior_field(self, s: sampler.State, rng) -> DataFrame:
        at = self.with_sd(s).join(self.location_sums(s), "id", "left").select("id", "sd", F.coalesce("s0", F.lit(0.0)).alias("precision"), F.coalesce("s1", F.lit(0.0)).alias("value"))
        at = cut(at)
        return draw_field(s.factor, at.select("id", "sd", "precision"), at.select("id", "value"), self.places, int(rng.integers(1 << 60)), self.tolerance, self.sites)

    def interwoven_system(self, s: sampler.State):
        q = len(self.loc_names)
        names = [f"_a{k}" for k in range(q + 1)]
        c = F.col("value") + self._dot(self.loc_names, s.beta[self.loc_columns])
        v = self.with_sd(s).join(s.field, "id").select("id", *[(e / F.col("sd")).alias(n) for n, e in zip(names, [*map(F.col, self.loc_names), c])])
        pairs = [(i, j) for i in range(q) for j in range(i, q + 1)]
        one = s.factor.times(v, names).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        return self._symmetric(one, q, [p for p in pairs if p[1] < q]), np.array([one[f"g{i}_{q}"] for i in range(q)])

    def shifted_field(self, s: sampler.State, by: np.ndarray) -> DataFrame:
        return cut(self.sites.join(s.field, "id").select("id", (F.col("value") + self._dot(self.loc_names, by)).alias("value")))

    def scaled_field(self, s: sampler.State, by: np.ndarray) -> DataFrame:
        return cut(self.sites.join(s.field, "id").select("id", (F.col("value") * F.exp(0.5 * self._log_variance(by))).alias("value")))

    # ------------------------------------------------------------------------- observations

    def _with_field(self, s: sampler.State) -> DataFrame:
        return self.table.join(s.field.select(F.col("id").alias("loc"), F.col("value").alias("field")), "loc")

    def location_sums(self, s: sampler.State) -> DataFrame:
        """(id, s0, s1, s2): sums of 1, e and e^2 over the noise variance, e = z - x beta; written once per state of beta and noise."""
        key = (s.beta.tobytes(), s.noise_beta.tobytes())
        if not self._stats or self._stats[0] != key:
            w = F.exp(-self._dot(self.noise, s.noise_beta))
            e = F.col("z") - self._dot(self.response, s.beta)
            got = self.table.groupBy(F.col("loc").alias("id")).agg(F.sum(w).alias("s0"), F.sum(w * e).alias("s1"), F.sum(w * e * e).alias("s2"))
            self._stats = (key, cut(got))
        return self._stats[1]

    def _misfit(self, s: sampler.State, w: DataFrame) -> float:
        """Half the weighted squares of e - w; w(id, value)."""
        at = self.location_sums(s).join(w, "id")
        v = F.col("value")
        return 0.5 * _sum(at, u=F.col("s2") - 2 * v * F.col("s1") + v * v * F.col("s0"))["u"]

    # ------------------------------------------------------------------------- potentials

    def gathered(self, v: DataFrame) -> DataFrame:
        """near with r, the values of v(id, value) at each neighbour, in the order of the neighbours."""
        r = self.nn_self.join(v.select(F.col("id").alias("parent"), "value"), "parent").groupBy("child").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("r"))
        return self.near.join(r.select("child", F.col("r.value").alias("r")), "child")

    def _standardised(self, s: sampler.State) -> DataFrame:
        return self.with_sd(s).join(s.field, "id").select("id", (F.col("value") / F.col("sd")).alias("value"))

    def _remembered(self, kind: str, s: sampler.State, make):
        """What a leapfrog asks twice at one state: written once, until field, factor or scale change."""
        key = (kind, id(s.field), id(s.factor), s.scale_beta.tobytes())
        if not self._gathered or self._gathered[0] != key:
            self._gathered = (key, make(), s.field, s.factor)  # the objects are kept, so that their numbers stay theirs
        return self._gathered[1]

    def range_potential(self, s: sampler.State, beta: np.ndarray, ancillary: bool):
        basis = sampler.canonical_range(np.eye(3)) if beta.shape[1] == 3 else np.array([[2.0]])
        prior, slope = sampler._prior(s, self, "range", beta), sampler._prior_gradient(s, self, "range", beta)
        f = self.factor(beta)
        if not ancillary:
            near = self._remembered("r", s, lambda: cut(self.gathered(self._standardised(s))))
            squares, logs, g = vecchia.range_sums(near, self.range_names, beta, self.smoothness, log_det=True)
            return -prior + 0.5 * squares - logs, -slope + g @ basis.T, f
        white = self._remembered("white", s, lambda: cut(s.factor.times(self._standardised(s))))
        sd = self.with_sd(s).select("id", "sd")
        w = cut(f.solve(white).join(sd, "id").select("id", (F.col("sd") * F.col("value")).alias("value"), "sd"))
        u = -prior + self._misfit(s, w.select("id", "value"))
        pull = w.join(self.location_sums(s), "id", "left").select("id", (F.coalesce(F.col("s1") - F.col("value") * F.col("s0"), F.lit(0.0)) * F.col("sd")).alias("value"))
        left = f.transpose_solve(pull).select(F.col("id").alias("child"), F.col("value").alias("l"))
        near = self.gathered(w.select("id", (F.col("value") / F.col("sd")).alias("value"))).join(left, "child")
        g = vecchia.range_sums(near, self.range_names, beta, self.smoothness)[2]
        f.close()
        return u, -slope + g @ basis.T, (f, w.select("id", "value"))

    def scale_potential(self, s: sampler.State, beta: np.ndarray, ancillary: bool):
        prior, slope = sampler._prior(s, self, "scale", beta), sampler._prior_gradient(s, self, "scale", beta)
        names, log_s = self.scale_names, self._log_variance(beta)
        at = self.sites.join(s.field, "id")
        if ancillary:
            at = at.withColumn("w", F.col("value") * F.exp(0.5 * (log_s - self._log_variance(s.scale_beta)))).join(self.location_sums(s), "id")
            w = F.col("w")
            u, g = 0.5 * (F.col("s2") - 2 * w * F.col("s1") + w * w * F.col("s0")), 0.5 * w * (w * F.col("s0") - F.col("s1"))
        else:
            at = at.withColumn("v", F.col("value") * F.exp(-0.5 * log_s))
            lv = cut(s.factor.times(at.select("id", F.col("v").alias("value"))))
            at = at.join(lv.withColumnRenamed("value", "lv"), "id").join(s.factor.transpose_times(lv).withColumnRenamed("value", "t"), "id")
            u, g = 0.5 * log_s + 0.5 * F.col("lv") * F.col("lv"), 0.5 - 0.5 * F.col("v") * F.col("t")
        got = _sum(at, u=u, **{f"g{k}": F.col(n) * g for k, n in enumerate(names)})
        return -prior + got["u"], -slope + np.array([[got[f"g{k}"]] for k in range(len(names))])


def run_chain(d: FieldTables, chain: int, n: int, seed: int = 1, state: sampler.State | None = None, start: int = 0, hyper: bool = True, with_field: bool = True):
    """(state, records) of n iterations: parameters as rows from the driver, the field's as the tables they are."""
    spark = d.sites.sparkSession
    s = state or sampler.initial_state(d, seed, chain)
    if s.factor is None:
        s.factor = d.factor(s.range_beta)
    rng = np.random.Generator(np.random.PCG64([seed, chain, start + 1]))
    rows, fields = [], None
    for it in range(start + 1, start + n + 1):
        sampler.step(s, d, it, rng, hyper)
        rows += sampler.record(s, chain, it, with_field=False)
        if with_field:
            part = s.field.select(F.lit(chain).alias("chain"), F.lit(it).alias("iteration"), F.lit("field").alias("param"), (F.col("id") + 1).cast("int").alias("i"), F.lit(1).alias("j"), "value")
            fields = part if fields is None else fields.unionByName(part)
    records = spark.createDataFrame(rows, sampler.RECORDS)
    return s, records if fields is None else records.unionByName(fields)
