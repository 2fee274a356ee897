"""Whitening of embeddings by a tall-skinny QR: rows are centred with exact sums, each partition keeps the triangular factor of its rows,
factors are merged in a tree of small groups, and the singular vectors of the last one whiten; no covariance matrix is formed.

Entries are put on a grid of whole numbers first, so that counts, sums and deviations are exact, and every distinct grid vector counts once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.llm.common import cut

#: Steps of the grid per unit, and its origin.
GRID, ORIGIN = 64, 1_000_000
#: Components that rows are projected on, at most.
COMPONENTS = 16
#: Factors that one task merges.
FAN = 8
#: Entries whose grid value a long can't hold surely count as not finite.
_LARGEST = float(1 << 61)
_ROWS = 8192  # rows that are stacked under a factor at once


def grid(vec) -> F.Column:
    """The grid vector of an array column: floor(64 c) + 1,000,000 of every entry as double."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * GRID).cast("long") + ORIGIN)


def usable(vec) -> F.Column:
    """True for arrays without null, non-finite or immense entries."""
    return F.coalesce(F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) * GRID < _LARGEST, F.lit(False))), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(batches, dim):
    """One row per dimension: the exact sum of its entries as high and low part, and the number of rows."""
    high, low, n, most = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0, 0
    for b in batches:
        x = _matrix(b.column("x"), dim)
        high += (x >> 31).sum(0)
        low += (x & 0x7FFFFFFF).sum(0)
        n += len(x)
        most = max(most, int(np.abs(x).max(initial=0)))
    cols = [np.arange(dim, dtype=np.int64), high, low, np.full(dim, n, np.int64), np.full(dim, most, np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "high", "low", "n", "most"])


class Centre:
    """Number of rows, exact sums per dimension, and the largest entry: what centring needs."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums = n, sums
        self.exact = 2 * n * max(1, most) < 1 << 62  # n x - S fits a long

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as longs, or as Python's whole numbers where longs don't hold it."""
        if self.exact:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: one rounding after an exact difference."""
        return (self.shifted(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row, exactly; None where a long can't hold it."""
        d = self.shifted(x)
        if self.exact and float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (d * d).sum(1).tolist()
        d = d.astype(object)
        every = (d * d).sum(1)
        return [int(v) if v < 1 << 63 else None for v in every]


def _factors(batches, dim, centre):
    """The triangular factor of a partition's centred rows, as one row."""
    from pyspark import TaskContext

    r = np.zeros((0, dim))
    for b in batches:
        x = _matrix(b.column("x"), dim)
        for s in range(0, len(x), _ROWS):
            r = np.linalg.qr(np.vstack([r, centre.value.rows(x[s : s + _ROWS])]), mode="r")
    if len(r):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["at", "part"])


def tree(parts: DataFrame, merge, fan: int = FAN) -> np.ndarray | None:
    """Merges parts(at, part) in groups of `fan` until one is left and returns it; merge takes a list of flat arrays. The driver gets the last one only."""
    schema = "at long, part array<double>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [int(pdf["up"].iloc[0])], "part": [merge([np.asarray(p, float) for p in pdf.sort_values("at")["part"]])]})

    while True:
        parts = cut(parts)
        span = parts.agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).first()
        if span.n <= 1:
            got = parts.first()
            return None if got is None else np.asarray(got.part, float)
        if span.last < span.n * fan:  # numbers lie close, so that each round leaves a fan-th of them
            parts = parts.withColumn("up", F.expr(f"at div {fan}"))
        else:
            parts = parts.withColumn("up", F.expr(f"pmod(xxhash64(at), {max(1, -(-span.n // fan))})"))
        parts = parts.groupBy("up").applyInPandas(one, schema)


def _merge_factors(parts, dim):
    return np.linalg.qr(np.vstack([p.reshape(-1, dim) for p in parts]), mode="r").ravel()


def _moments(batches, dim, model):
    """Of a partition's whitened rows: number, mean and sums of products about the mean."""
    from pyspark import TaskContext

    centre, axes, _ = model.value
    whole = None
    for b in batches:
        x = _matrix(b.column("x"), dim)
        for s in range(0, len(x), _ROWS):
            w = centre.rows(x[s : s + _ROWS]) @ axes
            m = w.mean(0)
            one = np.concatenate([[len(w)], m, ((w - m).T @ (w - m)).ravel()])
            whole = one if whole is None else _merge_moments([whole, one], axes.shape[1])
    if whole is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([whole], pa.list_(pa.float64()))], ["at", "part"])


def _merge_moments(parts, k):
    n, m, c = 0.0, np.zeros(k), np.zeros((k, k))
    for p in parts:
        n1, m1, c1 = p[0], p[1 : 1 + k], p[1 + k :].reshape(k, k)
        both = n + n1
        d = m1 - m
        c = c + c1 + np.outer(d, d) * (n * n1 / both)
        m, n = m + d * (n1 / both), both
    return np.concatenate([[n], m, c.ravel()])


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(batches, dim, model, error):
    centre, axes, explained = model.value
    k = len(explained)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for b in batches:
        ids = b.column("id")
        for s in range(0, b.num_rows, _ROWS):
            x = _matrix(b.column("x").slice(s, _ROWS), dim)
            at = np.repeat(np.arange(len(x)), k)
            w = np.full((len(x), k), np.nan)
            w[:, : axes.shape[1]] = centre.rows(x) @ axes
            cols = [
                ids.slice(s, _ROWS).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), centre.n)),
                pa.array(centre.deviations(x), pa.int64()).take(pa.array(at)),
                pa.array(w.ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(x)), from_pandas=True),
                pa.array(np.full(len(at), error), from_pandas=True),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable row's grid vector projected on the first components of the distinct grid vectors, over their standard deviations.

    Returns SCHEMA, a row per row and component: n distinct vectors; the row's deviation (sum of (n x - S)^2, null where a long can't hold it);
    whitened; the component's share of the trace; and the largest error of the whitened vectors' covariance against the identity.
    Rows whose vector is null or holds null, non-finite or immense (2^61 / 64) entries are dropped; so are those whose length isn't the one that
    most rows have (the larger, if two tie) and empty ones. Null and repeated ids are kept, a row each; other columns aren't read. A component
    without variance (to rounding) has whitened null and stays out of the error; without any variance explained and error are null. An
    empty table gives an empty one.

    A pass finds the distinct vectors (one shuffle, combined before it; written once), one over those their sums, one their factor, one the error;
    the last reads all rows again. A task holds a factor of dim x dim and a block of rows, a merge FAN factors; the driver holds sums and one factor.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    dim = sizes.d
    rows = rows.where(F.size("v") == dim).select("id", grid("v").alias("x"))
    fit = cut(rows.select("x").distinct())
    per = fit.mapInArrow(partial(_sums, dim=dim), "k long, high long, low long, n long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    per = per.groupBy("k").agg(wide("high"), wide("low"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("k").collect()  # dim rows
    centre = Centre(per[0].n, [(int(p.high) << 31) + int(p.low) for p in per], max(p.most for p in per))
    shared = spark.sparkContext.broadcast(centre)
    r = tree(fit.mapInArrow(partial(_factors, dim=dim, centre=shared), "at long, part array<double>"), partial(_merge_factors, dim=dim))
    _, s, v = np.linalg.svd(r.reshape(-1, dim))
    s = np.concatenate([s, np.zeros(dim - len(s))])
    k = min(components, dim)
    sure = int((s[:k] > s[0] * max(centre.n, dim) * np.finfo(float).eps).sum())
    explained = s[:k] ** 2 / (s**2).sum() if s[0] > 0 else np.full(k, np.nan)
    axes = v[:sure].T / (s[:sure] / np.sqrt(centre.n))
    model = spark.sparkContext.broadcast((centre, axes, explained))
    error = np.nan
    if sure:
        m = tree(fit.mapInArrow(partial(_moments, dim=dim, model=model), "at long, part array<double>"), partial(_merge_moments, k=sure))
        error = float(np.abs(m[1 + sure :].reshape(sure, sure) / m[0] - np.eye(sure)).max())
    return rows.mapInArrow(partial(_project, dim=dim, model=model, error=error), SCHEMA)
