"""Prediction of the field at any number of new locations, a region a task.

New locations hang on observed ones and on new ones that come earlier. A region's task needs its own locations, the new ones that they
hang on, and what those hang on in turn; with all of these it draws them in order by itself. Noise is a function of sample and
location, so a location that several regions need is the same in all of them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.functions.kernels import canonical_range
from terrafield.operators.cholesky import dissect
from terrafield.operators.noise import normals
from terrafield.operators.sampler import _row_batches
from terrafield.operators.linalg import Graph
from terrafield.operators.vecchia import factor_rows
from terrafield.session import cut

#: Locations of a region, about.
REGION = 2000
#: Numbers of all samples' coefficients that go to the tasks, at most.
COEFFICIENTS = 5_000_000


def halos(places: DataFrame, nn: DataFrame) -> DataFrame:
    """(region, id, own) of places(id, region): a region's locations, and all new ones that they hang on by nn(child, parent), directly or not.

    A round adds the parents of what the last one added; there are as many as levels of the graph at most.
    """
    new = nn.join(places.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id"), "parent")
    new = cut(new)
    have = cut(places.select("region", "id"))
    last = have
    while True:
        more = last.join(new, "id").select("region", F.col("parent").alias("id")).distinct()
        last = cut(more.join(have, ["region", "id"], "left_anti"))
        if last.isEmpty():
            break
        have = cut(have.unionByName(last))
    return have.join(places.select("id", F.col("region").alias("home")), "id").select("region", "id", (F.col("home") == F.col("region")).alias("own"))


def _region(points: pd.DataFrame, known: pd.DataFrame, shared, smoothness: float, noise: bool) -> pd.DataFrame:
    """Draws of one region: points(id, own, x, y, xr, xs, parents), known(id, x, y, xr, xs, vals) with a value per sample."""
    params = shared.value
    points, known = points.sort_values("id"), known.sort_values("id")
    ids = np.concatenate([known["id"].to_numpy(np.int64), points["id"].to_numpy(np.int64)])  # new ids follow the observed ones
    n, m = len(known), len(points)
    matrix = lambda c: np.array([*known[c], *points[c]], float).reshape(n + m, -1)
    xy = np.column_stack([matrix("x"), matrix("y")])
    xr, xs = matrix("xr"), matrix("xs")
    width = 1 + max(map(len, points["parents"]))
    parents = np.full((m, width), -1, np.int64)
    parents[:, 0] = n + np.arange(m)
    for i, p in enumerate(points["parents"]):
        parents[i, 1 : 1 + len(p)] = np.searchsorted(ids, p)
    graph = Graph(np.where(parents >= n, parents - n, -1))
    vals = np.array(list(known["vals"]), float).reshape(n, len(params))
    near, own = np.where(parents >= 0, parents, 0), points["own"].to_numpy(bool)
    out = np.empty((m, len(params)))
    for k, (range_beta, scale_beta, seed) in enumerate(params):
        f, sd = xr @ canonical_range(range_beta), np.exp(0.5 * (xs @ scale_beta)[:, 0])
        coef = np.zeros(parents.shape)
        for rows, nb in _row_batches(parents):
            coef[rows, : nb.shape[1]] = factor_rows(xy[nb], f[nb], smoothness)[0]
        white = np.concatenate([vals[:, k] / sd[:n], np.zeros(m)])
        z = normals(ids[n:], seed) if noise else np.zeros(m)
        for rows in graph.levels:
            rest = (coef[rows, 1:] * white[near[rows, 1:]]).sum(1)
            white[n + rows] = (z[rows] - rest) / coef[rows, 0]
        out[:, k] = (sd * white)[n:]
    return pd.DataFrame({"id": points["id"].to_numpy()[own], "values": list(out[own])})


def predict(new: DataFrame, observed: DataFrame, nn: DataFrame, field: DataFrame, params: list, smoothness: float = 1.5, noise: bool = True, region: int = REGION) -> DataFrame:
    """(id, values): a draw per sample of the field at new(id, x, y, xr, xs), given the field at observed(id, x, y, xr, xs); its conditional mean without noise.

    xr, xs: arrays, the designs of range and scale; ids of new follow those of observed. nn(child, parent): what each new location hangs on, earlier
    ones only. field(sample, id, value) has every observed location in each sample, numbered from 0; params: (range_beta, scale_beta, seed) per sample.
    """
    if sum(np.size(a) + np.size(b) for a, b, _ in params) > COEFFICIENTS:
        raise ValueError(f"more than {COEFFICIENTS} coefficients of samples at once")
    leaves, _ = dissect(new, region)
    places = cut(leaves.withColumnRenamed("leaf", "region"))
    need = cut(halos(places, nn))
    hang = nn.groupBy("child").agg(F.sort_array(F.collect_list("parent")).alias("parents")).withColumnRenamed("child", "id")  # as many as neighbours
    columns = ["x", "y", "xr", "xs"]
    points = cut(need.join(new.select("id", *columns), "id").join(hang, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<long>"))))
    vals = field.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("v")).select("id", F.col("v.value").alias("vals"))  # a value per sample
    of = cut(points.select("region", F.explode("parents").alias("id")).distinct())
    known = of.join(observed.select("id", *columns), "id").join(vals, "id")
    known = known.toDF(*known.columns)  # columns of their own, as both sides of the grouping come from the same tables
    shared = new.sparkSession.sparkContext.broadcast(params)
    run = partial(_region, shared=shared, smoothness=smoothness, noise=noise)
    return points.groupBy("region").cogroup(known.groupBy("region")).applyInPandas(lambda a, b: run(a, b), "id long, values array<double>")
