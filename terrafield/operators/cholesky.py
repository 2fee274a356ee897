"""Sparse Cholesky factors of precision matrices over locations: nested dissection, and a front per node of the separator tree.

Locations are halved along their wider axis, again and again; of each entry of the matrix that crosses a cut, the lower half's end goes to the
cut's separator. Below their separators the halves have nothing in common, so the fronts of a depth of the tree are
eliminated at once, a task each: a front takes its own entries and what its two children left, and leaves what its ancestors need. The rightmost
columns carry a right-hand side along. Solutions come down the tree, a join per depth.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.operators.noise import normals
from terrafield.session import cut

#: Locations of a leaf of the tree, about.
LEAF = 256
#: Locations that the cuts are found on, at most: those of the smallest hashes.
SAMPLE = 65_536
#: Variables of a front, at most: 8 bytes times half their square are shuffled in one value.
FRONT = 16_000

_NODES = "node long, own array<long>, boundary array<long>, l11 array<double>, l21 array<double>, y array<double>, rest array<double>, carried array<double>"


def dissect(locs: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """(places(id, leaf), depth): the leaf of each of locs(id, x, y), numbered as in a heap: the root is 1, node k has the halves 2 k and 2 k + 1.

    Cuts are medians of a sample, so leaves are about equal; a leaf has 8 rows of the sample at least. Places that coincide share a leaf.
    """
    n = locs.count()
    h = F.xxhash64("id")
    some = locs if n <= sample else locs.where(F.shiftrightunsigned(h, 11) < F.lit(int(1.5 * sample / n * 2**53)))
    xy = some.orderBy(h, "id").limit(sample).select("x", "y").toPandas().to_numpy(float)
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(xy) / 8)))))
    cuts = np.zeros((1 << depth, 2))  # by node: axis, value
    todo = [(1, xy)]
    while todo:
        k, part = todo.pop()
        if k >= 1 << depth:
            continue
        axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
        at = float(np.median(part[:, axis])) if len(part) else 0.0
        cuts[k] = axis, at
        low = part[:, axis] <= at
        todo += [(2 * k, part[low]), (2 * k + 1, part[~low])]
    shared = locs.sparkSession.sparkContext.broadcast(cuts)
    return locs.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(partial(_descend, cuts=shared, depth=depth), "id long, leaf long"), depth


def _descend(batches, cuts, depth):
    cuts = cuts.value
    for b in batches:
        xy = np.column_stack([b.column("x").to_numpy(), b.column("y").to_numpy()])
        at = np.ones(len(xy), np.int64)
        for _ in range(depth):
            axis = cuts[at, 0].astype(int)
            at = 2 * at + (xy[np.arange(len(xy)), axis] > cuts[at, 1])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at)], ["id", "leaf"])


def separators(entries: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """(id, node): the tree node that a variable is eliminated in; entries(a, b, value) of a symmetric matrix, both triangles.

    Of an entry between two halves, the variable in the lower one belongs to the separator of their cut or of one above.
    """
    a, b = places.select(F.col("id").alias("a"), F.col("leaf").alias("leaf_a")), places.select(F.col("id").alias("b"), F.col("leaf").alias("leaf_b"))
    far = entries.select("a", "b").join(a, "a").join(b, "b").where("leaf_a < leaf_b")
    up = far.groupBy(F.col("a").alias("id")).agg(F.max(F.length(F.bin(F.col("leaf_a").bitwiseXOR(F.col("leaf_b"))))).alias("up"))
    return places.join(up, "id", "left").select("id", F.expr("shiftright(leaf, coalesce(up, 0))").alias("node"))


def _packed(m: np.ndarray) -> np.ndarray:
    return m[np.tril_indices(len(m))]


def _unpacked(v, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    m[np.tril_indices(n)] = v
    return m


def eliminate(own: np.ndarray, boundary: np.ndarray, front: np.ndarray, f: np.ndarray):
    """(l11, l21, y, rest, carried) of a front over own and boundary variables: its factor, the solved own part of f, and what is left to ancestors."""
    k = len(own)
    l11 = np.linalg.cholesky(front[:k, :k])
    l21 = np.linalg.solve(l11, front[:k, k:]).T
    y = np.linalg.solve(l11, f[:k])
    return l11, l21, y, front[k:, k:] - l21 @ l21.T, f[k:] - l21 @ y


def _front(entries: pd.DataFrame, children: pd.DataFrame, most: int) -> pd.DataFrame:
    """One node: entries(node, a, b, own_a, own_b, value), b null for the right-hand side; children(node, boundary, rest, carried)."""
    node = int((entries if len(entries) else children)["node"].iloc[0])
    a, value, own_a = entries["a"].to_numpy(np.int64), entries["value"].to_numpy(float), entries["own_a"].to_numpy(bool)
    right = entries["b"].isna().to_numpy()
    b = entries["b"].fillna(-1).to_numpy(np.int64)
    own = np.unique(np.concatenate([a[own_a], b[entries["own_b"].to_numpy(bool) & ~right]])) if len(a) else np.empty(0, np.int64)
    every = np.unique(np.concatenate([a, b[~right], *[np.asarray(x, np.int64) for x in children["boundary"]]]))
    boundary = np.setdiff1d(every, own, assume_unique=True)
    if len(every) > most:
        raise ValueError(f"a front of {len(every)} variables, more than {most}: draw such fields by conjugate gradients")
    ids = np.concatenate([own, boundary])
    order = np.argsort(ids, kind="stable")
    at = lambda v: order[np.searchsorted(ids, v, sorter=order)]
    front, f = np.zeros((len(ids),) * 2), np.zeros(len(ids))
    i, j, v = at(a[~right]), at(b[~right]), value[~right]
    np.add.at(front, (i, j), v)
    off = i != j
    np.add.at(front, (j[off], i[off]), v[off])
    np.add.at(f, at(a[right]), value[right])
    for bound, rest, carried in zip(children["boundary"], children["rest"], children["carried"]):
        p = at(np.asarray(bound, np.int64))
        u = _unpacked(np.asarray(rest, float), len(p))
        front[np.ix_(p, p)] += u + np.tril(u, -1).T
        f[p] += np.asarray(carried, float)
    l11, l21, y, rest, carried = eliminate(own, boundary, front, f)
    return pd.DataFrame({"node": [node], "own": [own], "boundary": [boundary], "l11": [_packed(l11)], "l21": [l21.ravel()], "y": [y], "rest": [_packed(rest)], "carried": [carried]})


def _solved(batches, seed):
    """Own values of nodes(node, own, boundary, l11, l21, y) whose ancestors' are there: ids, vals. Sends down ids and values of both."""
    for b in batches:
        out = [], [], [], [], []
        for node, own, boundary, l11, l21, y, ids, vals in zip(*[b.column(c) for c in ("node", "own", "boundary", "l11", "l21", "y", "ids", "vals")]):
            array = lambda x, t: x.values.to_numpy(zero_copy_only=False).astype(t) if x.is_valid else np.empty(0, t)
            own, boundary = array(own, np.int64), array(boundary, np.int64)
            x = array(vals, float)[np.searchsorted(array(ids, np.int64), boundary)] if len(boundary) else np.empty(0)
            right = array(y, float) + (normals(own, seed) if seed is not None else 0.0)
            right = right - array(l21, float).reshape(len(boundary), len(own)).T @ x
            got = np.linalg.solve(_unpacked(array(l11, float), len(own)).T, right)
            every, values = np.concatenate([own, boundary]), np.concatenate([got, x])
            order = np.argsort(every)
            for c, v in zip(out, (node.as_py(), every[order], values[order], own, got)):
                c.append(v)
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), longs, doubles, longs, doubles))], ["node", "ids", "vals", "own", "got"])


@dataclass
class Cholesky:
    """Factor of a precision matrix, a row of `nodes` per tree node, by depth; y is the lower factor's solution of the right-hand side."""

    nodes: list[DataFrame]
    log_det: float
    variables: int
    nonzeros: int  # of the factor
    entries: int  # of the matrix's lower triangle

    @property
    def fill(self) -> float:
        return self.nonzeros / max(1, self.entries)

    @classmethod
    def of(cls, precision: DataFrame, locs: DataFrame, rhs: DataFrame | None = None, leaf: int = LEAF, most: int = FRONT) -> Cholesky:
        """precision(a, b, value), both triangles, of locs(id, x, y), with a diagonal entry per location; rhs(id, value).

        Fronts of a depth are tasks; what is left to a parent is written once per depth. Not positive definite: numpy's LinAlgError.
        """
        places, depth = dissect(locs, leaf)
        places = cut(places)
        at = cut(separators(precision, places, depth))
        lower = precision.where("a >= b")
        na, nb = at.select(F.col("id").alias("a"), F.col("node").alias("na")), at.select(F.col("id").alias("b"), F.col("node").alias("nb"))
        # the deeper of both nodes owns an entry; the other one is it or lies above it
        rows = lower.join(na, "a").join(nb, "b").select(F.greatest("na", "nb").alias("node"), "a", "b", (F.col("na") >= F.col("nb")).alias("own_a"), (F.col("nb") >= F.col("na")).alias("own_b"), "value")
        if rhs is not None:
            right = rhs.select(F.col("id").alias("a"), "value").join(na, "a")
            rows = rows.unionByName(right.select(F.col("na").alias("node"), "a", F.lit(None).cast("long").alias("b"), F.lit(True).alias("own_a"), F.lit(False).alias("own_b"), "value"))
        rows = cut(rows.withColumn("depth", F.length(F.bin("node")) - 1))
        nodes, left = [], None
        for d in range(depth, -1, -1):
            mine = rows.where(F.col("depth") == d).drop("depth")
            left = left if left is not None else mine.sparkSession.createDataFrame([], "node long, boundary array<long>, rest array<double>, carried array<double>")
            done = cut(mine.groupBy("node").cogroup(left.groupBy("node")).applyInPandas(lambda a, b: _front(a, b, most), _NODES))
            left = done.select(F.shiftright("node", 1).alias("node"), "boundary", "rest", "carried").where(F.size("boundary") > 0)
            nodes.append(done.select("node", "own", "boundary", "l11", "l21", "y"))
        nodes.reverse()
        every = nodes[0]
        for n in nodes[1:]:
            every = every.unionByName(n)
        k, b = F.size("own"), F.size("boundary")
        # the diagonal's places in a packed lower triangle: i (i + 3) / 2
        logs = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, i: s + F.ln(F.get("l11", (i * (i + 3) / 2).cast("int"))))
        one = every.where(k > 0).agg(F.sum(logs).alias("l"), F.sum(k).alias("n"), F.sum((k * (k + 1) / 2 + k * b).cast("long")).alias("nz")).first()
        return cls(nodes, 2 * (one.l or 0.0), one.n or 0, one.nz or 0, lower.count())

    def solve(self, seed: int | None = None) -> DataFrame:
        """(id, value): Q^-1 rhs, plus with a seed a draw from N(0, Q^-1): the upper factor's solution of y, or of y plus noise."""
        parts, above = [], None
        for d, rows in enumerate(self.nodes):
            if above is None:
                rows = rows.withColumns({"ids": F.array().cast("array<long>"), "vals": F.array().cast("array<double>")})
            else:
                rows = rows.withColumn("up", F.shiftright("node", 1)).join(above.withColumnRenamed("node", "up"), "up", "left")
            done = cut(rows.mapInArrow(partial(_solved, seed=seed), "node long, ids array<long>, vals array<double>, own array<long>, got array<double>"))
            above = done.select("node", "ids", "vals")
            parts.append(done.select(F.explode(F.arrays_zip("own", "got")).alias("e")).select(F.col("e.own").alias("id"), F.col("e.got").alias("value")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
