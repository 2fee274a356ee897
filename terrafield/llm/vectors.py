"""Inverted lists of coarse centroids with product-quantised residuals, for near-dedup and for nearest neighbours.

A vector's list is its nearest centroid. What is left of it after that centroid is cut into subspaces, each coded by the
nearest of up to 256 codewords. The asymmetric distance from a query to a code is a sum of table lookups; with the
residual's own quantisation error, which is kept beside the code, the triangle inequality bounds the true
distance, so the lookups prune and an exact rerank on the original vectors decides.
Lists lie in an order in which neighbours follow one another, so that runs of lists make bins of a bounded number of rows.
A bin with more rows, or with more visitors, than a task should hold is cut on both sides into blocks that meet
pairwise. Only centroids and arrays of one number per list are sent to all tasks, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafield.llm.common import LocalUnion, components, cut, hinted

#: Vectors that the index is fitted on, at most: of all valid rows those of the smallest hashes. From a sixteenth of the rows beyond 262,144.
SAMPLE = (16_384, 65_536)
#: Lists of an index, at most.
MAX_LISTS = 8192
#: Members and visitors of a bin that one task compares.
BIN_ROWS, VISITORS = 4096, 8192


@dataclass
class Index:
    """Coarse centroids, codewords by subspace, and the columns of each subspace."""

    centroids: np.ndarray  # lists x dim
    words: list[np.ndarray]  # per subspace: codewords x columns
    cuts: list[tuple[int, int]]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _closest(x, self.centroids)[0]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation error) of vectors in their lists."""
        rest = x - self.centroids[lists]
        codes = np.stack([np.argmin(_sq(rest[:, a:b], w), axis=1) for (a, b), w in zip(self.cuts, self.words)], axis=1).astype(np.uint8)
        back = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return codes, np.linalg.norm(rest - back, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """What the lookups of a query sum up, for every list alike: squared length of each codeword less twice its product
        with the query. queries x subspaces x 256."""
        out = np.full((len(q), len(self.words), 256), np.inf)
        for k, ((a, b), w) in enumerate(zip(self.cuts, self.words)):
            out[:, k, : len(w)] = (w * w).sum(1) - 2 * (q[:, a:b] @ w.T)
        return out

    def offsets(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The codes' own share of a lookup: twice the product of what they stand for with their list's centroid."""
        c = self.centroids[lists]
        return sum(2 * (c[:, a:b] * w[codes[:, k]]).sum(1) for k, ((a, b), w) in enumerate(zip(self.cuts, self.words)))

    def lookup(self, tables: np.ndarray, base: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distances from queries to codes, queries x codes: |q - c - w|^2 = |q - c|^2 + 2 c w + (|w|^2 - 2 q w).

        base: the queries' squared distances to the codes' centroids.
        """
        d = base + offsets
        for k in range(codes.shape[1]):
            d += tables[:, k][:, codes[:, k]]
        return np.sqrt(np.maximum(d, 0))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _closest(x: np.ndarray, c: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest row of c to each row of x."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), block):
        d = _sq(x[i : i + block], c)
        own[i : i + block] = d.argmin(1)
        far[i : i + block] = d.min(1)
    return own, far


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]].copy()
    for _ in range(rounds):
        own, away = _closest(x, c)
        n = np.bincount(own, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        full = n > 0
        c[full] = s[full] / n[full, None]
        if not full.all():
            far = np.argsort(-away)[: int((~full).sum())]
            c[~full] = x[far]
    return c


def _arranged(c: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones follow one another: halves along the main axis, again and again."""
    out, todo = [], [np.arange(len(c))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            out.append(at)
            continue
        x = c[at] - c[at].mean(axis=0)
        axis = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(6):
            axis = x.T @ (x @ axis)
            axis = axis / max(np.linalg.norm(axis), 1e-300)
        at = at[np.argsort(x @ axis, kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.concatenate(out)


def fit(sample: np.ndarray, lists: int, subspaces: int = 8, seed: int = 11) -> Index:
    dim = sample.shape[1]
    subspaces = max(1, min(subspaces, dim))
    coarse = kmeans(sample, max(1, lists), 8, seed)
    coarse = coarse[_arranged(coarse)]
    own = _closest(sample, coarse)[0]
    rest = sample - coarse[own]
    edges = np.linspace(0, dim, subspaces + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    few = rest[np.random.default_rng(seed).permutation(len(rest))[:4096]]
    return Index(coarse, [kmeans(few[:, a:b], 256, 6, seed + k) for k, (a, b) in enumerate(cuts)], cuts)


def valid(vec) -> F.Column:
    """True for vectors without null or non-finite components that aren't zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(col) -> np.ndarray:
    """A list column without nulls, all of one length, as a float64 matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, components summed from the first to the last, so that any plain loop in double precision gives the same."""
    return np.sqrt(np.add.accumulate((x - q) ** 2, axis=1)[:, -1])


def _padded(col, dim: int) -> np.ndarray:
    """Vectors scaled to length 1, whatever their number of components, as their first `dim` components, with zeros beyond the last."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(col.offsets.to_numpy())
    if (n == dim).all():
        return _unit(_matrix(col)) if len(n) else np.empty((0, dim))
    out = np.zeros((len(n), dim))
    for size in np.unique(n):
        at = np.nonzero(n == size)[0]
        out[at, :size] = _unit(_matrix(col.take(pa.array(at))))[:, :dim]
    return out


def _vec(table: DataFrame, vec_col: str) -> F.Column:
    """The vectors as they are if they are lists of float, else as lists of double."""
    kind = table.schema[vec_col].dataType
    return F.col(f"`{vec_col}`") if kind.simpleString() == "array<float>" else F.col(f"`{vec_col}`").cast("array<double>")


def _sampled(rows: DataFrame, n: int, sample: tuple[int, int]) -> pa.ChunkedArray:
    """Vectors to fit on, by the hash of their key: a quarter of the n rows up to sample[0], a sixteenth from there to sample[1]."""
    want = min(max(256, min(sample[0], n // 4)) if n // 16 <= sample[0] else n // 16, max(sample))
    got = rows.where(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 20)) < int(min(1.0, 1.1 * want / max(1, n)) * (1 << 20)) + 1)
    return got.select("key", "vec").orderBy("key").limit(want).toArrow().column("vec")


def _dimension(rows: DataFrame) -> int:
    """The most frequent length."""
    top = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return top.dim if top else 0


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, written, with a number of each row's own in `key`: ids may repeat."""
    return cut(rows).withColumn("key", F.monotonically_increasing_id())


def _blocks(df: DataFrame, bin_cols: list[str], rows_per: int, visitors_per: int) -> DataFrame:
    """Rows to the blocks of their bins: df has a row per (row, bin) with `key`, `home` (a member of the bin) and `visit` (searches it).

    A bin's members are dealt over i blocks, its visitors over j, by hashes of their keys; the blocks meet pairwise. Adds i, j, and
    member and visitor, which say what a row is in that block. Bins that lack either are left out.
    """
    count = lambda c: F.sum(F.col(c).cast("long"))
    sizes = df.groupBy(*bin_cols).agg(count("home").alias("_n"), count("visit").alias("_p")).where("_n > 0 and _p > 0")
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in bin_cols], F.ceil(F.col("_n") / rows_per).alias("_k"), F.ceil(F.col("_p") / visitors_per).alias("_m"))
    rows = df.join(hinted(sizes), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in bin_cols]).drop(*[f"_{c}" for c in bin_cols])
    rows = rows.withColumns({"_i": F.pmod(F.xxhash64("key", F.lit("i")), F.col("_k")), "_j": F.pmod(F.xxhash64("key", F.lit("j")), F.col("_m"))})
    visits = F.expr("if(visit, transform(sequence(0L, _k - 1), x -> struct(x as i, _j as j)), array())")
    stays = F.expr("if(home, transform(sequence(0L, _m - 1), x -> struct(_i as i, x as j)), array())")
    rows = rows.withColumn("_at", F.explode(F.array_union(visits, stays))).select("*", F.col("_at.i").alias("i"), F.col("_at.j").alias("j"))
    rows = rows.withColumns({"member": F.col("home") & (F.col("i") == F.col("_i")), "visitor": F.col("visit") & (F.col("j") == F.col("_j"))})
    return rows.drop("_at", "_i", "_j", "_k", "_m", "home", "visit")


# ----------------------------------------------------------------------------- near-dedup

def _reachable(index: Index, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(own list, lists to search as a matrix of booleans) of each x.

    If x lies in list i and y, at `radius` or nearer, in list j, the way from x to y crosses the bisector of their centroids, so one of
    them lies within half the radius of it: |x - c_j|^2 - |x - c_i|^2 <= radius |c_j - c_i|. As every vector searches
    the lists whose bisectors are that near, one of each pair searches the other's list: nothing is missed.
    """
    c = index.centroids
    d2 = _sq(x, c)
    own = d2.argmin(1)
    far = np.sqrt(_sq(c[own], c))
    return own, d2 - d2[np.arange(len(x)), own][:, None] <= radius * far + 1e-9


def _radius(cos: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cos)) + 1e-9


def _listed(batches, index, dim, cos):
    ix = index.value
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            x = _padded(part.column("vec"), dim)
            own, reach = _reachable(ix, x, _radius(cos))
            codes, err = ix.encode(x, own)
            ends = np.concatenate(([0], np.cumsum(reach.sum(axis=1))))
            probes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(reach)[1], pa.int32()))
            cols = [pa.array(own, pa.int32()), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), part.column("vec")]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("key", "label", "size", "weight")] + cols, ["key", "label", "size", "weight", "own", "probes", "codes", "err", "vec"])


def _by_list(at: np.ndarray, to: np.ndarray):
    """(list, the rows that go to it) of rows at[k] that go to lists to[k]."""
    order = np.argsort(to, kind="stable")
    at, to = at[order], to[order]
    starts = np.nonzero(np.diff(to, prepend=-1))[0]
    yield from zip(to[starts].tolist(), np.split(at, starts[1:]))


def _compared(table: pa.Table, index, dim: int, cos: float) -> pa.Table:
    """Of one block of a bin: for each row, how many rows it links to here, and the smallest key of its local group.

    Every visitor searches the lists that it may have links in among the block's members. Two rows that search each other's list
    would meet twice: then only the meeting counts whose visitor has the larger key.
    """
    ix = index.value
    table = table.combine_chunks().sort_by("key")
    keys, own, weight, member, visitor = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "own", "weight", "member", "visitor"))
    x = _unit(_matrix(table.column("vec")))
    y = _padded(table.column("vec"), dim)
    members = np.nonzero(member)[0]
    codes = np.zeros((len(keys), len(ix.cuts)), np.uint8)  # those of visitors stay at home
    codes[members] = np.frombuffer(b"".join(table.column("codes").take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
    err = table.column("err").to_numpy()
    offsets = ix.offsets(codes, own)
    probes = table.column("probes").combine_chunks()
    flat = probes.flatten().to_numpy().astype(np.int64)
    prober = np.repeat(np.arange(len(keys)), np.diff(probes.offsets.to_numpy()))
    lists = len(ix.centroids)
    pairs = np.sort(prober * lists + flat)  # (row, list that it searches); a visitor brings only this bin's lists, a member all
    radius = _radius(cos)
    links = np.zeros(len(keys), np.int64)
    sets = LocalUnion(len(keys))
    by_list = {int(o): members[own[members] == o] for o in np.unique(own[members])}
    use = visitor[prober] & np.isin(flat, own[members])
    prober, flat = prober[use], flat[use]
    for s in range(0, len(keys), 512):
        now = (prober >= s) & (prober < s + 512)
        if not now.any():
            continue
        tables = ix.tables(y[s : s + 512])
        at, to = prober[now], flat[now]
        for lst, who in _by_list(at, to):
            cand = by_list[lst]
            base = _sq(y[who], ix.centroids[lst][None])
            for p in range(0, len(cand), 1024):
                few = cand[p : p + 1024]
                a, b = np.nonzero(ix.lookup(tables[who - s], base, codes[few], offsets[few]) <= radius + err[few] + 1e-6)
                a, b = who[a], few[b]
                back = own[a] + b * lists
                met_twice = pairs[np.minimum(np.searchsorted(pairs, back), len(pairs) - 1)] == back
                keep = (a != b) & (~met_twice | (a > b))
                a, b = a[keep], b[keep]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= cos
                a, b = a[near], b[near]
                if len(a):
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    sets.add(a, b)
    root = sets.all_roots()
    got = np.nonzero(links)[0]
    return pa.table({"key": pa.array(keys[got], pa.int64()), "n": pa.array(links[got], pa.int64()), "root": pa.array(keys[root[got]], pa.int64())})


def near_duplicates(table: DataFrame, cos: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", lists_per: int = 256, sample: tuple[int, int] = SAMPLE, bin_rows: int = BIN_ROWS, visitors: int = VISITORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of `table`.

    Linked are vectors of equal, non-null label and equal length whose cosine, in double precision, is `cos` or more. Equal vectors are one
    point with a weight. A vector searches every list that may hold a link (see _reachable), so no link is missed, there is
    no cap on lists, candidates or links, and a group of copies is counted in blocks, never emitted as pairs. Vectors that
    are null, zero, or hold null or non-finite components link with nothing, nor do rows without an id or a label: n_links 0,
    their own component. Rows that repeat an id are vectors of their own: each has its own links, also to rows of its id,
    and the component is the smallest id that any linked row has. An empty table gives an empty one. Other columns aren't read.
    """
    spark = table.sparkSession
    vec, size = F.col("vec"), F.size("vec")
    every = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), _vec(table, vec_col).alias("vec"), F.col(f"`{label_col}`").alias("label"))
    fine = valid(vec) & F.col("id").isNotNull() & F.col("label").isNotNull()
    every = every.select("id", "label", F.when(fine, vec).alias("vec"))
    every = every.withColumns({"h1": F.when(fine, F.xxhash64("vec", "label")), "h2": F.when(fine, F.xxhash64(F.lit("b"), "vec", "label"))})
    keyed = every.select("id", "h1", "h2")
    points = _numbered(every.where("vec is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    types = dict(points.dtypes)
    n = points.count()
    if not n:
        return keyed.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = _dimension(points)
    pts = _padded(_sampled(points, n, sample), dim)
    lists = max(1, min(MAX_LISTS, n // lists_per, len(pts) // 8))
    ix = fit(pts, lists)
    index = spark.sparkContext.broadcast(ix)
    listed = points.select("key", "label", size.alias("size"), "weight", "vec").mapInArrow(
        partial(_listed, index=index, dim=dim, cos=cos),
        f"key long, label {types['label']}, size int, weight long, own int, probes array<int>, codes binary, err double, vec {types['vec']}",
    )
    listed = cut(listed)
    # a bin is a run of lists that holds about bin_rows rows of a label
    per = listed.groupBy("label", "size").agg(F.greatest(F.lit(1.0), F.floor(F.lit(float(bin_rows * lists)) / F.count(F.lit(1)))).cast("int").alias("run"))
    run = F.col("run")
    sent = listed.join(hinted(per), ["label", "size"]).withColumns({"own_bin": F.expr("own div run"), "bin": F.explode(F.array_distinct(F.transform("probes", lambda p: F.floor(p / run))))})
    home = F.col("bin") == F.col("own_bin")
    here = F.filter("probes", lambda p: F.floor(p / run) == F.col("bin"))  # a visitor needs neither its code nor its other lists
    sent = sent.withColumns({"home": home, "visit": F.lit(True), "probes": F.when(home, F.col("probes")).otherwise(here), "codes": F.when(home, F.col("codes"))}).drop("own_bin", "run")
    stars = _blocks(sent, ["label", "size", "bin"], bin_rows, visitors)
    stars = cut(stars.groupBy("label", "size", "bin", "i", "j").applyInArrow(_compared_fn(index, dim, cos), "key long, n long, root long"))
    parts = components(stars.select(F.col("key").alias("a"), F.col("root").alias("b")))
    lowest = parts.join(points.select(F.col("key").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("part"))
    parts = parts.join(lowest, "component").select(F.col("node").alias("key"), "part")
    found = stars.groupBy("key").agg(F.sum("n").alias("n")).join(parts, "key", "left")
    of = points.select("key", "id", "h1", "h2", "weight").join(found, "key", "left")
    of = of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("part", "id").alias("part"))
    out = keyed.join(of, ["h1", "h2"], "left")
    part = F.coalesce("part", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col("id") == part, F.lit(True)).alias("kept"))


def _compared_fn(index, dim, cos):
    def run(table: pa.Table) -> pa.Table:
        return _compared(table, index, dim, cos)

    return run


# ----------------------------------------------------------------------------- nearest neighbours


def _placed(batches, index):
    ix = index.value
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            x = _matrix(part.column("vec"))
            own, d2 = _closest(x, ix.centroids)
            codes, err = ix.encode(x, own)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("id"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(np.sqrt(d2)), part.column("vec")],
                ["key", "id", "own", "codes", "err", "away", "vec"],
            )


def _bins(counts: np.ndarray, rows: int) -> np.ndarray:
    """The bin of each list: runs of lists that hold about `rows` rows, a larger list alone."""
    out, at, room = np.zeros(len(counts), np.int32), -1, 0
    for lst, n in enumerate(counts.tolist()):
        if n > room:
            at, room = at + 1, max(rows, n)
        out[lst] = at
        room -= n
    return out


def _routed(batches, index, probes, need, lists, more):
    """Queries to the bins of their nearest lists, as many lists more as hold `need` rows. With `more`, to the other lists that
    may hold a vector within the distance `kth`, by the lists' radii and the bisectors beside the query's own centroid."""
    ix, (counts, radii, bins) = index.value, lists.value
    c = ix.centroids
    for whole in batches:
        for s in range(0, whole.num_rows, 512):
            b = whole.slice(s, 512)
            q = _matrix(b.column("vec"))
            d2 = _sq(q, c)
            order = np.argsort(d2, axis=1, kind="stable")
            first = np.maximum(probes, (np.cumsum(counts[order], axis=1) < need).sum(axis=1) + 1)
            chosen = np.argsort(order, axis=1) < first[:, None]
            if more:
                near = order[:, 0]
                between = np.sqrt(np.maximum(_sq(c[near], c), 1e-300))
                low = np.maximum(np.sqrt(d2) - radii, (d2 - d2[np.arange(len(q)), near][:, None]) / (2 * between))
                chosen = ~chosen & (low <= b.column("kth").to_numpy()[:, None] + 1e-6 * (1 + np.sqrt(d2)))
            row, lst = np.nonzero(chosen & (counts > 0))
            # lists follow one another in bins: one row for each run of equal (query, bin)
            starts = np.nonzero((np.diff(row, prepend=-1) != 0) | (np.diff(bins[lst], prepend=-1) != 0))[0]
            wanted = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(lst, pa.int32()))
            t = b.take(pa.array(row[starts]))
            yield pa.RecordBatch.from_arrays([pa.array(bins[lst[starts]], pa.int32()), t.column("key"), t.column("id"), t.column("kth"), wanted, t.column("vec")], ["bin", "key", "id", "kth", "lists", "vec"])


def _searched(table: pa.Table, index, k: int) -> pa.Table:
    """Of one block of a bin: for each query its k nearest members, but for itself, none beyond the query's `kth`."""
    ix = index.value
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    table = table.sort_by([("id", "ascending"), ("key", "ascending")])
    members, queries = (table.filter(table.column(c)).combine_chunks() for c in ("member", "visitor"))
    if members.num_rows and queries.num_rows:
        keys, ids, own = (members.column(c).to_numpy() for c in ("key", "id", "own"))
        x = _matrix(members.column("vec"))
        codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        err = members.column("err").to_numpy()
        offsets = ix.offsets(codes, own)
        by_list = {int(o): np.nonzero(own == o)[0] for o in np.unique(own)}
        for s in range(0, queries.num_rows, 64):
            part = queries.slice(s, 64)
            q, qkeys, kth = _matrix(part.column("vec")), part.column("key").to_numpy(), part.column("kth").to_numpy()
            wants = part.column("lists").combine_chunks()
            tables = ix.tables(q)
            low = np.full((len(q), len(ids)), np.inf)  # lower bounds of the distances
            high = np.full((len(q), len(ids)), np.inf)
            for lst, who in _by_list(np.repeat(np.arange(len(q)), np.diff(wants.offsets.to_numpy())), wants.flatten().to_numpy().astype(np.int64)):
                rows = by_list.get(lst)
                if rows is None:
                    continue
                d = ix.lookup(tables[who], _sq(q[who], ix.centroids[lst][None]), codes[rows], offsets[rows])
                low[np.ix_(who, rows)] = d - err[rows] - 1e-6 * (1 + d)
                high[np.ix_(who, rows)] = d + err[rows] + 1e-6 * (1 + d)
            same = qkeys[:, None] == keys[None, :]
            low[same] = high[same] = np.inf
            # the k-th smallest upper bound: what lies surely beyond it can't be among the k nearest here
            most = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)
            near = (low <= np.minimum(most, kth * (1 + 1e-9))[:, None]) & np.isfinite(low)
            for r in range(len(q)):
                cand = np.nonzero(near[r])[0]
                if len(cand) > k:  # numpy's own sums come first: they differ in the last digits only
                    quick = ((x[cand] - q[r]) ** 2).sum(1)
                    cand = cand[quick <= np.partition(quick, k - 1)[k - 1] * (1 + 1e-9)]
                d = _distance(x[cand], q[r])
                best = np.argsort(d, kind="stable")[:k]  # members come by id
                for out, got in zip(found, (np.full(len(best), qkeys[r]), np.full(len(best), part.column("id")[r].as_py()), ids[cand[best]], d[best])):
                    out.append(got)
    cols = [np.concatenate(f) for f in found]
    return pa.table(dict(zip(("key", "query_id", "vec_id", "score"), cols)))


def _searched_fn(index, k):
    def run(table: pa.Table) -> pa.Table:
        return _searched(table, index, k)

    return run


def sufficient_probes(ix: Index, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many of a query's nearest lists hold this share of its k nearest vectors, judged on the sample.

    The sample is sparser than the table, so its neighbours lie farther off and in farther lists: the
    number errs to the high side.
    """
    own = ix.nearest(sample)
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(ix.centroids)
    ranks = []
    for s in range(0, min(queries, len(sample)), 64):
        q = sample[s : min(s + 64, queries)]
        d = _sq(q, sample)
        d[np.arange(len(q)), np.arange(s, s + len(q))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(_sq(q, ix.centroids), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


def nearest(table: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.98, exact: bool = True, lists_per: int = 128, max_lists: int = MAX_LISTS, sample: tuple[int, int] = SAMPLE, bin_rows: int = 4096, visitors: int = VISITORS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, its k nearest other rows found.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. A query probes
    as many of its nearest lists as give the `recall` on the sample and hold k other rows. If `exact`, it probes those that give half of its
    neighbours, then all other lists that may hold a vector as near as its k-th by then; lists and rows are pruned by bounds only, so
    the result is exact, and the second search returns no more than the rows within the k-th distance. Vectors that are null,
    zero, hold null or non-finite components or have another length than most take no part, nor do rows without an id. Rows that repeat an id are
    candidates, and queries, of their own: ranks then repeat for the id, and a row finds the others of its id. An empty
    table, or a single row, gives an empty one. Other columns aren't read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), _vec(table, vec_col).alias("vec"))
    rows = _numbered(rows.where(valid(F.col("vec")) & F.col("id").isNotNull()))
    dim = _dimension(rows)
    rows = rows.where(F.size("vec") == dim)
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pts = _matrix(_sampled(rows, n, sample))
    ix = fit(pts, max(1, min(max_lists, n // lists_per, len(pts) // 8)))
    index = spark.sparkContext.broadcast(ix)
    kind = dict(rows.dtypes)["vec"]
    placed = cut(rows.mapInArrow(partial(_placed, index=index), f"key long, id long, own int, codes binary, err double, away double, vec {kind}"))
    counts, radii = np.zeros(len(ix.centroids), np.int64), np.zeros(len(ix.centroids))
    for x in placed.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # as many as lists
        counts[x.own], radii[x.own] = x.n, x.radius
    bins = _bins(counts, bin_rows)
    lists = spark.sparkContext.broadcast((counts, radii, bins))
    of = spark.createDataFrame(pd.DataFrame({"own": np.arange(len(bins), dtype=np.int32), "bin": bins}))
    members = placed.drop("away").join(F.broadcast(of), "own").withColumns({"home": F.lit(True), "visit": F.lit(False)})
    # the second search starts from what the first found, so that may be less
    probes = sufficient_probes(ix, pts, k, 0.5 if exact else recall)
    asked = rows.where(is_query(F.col("id"))).select("key", "id", "vec")

    def searched(queries: DataFrame, more: bool) -> DataFrame:
        route = partial(_routed, index=index, probes=probes, need=k + 1, lists=lists, more=more)
        sent = queries.mapInArrow(route, f"bin int, key long, id long, kth double, lists array<int>, vec {kind}").withColumns({"home": F.lit(False), "visit": F.lit(True)})
        rows = _blocks(members.unionByName(sent, allowMissingColumns=True), ["bin"], bin_rows, visitors)
        return rows.groupBy("bin", "i", "j").applyInArrow(_searched_fn(index, k), "key long, query_id long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    best = top(searched(asked.withColumn("kth", F.lit(float("inf"))), False))
    if exact:
        best = cut(best)
        kth = best.where(F.col("rank") == k).select("key", F.col("score").alias("kth"))
        far = asked.join(kth, "key", "left").select("key", "id", F.coalesce("kth", F.lit(float("inf"))).alias("kth"), "vec")
        best = top(best.drop("rank").unionByName(searched(far, True)))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
