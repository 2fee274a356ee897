"""Shared pieces of the training-data operators: words, distributed connected components, distributed running sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafield.session import cut  # noqa: F401  (the operators take it from here)

#: The word rule of every operator here, as a Java/Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words: bytes.lower and bytes.split touch ASCII only, as the word rule asks."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def pack_rows(df: DataFrame, id_col: str) -> DataFrame:
    """(id, row): whole rows as one struct, so that no column's name can clash in a join."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def map_whole(df: DataFrame, fn) -> DataFrame:
    """df.mapInArrow(fn) for an fn that keeps the columns and knows them by position, whatever their names."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(fn, plain.schema).toDF(*df.columns)


def hinted(table: DataFrame, rows: int = 100_000, most: int = 16 << 20) -> DataFrame:
    """table, written, and with a broadcast hint if it has that many rows and bytes of text at most, which is checked: so that a join
    with it needn't exchange the other side before its size is known. Tables with nested columns have no hint."""
    table = cut(table)
    if any("<" in kind for _, kind in table.dtypes):
        return table
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in table.dtypes if kind in ("string", "binary")), F.lit(0).cast("long"))
    size = table.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wide), F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if size.n <= rows and size.bytes <= most else table


def n_words(col) -> F.Column:
    """Number of words of a text column, JVM-side; null counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given as long pairs.

    Returns (node, component): one row per node that has a link to another node, component is the
    smallest node reachable. Each round hooks every node to its smallest neighbour, which makes trees, shortens
    the hooks to the trees' roots by pointer jumping and contracts each tree: at least half of the nodes go in a
    round, and paths need as many jumps as their length has binary digits. Links and hooks stay distributed;
    every table is checkpointed, so joins exchange both sides and AQE can split a hot hub. Self links and
    nulls are ignored; no links give an empty table.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") > F.col("v"))
        .distinct()
    )
    e = cut(e)
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent")))
        while True:
            far = cut(_jump(_jump(hooks).select("node", F.col("above").alias("parent"))))
            hooks = far.select("node", F.col("above").alias("parent"))
            if far.where("above <> parent").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            labels = labels.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
            labels = cut(labels)
        left = hooks.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = hooks.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        e = e.join(left, "u").join(right, "v").where("pu <> pv")
        e = cut(e.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct())
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))


def _jump(hooks: DataFrame) -> DataFrame:
    """(node, parent, above): the parent's own parent beside it."""
    up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return hooks.join(up, "parent").select("node", "parent", "above")


class LocalUnion:
    """Union-find over 0..n-1 fed with arrays of links; the smallest index is a set's root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[i]
        while True:
            up = p[r]
            if np.array_equal(up, r):
                return r
            r = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links in bulk: hook the larger root to the smaller until all links lie within one set."""
        while len(i):
            a, b = self.roots(i), self.roots(j)
            keep = a != b
            if not keep.any():
                return
            i, j = i[keep], j[keep]
            a, b = a[keep], b[keep]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def all_roots(self) -> np.ndarray:
        return self.roots(np.arange(len(self.parent)))


def running_sums(df: DataFrame, group: str, order: list[str], value: str, per_bucket: int = 1024) -> DataFrame:
    """Adds `before` (sum of `value` over earlier rows of the group) and `slot` (number of earlier rows).

    `order` starts with a uniform 64-bit hash column. Each group is cut into equal ranges of that hash, as
    many as its row count asks for, so that no task ever holds a whole group: totals per range are summed
    up first (a table of one row per `per_bucket` rows), then rows are numbered inside their range.
    """
    h = order[0]
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cut(sizes.select(F.col(group).alias("_g"), F.greatest(F.lit(1.0), F.ceil(F.col("_n") / per_bucket)).cast("double").alias("_k")))
    unit = (F.col(h).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    rows = df.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("_g"))) if sizes.count() <= 100_000 else df.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    rows = rows.withColumn("_b", F.least(F.floor(unit * F.col("_k")), F.col("_k") - 1).cast("long")).drop("_g", "_k")
    tops = rows.groupBy(group, "_b").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        F.col(group).alias("_tg"),
        F.col("_b").alias("_tb"),
        F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c0"),
    )
    inner = Window.partitionBy(group, "_b").orderBy(*order)
    rows = rows.select(
        "*",
        F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_in_s"),
        (F.row_number().over(inner) - 1).alias("_in_c"),
    )
    rows = rows.join(tops, F.col(group).eqNullSafe(F.col("_tg")) & (F.col("_b") == F.col("_tb")))
    return rows.select(
        *[c for c in df.columns],
        (F.col("_s0") + F.col("_in_s")).cast("long").alias("before"),
        (F.col("_c0") + F.col("_in_c")).cast("long").alias("slot"),
    )
