"""Solves with a factor of any number of rows, on the cluster.

A row's level is one more than the greatest of its parents', so the rows of a level can be solved at once, from the rows below. Levels are found
by rounds: each settles the rows whose parents are settled, or where these are few, the next rows of the order in one task. Consecutive levels with few rows together make a band that one task solves by
itself; a level with more is a band of its own and solved by a join and a grouping. A solve takes one step per band, from the first to the last, or for the transpose from the last to the first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.operators.ranges import numbered
from terrafield.session import checkpoint_dir, cut, remove

#: Rows that one task solves by itself, at most.
BAND_ROWS = 100_000


def _rest_levels(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Levels of some rows of a graph: rows(id, level), the least level that the rows before them leave each, edges(row, col) among them."""
    rows = rows.sort_values("id")
    ids, level = rows["id"].to_numpy(np.int64), rows["level"].to_numpy(np.int64).copy()
    child, parent = np.searchsorted(ids, edges["row"].to_numpy(np.int64)), np.searchsorted(ids, edges["col"].to_numpy(np.int64))
    left = np.bincount(child, minlength=len(ids))
    order = np.argsort(parent, kind="stable")
    child, starts = child[order], np.searchsorted(parent[order], np.arange(len(ids) + 1))
    now, seen = np.nonzero(left == 0)[0], 0
    while len(now):
        seen += len(now)
        reached = np.concatenate([child[starts[i] : starts[i + 1]] for i in now])
        np.maximum.at(level, reached, np.repeat(level[now] + 1, starts[now + 1] - starts[now]))
        np.subtract.at(left, reached, 1)
        reached = np.unique(reached)
        now = reached[left[reached] == 0]
    if seen < len(ids):
        raise ValueError("the neighbour graph has a cycle")
    return pd.DataFrame({"id": ids, "level": level.astype(np.int32)})


def _levels_in_a_task(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of so few rows(id, level) that a task holds them, with the edges among them."""
    one, ids = F.lit(0).alias("one"), lambda c: F.broadcast(rows.select(F.col("id").alias(c)))
    inner = edges.join(ids("row"), "row", "left_semi").join(ids("col"), "col", "left_semi").select(one, "row", "col")
    return rows.select(one, "id", "level").groupBy("one").cogroup(inner.toDF(*inner.columns).groupBy("one")).applyInPandas(_rest_levels, "id long, level int")


def levels(edges: DataFrame, ids: DataFrame, most: int = BAND_ROWS) -> DataFrame:
    """(id, level) of ids(id): 0 for rows without parents in edges(row, col), else one more than the greatest level of their parents.

    A round is a join of the rows that the last one settled with the edges, and a grouping; a task finishes the last `most` rows. Where parents have smaller
    ids than children, as they have in an order, a round in which fewer than `most` rows are ready settles the next `most` ids instead, in a task: their parents are
    settled or among them. So there are no more than two rounds per `most` rows, however deep the graph. Edges to ids that aren't there are ignored; a cycle is an error.
    """
    edges = edges.where("row <> col").select("row", "col").join(ids.select(F.col("id").alias("col")), "col")
    edges = cut(edges)
    count = edges.groupBy(F.col("row").alias("id")).agg(F.count(F.lit(1)).alias("left"))
    todo = cut(ids.select("id").join(count, "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).alias("level")))
    parts, ends = [], None
    while True:
        n, some = todo.agg(F.count(F.lit(1)), F.count_if(F.col("left") == 0)).first()
        if not n:
            break
        if n <= most:
            parts.append(_levels_in_a_task(todo.select("id", "level"), edges))
            break
        if ends is None:  # the first id of each `most` rows but the first, in an order; one row per `most`
            in_order = 0 < most and edges.where("col > row").isEmpty()
            ends = [r.id for r in numbered(todo.select("id"), [F.col("id").asc()]).where((F.col("rank") % most == 0) & (F.col("rank") > 0)).orderBy("id").select("id").collect()] if in_order else []
        if some < most and ends:
            end = F.col("id") < ends.pop(0)
            now, rest, told = cut(_levels_in_a_task(todo.where(end).select("id", "level"), edges)), todo.where(~end), F.broadcast
        elif not some:
            raise ValueError("the neighbour graph has a cycle")
        else:
            now, rest, told = todo.where("left = 0").select("id", "level"), todo.where("left > 0"), lambda df: df
        parts.append(now)
        if n == some:
            break
        done = edges.join(told(now.select(F.col("id").alias("col"), "level")), "col").groupBy(F.col("row").alias("id")).agg(F.count(F.lit(1)).alias("done"), F.max("level").alias("last"))
        left, level = F.col("left") - F.coalesce("done", F.lit(0)), F.greatest("level", F.coalesce(F.col("last") + 1, F.lit(0)))
        todo = cut(rest.join(done, "id", "left").select("id", left.alias("left"), level.alias("level")))
    out = parts[0] if parts else todo.select("id", "level")
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out)


def bands(level: DataFrame, most: int = BAND_ROWS) -> list[tuple[int, int, bool]]:
    """(first level, last level, whether one task solves it) of level(id, level): consecutive levels, `most` rows at most, or one level."""
    out, held = [], 0
    for r in level.groupBy("level").count().orderBy("level").collect():  # one row per level
        if out and out[-1][2] and held + r["count"] <= most:
            out[-1], held = (out[-1][0], r.level, True), held + r["count"]
        else:
            out.append((r.level, r.level, r["count"] <= most))
            held = r["count"]
    return out


def _solve_band(rows: pd.DataFrame, edges: pd.DataFrame, backward: bool) -> pd.DataFrame:
    """A band's values: rows(id, level, diagonal, rest) and edges(row, col, value) among them; backward: a row waits for those that hang on it."""
    rows = rows.sort_values("id")
    ids, diagonal = rows["id"].to_numpy(), rows["diagonal"].to_numpy(float)
    x, rest, level = np.zeros(len(ids)), rows["rest"].to_numpy(float).copy(), rows["level"].to_numpy()
    to, of = ("col", "row") if backward else ("row", "col")
    i, j, v = np.searchsorted(ids, edges[to].to_numpy(np.int64)), np.searchsorted(ids, edges[of].to_numpy(np.int64)), edges["value"].to_numpy(float)
    order = np.argsort(level[i], kind="stable")
    i, j, v = i[order], j[order], v[order]
    every = np.unique(level)
    for k in every[::-1] if backward else every:
        a, z = np.searchsorted(level[i], (k, k + 1))
        np.subtract.at(rest, i[a:z], v[a:z] * x[j[a:z]])
        now = level == k
        x[now] = rest[now] / diagonal[now]
    return pd.DataFrame({"id": ids, "value": x})


@dataclass
class Triangular:
    """A lower triangular system: entries(row, col, value) with their bands, written by band, and diagonal rows(id, level, band, diagonal)."""

    rows: DataFrame
    spans: list[tuple[int, int, bool]]
    entries: DataFrame
    path: str
    _written: set = field(default_factory=set)

    @classmethod
    def of(cls, vecchia: DataFrame, level: DataFrame, most: int = BAND_ROWS) -> Triangular:
        """vecchia(child, parents, coef) as operators.vecchia gives it (the child first); level(id, level) of its graph."""
        flat = vecchia.select(F.col("child").alias("row"), F.posexplode(F.arrays_zip("parents", "coef")).alias("k", "e")).select("row", "k", F.col("e.parents").alias("col"), F.col("e.coef").alias("value"))
        return cls.of_entries(flat.where("k = 0").select(F.col("row").alias("id"), F.col("value").alias("diagonal")), flat.where("k > 0").drop("k"), level, most)

    @classmethod
    def of_entries(cls, diagonal: DataFrame, off: DataFrame, level: DataFrame, most: int = BAND_ROWS) -> Triangular:
        """diagonal(id, diagonal); off(row, col, value) beside it, of columns whose level in level(id, level) is below the row's."""
        spans = bands(level, most)
        number = F.lit(0)
        for k, (first, _, _) in enumerate(spans):
            number = F.when(F.col("level") >= first, k).otherwise(number) if k else number
        at = cut(level.select("id", "level", number.cast("int").alias("band")))
        rows = at.join(diagonal, "id")
        off = off.join(at.select(F.col("id").alias("row"), F.col("band").alias("row_band")), "row").join(at.select(F.col("id").alias("col"), F.col("band").alias("col_band")), "col")
        return cls(cut(rows), spans, cut(off), f"{checkpoint_dir(level.sparkSession)}/triangular-{uuid.uuid4().hex}")

    def _edges(self, backward: bool) -> DataFrame:
        """The entries in a folder per band of the side that is solved for, so that a step reads its own only."""
        by, spark = ("col_band" if backward else "row_band"), self.rows.sparkSession
        if by not in self._written:
            self.entries.repartition(F.col(by), F.pmod(F.xxhash64("row"), F.lit(64))).write.partitionBy(by).parquet(f"{self.path}/{by}")
            self._written.add(by)
        return spark.read.schema(f"row long, col long, value double, {'row_band' if backward else 'col_band'} int, {by} int").parquet(f"{self.path}/{by}")

    def solve(self, z: DataFrame, backward: bool = False) -> DataFrame:
        """(id, value) of L^-1 z, or L^-T z if backward; z(id, value) has every row, ids that it lacks count as 0."""
        edges = self._edges(backward)
        own, other, to, of = ("col_band", "row_band", "col", "row") if backward else ("row_band", "col_band", "row", "col")
        rows = cut(self.rows.join(z.select("id", F.col("value").alias("z")), "id", "left"))
        steps = range(len(self.spans) - 1, -1, -1) if backward else range(len(self.spans))
        x, parts = None, []
        for k in steps:
            mine = rows.where(F.col("band") == k).select("id", "level", "diagonal", F.coalesce("z", F.lit(0.0)).alias("rest"))
            here = edges.where(F.col(own) == k)
            if x is not None:
                far = here.where(F.col(other) != k).join(x.select(F.col("id").alias(of), F.col("value").alias("x")), of)
                far = far.groupBy(F.col(to).alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("far"))
                mine = mine.join(far, "id", "left").select("id", "level", "diagonal", (F.col("rest") - F.coalesce("far", F.lit(0.0))).alias("rest"))
            if self.spans[k][2]:
                near = here.where(F.col(other) == k).select("row", "col", "value")
                one = F.lit(0).alias("one")
                got = mine.withColumn("one", one).groupBy("one").cogroup(near.withColumn("one", one).groupBy("one")).applyInPandas(lambda a, b: _solve_band(a, b, backward), "id long, value double")
            else:
                got = mine.select("id", (F.col("rest") / F.col("diagonal")).alias("value"))
            parts.append(cut(got))
            x = parts[0]
            for p in parts[1:]:
                x = x.unionByName(p)
        return x if x is not None else z.select("id", "value").limit(0)

    def close(self) -> None:
        """Deletes the written entries."""
        remove(self.rows.sparkSession, self.path)
        self._written.clear()
