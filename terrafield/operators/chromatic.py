"""Field updates a colour at a time: locations of one colour share no entry of the precision matrix, so they are drawn at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.operators.noise import normal
from terrafield.operators.ranges import numbered
from terrafield.operators.triangular import BAND_ROWS, Triangular
from terrafield.session import cut


def _rest_colours(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Colours of the last rows(id, hash, taken), links(row, col) among them: in the order of hashes, so all that a row waits for comes before it."""
    rows = rows.sort_values(["hash", "id"])
    near: dict = {}
    for row, col in zip(links["row"], links["col"]):
        near.setdefault(row, []).append(col)
    colour: dict = {}
    for i, taken in zip(rows["id"], rows["taken"]):
        used = {*taken, *(colour[c] for c in near.get(i, ()))}
        colour[i] = next(c for c in range(1, len(used) + 2) if c not in used)
    return pd.DataFrame({"id": list(colour), "colour": list(colour.values())})


def _colours_in_a_task(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, colour) of so few rows(id, hash, taken) that a task holds them, with the links among them."""
    one, ids = F.lit(0).alias("one"), lambda c: F.broadcast(rows.select(F.col("id").alias(c)))
    inner = links.join(ids("row"), "row", "left_semi").join(ids("col"), "col", "left_semi").select(one, "row", "col")
    return rows.select(one, "id", "hash", "taken").groupBy("one").cogroup(inner.toDF(*inner.columns).groupBy("one")).applyInPandas(_rest_colours, "id long, colour int")


def colouring(graph: DataFrame, ids: DataFrame, most: int = BAND_ROWS) -> DataFrame:
    """(id, colour), colours from 1, of ids(id): links graph(a, b), each once, join different colours.

    Each link points from the end of the smaller hash to the other, which makes a graph without cycles. A round, a join and a grouping, colours the
    locations whose neighbours of smaller hashes are coloured: each takes the smallest colour that none of these has. Where fewer than `most` are ready, a
    task colours the next `most` in the order of hashes instead, so there are no more than two rounds per `most` locations, whatever the degree. The number of
    colours is one more than the degree at most. A task finishes the last `most` locations.
    """
    h, a, b = F.xxhash64, F.col("a"), F.col("b")
    first = (h("a") < h("b")) | ((h("a") == h("b")) & (a < b))
    links = cut(graph.select(F.when(first, b).otherwise(a).alias("row"), F.when(first, a).otherwise(b).alias("col")))
    count = links.groupBy(F.col("row").alias("id")).agg(F.count(F.lit(1)).alias("left"))
    todo = ids.select("id").join(count, "id", "left").select("id", h("id").alias("hash"), F.coalesce("left", F.lit(0)).alias("left"), F.array().cast("array<int>").alias("taken"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("taken") + 1), "taken"))
    parts, ends = [], None
    while True:
        todo = cut(todo)
        n, some = todo.agg(F.count(F.lit(1)), F.count_if(F.col("left") == 0)).first()
        if not n:
            break
        if n <= most:
            parts.append(_colours_in_a_task(todo, links))
            break
        if ends is None:  # the first hash of each `most` locations but the first; one row per `most`
            order = numbered(todo.select("hash"), [F.col("hash").asc()])
            ends = [r.hash for r in order.where((F.col("rank") % most == 0) & (F.col("rank") > 0)).orderBy("hash").select("hash").collect()] if most else []
        if some < most and ends:
            end = F.lit(ends.pop(0))
            now = cut(_colours_in_a_task(todo.where(F.col("hash") < end), links.where((h("row") < end) & (h("col") < end))))
            rest, links, told = todo.where(F.col("hash") >= end), links.where(h("row") >= end), F.broadcast
        else:
            now, rest, told = todo.where("left = 0").select("id", free.cast("int").alias("colour")), todo.where("left > 0"), lambda df: df
        parts.append(now)
        if n == some:
            break
        done = links.join(told(now.withColumnRenamed("id", "col")), "col").groupBy(F.col("row").alias("id")).agg(F.count(F.lit(1)).alias("done"), F.collect_set("colour").alias("new"))
        taken = F.when(F.col("new").isNull(), F.col("taken")).otherwise(F.array_union("taken", "new"))
        todo = rest.join(done, "id", "left").select("id", "hash", (F.col("left") - F.coalesce("done", F.lit(0))).alias("left"), taken.alias("taken"))
    out = parts[0] if parts else ids.select("id", F.lit(1).alias("colour")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out)


class ColourUpdate:
    """Sweeps over a field with precision(a, b, value), both triangles with the diagonal.

    A colour's draw takes the new values of the colours before it and the old ones of those after, so a sweep is a triangular solve whose levels are the
    colours: what the old values pull is one join and one grouping, and consecutive colours of few rows are drawn in one step.
    """

    def __init__(self, precision: DataFrame, colours: DataFrame, most: int = BAND_ROWS):
        level = cut(colours.select("id", F.col("colour").alias("level")))
        own, other = (level.select(F.col("id").alias(c), F.col("level").alias(f"{c}_level")) for c in "ab")
        beside = precision.where("a <> b").select("a", "b", "value").join(own, "a").join(other, "b")
        self.later = cut(beside.where("b_level > a_level").select("a", "b", "value"))
        before = beside.where("b_level < a_level").select(F.col("a").alias("row"), F.col("b").alias("col"), "value")
        self.earlier = Triangular.of_entries(precision.where("a = b").select(F.col("a").alias("id"), F.col("value").alias("diagonal")), before, level, most)

    def sweep(self, field: DataFrame, rhs: DataFrame, seed: int) -> DataFrame:
        """(id, value): every location of field(id, value) drawn once given all others, from N(Q^-1 rhs, Q^-1)'s conditionals; rhs(id, value)."""
        pull = self.later.join(field.select(F.col("id").alias("b"), F.col("value").alias("w")), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("value") * F.col("w")).alias("pull"))
        at = self.earlier.rows.select("id", F.col("diagonal").alias("q")).join(pull, "id", "left").join(rhs.select("id", F.col("value").alias("rhs")), "id", "left")
        zero = F.lit(0.0)
        return self.earlier.solve(at.select("id", (F.coalesce("rhs", zero) - F.coalesce("pull", zero) + normal("id", seed) * F.sqrt("q")).alias("value")))

    def close(self) -> None:
        self.earlier.close()
