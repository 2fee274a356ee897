"""The tables behind the plots: what each one would draw, as rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.operators.ranges import numbered
from terrafield.operators.relational import colour_index, cut_right_closed, histogram

# Fixed value: radius of the 95 % ellipse of a unit normal in the plane.
ELLIPSE = 2.447747


def loss_map(losses: DataFrame, locs: DataFrame) -> DataFrame:
    """(id, x, y, loss, bin, draw): locations by the variance that a basis misses, in drawing order, the worst last."""
    rows = losses.join(locs.select("id", "x", "y"), "id").withColumn("bin", cut_right_closed(F.col("loss")))
    rows = numbered(rows, [F.col("loss").asc(), F.col("id").asc()]).withColumn("draw", F.col("rank") + 1)
    return rows.select("id", "x", "y", "loss", "bin", "draw")


def knot_map(pp, locs: DataFrame, losses: bool = True, knots: bool = True) -> DataFrame:
    """(kind, id, x, y, loss, bin, draw): the map of a basis, in one drawing order: locations, by loss if it is shown, the worst
    last, and on top the knots, numbered from 1."""
    if losses:
        out = loss_map(pp.variance_loss(), locs)
    else:
        out = numbered(locs.select("id", "x", "y"), [F.col("id").asc()]).withColumns({"loss": F.lit(None).cast("double"), "bin": F.lit(None).cast("string"), "draw": F.col("rank") + 1})
    out = out.select(F.lit("location").alias("kind"), F.col("id").cast("long").alias("id"), "x", "y", "loss", "bin", "draw")
    if not knots:
        return out
    n = locs.count()
    rows = [("knot", k + 1, float(x), float(y), n + k + 1) for k, (x, y) in enumerate(pp.knots)]
    top = locs.sparkSession.createDataFrame(rows, "kind string, id long, x double, y double, draw long")
    return out.unionByName(top, allowMissingColumns=True)


def loss_histogram(losses: DataFrame) -> DataFrame:
    return histogram(losses, "loss")


def ellipses(locs: DataFrame, shrink: float = 0.1, vertices: int = 50) -> DataFrame:
    """(id, vertex, vx, vy): polygons of local ranges; locs(id, x, y, lr0[, lr1, lr2]), log ranges as in operators.vecchia.

    Axes are those of the model's covariance: the root of the range matrix's eigenvalues over the 95 % radius.
    """
    from terrafield.functions.kernels import expm2

    if "lr1" in locs.columns:
        xx, yy, xy = expm2(F.col("lr0"), F.col("lr1"), F.col("lr2") / F.sqrt(F.lit(2.0)))
    else:
        xx = yy = F.exp("lr0")
        xy = F.lit(0.0)
    rows = locs.withColumns({"xx": xx, "yy": yy, "xy": xy})
    mid, half = (F.col("xx") + F.col("yy")) / 2, (F.col("xx") - F.col("yy")) / 2
    spread = F.sqrt(half * half + F.col("xy") * F.col("xy"))
    turn = F.atan2(F.col("xy"), half) / 2
    rows = rows.withColumns({"a": F.sqrt(mid + spread) * shrink / ELLIPSE, "b": F.sqrt(F.greatest(mid - spread, F.lit(0.0))) * shrink / ELLIPSE, "t": turn})
    rows = rows.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1))))
    ang = F.col("vertex") * F.lit(2 * math.pi / vertices)
    u, v = F.col("a") * F.cos(ang), F.col("b") * F.sin(ang)
    return rows.select("id", "vertex", (F.col("x") + u * F.cos("t") - v * F.sin("t")).alias("vx"), (F.col("y") + u * F.sin("t") + v * F.cos("t")).alias("vy"))


def painting(locs: DataFrame, value: str) -> DataFrame:
    """(id, x, y, colour)."""
    return colour_index(locs, value).select("id", "x", "y", "colour")


def signif(c, digits: int = 3):
    """c to so many significant digits."""
    size = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.round(c * size) / size)


def colour_scale(df: DataFrame, value: str, digits: int = 3) -> DataFrame:
    """(tick, value): five values from least to greatest, at quarters of the range."""
    s = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    return s.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tick"), "lo", "hi").select("tick", signif(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("tick") / 4, digits).alias("value"))


def psrf_lines(curves: DataFrame) -> DataFrame:
    """PSRF curves to draw: none at all if any value is infinite or missing."""
    bad = curves.where(F.col("psrf").isNull() | F.isnan("psrf") | (F.abs("psrf") == float("inf"))).limit(1)
    return curves.join(F.broadcast(bad.select(F.lit(1).alias("bad"))), F.lit(True), "left_anti")


def trace(records: DataFrame, start: float = 0.5, components: int | None = None) -> DataFrame:
    """(chain, iteration, i, value, colour) of a parameter beyond start * the last iteration; colours repeat after six."""
    last = records.agg(F.max("iteration").alias("last"))
    rows = records.crossJoin(F.broadcast(last)).where(F.col("iteration") > F.col("last") * F.lit(start))
    rows = rows if components is None else rows.where(F.col("i") <= components)
    return rows.select("chain", "iteration", "i", "value", (F.pmod(F.col("i") - 1, F.lit(6)) + 1).cast("int").alias("colour"))


def log_scale_trace(records: DataFrame, start: float = 0.5) -> DataFrame:
    """Traces of a log scale: one component, or the three diagonal ones of six."""
    n = records.agg(F.max("i")).first()[0] or 0
    return trace(records, start, 3 if n == 6 else None)


def diagnostic_tables(records: DataFrame, burn_in: float = 0.5, start: float = 0.5, fields: bool = False) -> dict[str, dict[str, DataFrame]]:
    """The tables of a full report: per parameter its traces and PSRF curves, in the order range, noise, scale, response.

    Latent fields have as many components as locations; they come last, and only on demand, as PSRF quantiles.
    """
    from terrafield.operators.diagnostics import families, psrf, psrf_quantiles

    names = sorted(x[0] for x in records.select("param").distinct().collect())  # parameter names, a handful
    out: dict[str, dict[str, DataFrame]] = {}

    def curves(mine: DataFrame) -> DataFrame:
        return psrf(mine.select("chain", F.col("iteration").alias("i"), F.struct("i", "j").alias("component"), "value"), by=["component"], burn_in=burn_in, start=start)

    for family in families(names).values():
        for name in family:
            mine = records.where(F.col("param") == name)
            draw = log_scale_trace if name.endswith("log_scale") else trace
            out[name] = {"trace": draw(mine, start), "psrf": psrf_lines(curves(mine))}
    for name in (n for n in names if "field" in n) if fields else ():
        out[name] = {"psrf": psrf_quantiles(curves(records.where(F.col("param") == name)))}
    return out
