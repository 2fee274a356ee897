"""Convergence diagnostics of chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafield.operators.posterior import quantiles
from terrafield.operators.ranges import BLOCK, numbered, prefixes
from terrafield.session import cut


def psrf(records: DataFrame, by=(), burn_in: float = 0.5, start: float = 0.5) -> DataFrame:
    """Potential scale reduction curves: for each end e beyond start * last, chains compared over (lb, e], lb = ceil(burn_in e).

    records(chain, i, value, by...): i numbers a chain's samples from 1; chains are cut to the shortest. Windows come from
    prefix sums over blocks of samples, so no task holds a chain, and the prefixes at e and lb come from one equi-join.
    """
    by = list(by)
    per = records.groupBy("chain", *by).agg(F.max("i").alias("c"))
    last = per.groupBy(*by).agg(F.min("c").alias("last"))
    r = records.crossJoin(last) if not by else records.join(last, by)  # without groups it is a single row
    r = r.where(F.col("i") <= F.col("last")).select("chain", *by, "i", "last", "value")
    cs = prefixes(r, ["chain", *by], "i", {"s": F.col("value"), "s2": F.col("value") * F.col("value")}).drop("value")
    ends = cs.where(F.col("i") > F.col("last") * F.lit(start)).select("chain", *by, F.col("i").alias("e"), F.greatest(F.ceil(F.col("i") * F.lit(burn_in)).cast("long"), F.lit(1)).alias("lb"), "s", "s2")
    low = cs.select("chain", *by, F.col("i").alias("lb"), F.col("s").alias("s0"), F.col("s2").alias("s20"))
    n = (F.col("e") - F.col("lb")).cast("double")
    m, q = (F.col("s") - F.col("s0")) / n, (F.col("s2") - F.col("s20")) / n
    win = ends.join(low, ["chain", *by, "lb"]).select("e", *by, n.alias("n"), m.alias("m"), ((q - m * m) * n / (n - 1)).alias("v"))
    g = win.groupBy(*by, "e").agg(F.max("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.avg("v").alias("wv"), F.avg("m").alias("gm"), F.avg(F.col("m") * F.col("m")).alias("mm"))
    b = (F.col("mm") - F.col("gm") * F.col("gm")) * F.col("k") / (F.col("k") - 1)
    value = (F.col("k") + 1) / F.col("k") * (b / F.col("wv")) * ((F.col("n") - 1) / F.col("n")) + (F.col("n") + 1) / F.col("n")
    return g.select(*by, "e", value.alias("psrf"))


def psrf_quantiles(curves: DataFrame) -> DataFrame:
    """(e, max, q99, q90, median) over a field's components."""
    return quantiles(curves, ["e"], "psrf", {"q100": 1.0, "q99": 0.99, "q90": 0.9, "q50": 0.5})


def effective_size(acov: np.ndarray, n: int) -> float:
    """n var / spectral density at zero of an autoregression by Yule-Walker on autocovariances of n samples, its order by AIC among their lags; 0 if constant."""
    if n < 2 or not acov[0] > 0:
        return 0.0
    phi, var, best = np.zeros(0), acov[0], (n * np.log(acov[0]), acov[0] * n / (n - 1), np.zeros(0))
    for p in range(1, len(acov)):  # Levinson-Durbin
        k = (acov[p] - phi @ acov[p - 1 : 0 : -1][: len(phi)]) / var if p > 1 else acov[1] / acov[0]
        phi = np.append(phi - k * phi[::-1], k)
        var *= 1 - k * k
        if var <= 0 or n - p - 1 <= 0:
            break
        aic = n * np.log(var) + 2 * p
        if aic < best[0]:
            best = (aic, var * n / (n - p - 1), phi.copy())
    spec = best[1] / (1 - best[2].sum()) ** 2
    return float(acov[0] * n * n / (n - 1) / spec)


def _lagged(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Sums of products at lags 0..most of a block's samples with those that follow: rows of the block and the next ones, centred."""
    pdf = pdf.sort_values("at")
    x, most = pdf["x"].to_numpy(), int(pdf["most"].iloc[0])
    own = int((pdf["at"] < (pdf["block"].iloc[0] + 1) * block).sum())
    ahead = np.concatenate([x, np.zeros(max(0, own + most - len(x)))])  # beyond the chain's end nothing is added
    sums = [float(x[:own] @ ahead[k : k + own]) for k in range(most + 1)]
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "sums": [sums]})


def _sizes(batches):
    for b in batches:
        n, sums = b.column("n").to_numpy(), b.column("sums")
        out = [effective_size(s.values.to_numpy(zero_copy_only=False) / k, int(k)) for s, k in zip(sums, n)]
        yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(out, pa.float64())], ["g", "ess"])


def ess(records: DataFrame, by=("param", "i", "j"), share: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Effective sample size per component, summed over chains; the first iteration beyond the cut goes as well.

    Samples are numbered in ranges of (chain, component, iteration) and cut into blocks, which get as many of the next samples as there are lags (10 log10(n)); their
    sums of lagged products are added up, so a task holds a block or the autocovariances of a batch of components, never a chain.
    """
    by = list(by)
    keys = ["chain", *by]
    rows = records.select(F.struct(*keys).alias("key"), "iteration", F.col("value").cast("double").alias("value"))
    last = rows.groupBy("key").agg(F.max("iteration").alias("last"))
    rows = rows.join(last, "key").where(F.col("iteration") > F.col("last") * F.lit(share)).select("key", "iteration", "value")
    ranked = numbered(rows, [F.col("key").asc(), F.col("iteration").asc()])
    first = ranked.groupBy("key").agg(F.min("rank").alias("start"))
    ranked = ranked.join(first, "key").where("rank > start").select("key", (F.col("rank") - F.col("start") - 1).alias("at"), "value")
    stats = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.min("value") == F.max("value")).alias("flat"))
    stats = stats.select("key", "n", "mean", "flat")
    stats = cut(stats.withColumn("g", F.monotonically_increasing_id()))
    most = F.least(F.col("n") - 1, F.floor(10 * F.log10(F.col("n").cast("double"))))
    x = ranked.join(stats.where("n > 1 and not flat"), "key").select("g", "at", (F.col("value") - F.col("mean")).alias("x"), most.cast("int").alias("most"), F.floor(F.col("at") / block).alias("block"))
    # a block's first samples are the halo of the one before, several blocks' if blocks are shorter than the lags
    x = x.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - F.col("most")) / block)), F.col("block"))))
    parts = x.groupBy("g", "block").applyInPandas(lambda pdf: _lagged(pdf, block), "g long, sums array<double>")
    lags = parts.select("g", F.posexplode("sums").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v"))
    acov = lags.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).select("g", F.col("s.v").alias("sums"))  # a number per lag
    size = acov.join(stats.select("g", "n"), "g").mapInArrow(_sizes, "g long, ess double")
    out = stats.join(size, "g", "left").select(*[F.col(f"key.{c}").alias(c) for c in by], F.coalesce("ess", F.lit(0.0)).alias("ess"))
    return out.groupBy(*by).agg(F.sum("ess").alias("ess"))


def families(names) -> dict[str, list[str]]:
    """Parameter names by family in the order of the reports; latent fields are left out."""
    names = [n for n in names if "field" not in n]
    out = {}
    for f in ("range", "noise", "scale"):
        out[f] = [n for n in names if n.startswith(f)]
    out["response"] = [n for n in names if not n.startswith(("range", "noise", "scale"))]
    return out
