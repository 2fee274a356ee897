"""Posterior queries on long records (chain, iteration, param, i, j, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafield.operators.ranges import numbered

QUANTILES = (0.025, 0.5, 0.975)


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, of: dict[str, float]) -> DataFrame:
    """(by..., a column per quantile of `of`), interpolated between order statistics; nulls and NaN don't count, groups without other values have no row.

    No task holds a group: values are numbered in ranges of (group, value), and a group's quantiles come from the rows at their places.
    """
    by = list(by)
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = rows.select(group.alias("_g"), not_nan(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    ranked = numbered(rows, [F.col("_g").asc(), F.col("_v").asc()])
    # a group's values have the ranks from its first on; of each quantile one or two of them are wanted, with their shares
    starts = ranked.groupBy("_g").agg(F.min("rank").alias("_start"), F.count(F.lit(1)).alias("_n"))
    place = lambda p: F.col("_start") + (F.col("_n") - 1) * F.lit(p)
    wanted = starts.select("_g", F.explode(F.array(*[F.struct(F.lit(k).alias("q"), place(p).alias("at")) for k, p in enumerate(of.values())])).alias("w"))
    wanted = wanted.select("_g", "w.q", "w.at").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    share = F.when(F.col("rank") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    found = wanted.join(ranked.select("rank", "_v"), "rank").groupBy("_g").agg(*[F.sum(F.when(F.col("q") == k, F.col("_v") * share)).alias(n) for k, n in enumerate(of)])
    return found.select(*[F.col(f"_g.{c}").alias(c) for c in by], *of)


def summary(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """mean, q0_025, median, q0_975 (interpolated between order statistics) and sample sd per group, without NaN and null. No task holds a group."""
    by = list(by)
    rows = samples.select(*by, not_nan(F.col(value).cast("double")).alias("_v"))
    stats = rows.groupBy(*by).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    found = quantiles(rows, by, "_v", dict(zip(("q0_025", "median", "q0_975"), QUANTILES)))
    out = stats.alias("s").join(found.alias("f"), [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by], "left")
    return out.select(*[F.col(f"s.{c}").alias(c) for c in by], "mean", "q0_025", "median", "q0_975", "sd")


def array_summary(rows: DataFrame, by: Sequence[str], values: str = "values") -> DataFrame:
    """The same of arrays of samples, a row per group: within the row, no shuffle."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = rows.select(*by, v.alias("_v")).withColumn("_n", F.size("_v"))
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    rows = rows.withColumn("mean", F.when(F.col("_n") > 0, mean))
    spread = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))

    def quantile(p):
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = (F.get("_v", f(at).cast("int")) for f in (F.floor, F.ceil))
        return F.when(F.col("_n") > 0, low + (high - low) * (at - F.floor(at)))

    return rows.select(*by, "mean", *[quantile(p).alias(n) for p, n in zip(QUANTILES, ("q0_025", "median", "q0_975"))], F.when(F.col("_n") > 1, F.sqrt(spread / (F.col("_n") - 1))).alias("sd"))


#: Coefficients of samples that are sent to every task, at most.
MAX_SAMPLE_VALUES = 5_000_000


def sample_matrix(beta: DataFrame) -> tuple[list, np.ndarray]:
    """(samples, samples x coefficients) of beta(chain, iteration, i, value), i from 1; more than MAX_SAMPLE_VALUES are refused."""
    t = beta.select("chain", "iteration", "i", "value").limit(MAX_SAMPLE_VALUES + 1).toPandas()
    if len(t) > MAX_SAMPLE_VALUES:
        raise ValueError(f"more than {MAX_SAMPLE_VALUES} sampled coefficients; thin the records")
    wide = t.pivot_table(index=["chain", "iteration"], columns="i", values="value").sort_index()
    return list(wide.index), wide.to_numpy()


def _multiplied(batches, samples):
    b = samples.value
    for batch in batches:
        v = batch.column(1)
        for s in range(0, batch.num_rows, 1024):
            part = v.slice(s, 1024)
            x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            values = x @ b.T
            ends = np.arange(len(part) + 1) * b.shape[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, 1024), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()))], ["key", "values"])


def products(rows: DataFrame, beta: DataFrame, key: str) -> DataFrame:
    """(key, values): rows(key, v array) times every sample of beta(chain, iteration, i, value), in the order of the samples. No shuffle: the
    samples, whose number is bounded, go to the rows."""
    _, b = sample_matrix(beta)
    shared = rows.sparkSession.sparkContext.broadcast(b)
    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), "v").mapInArrow(partial(_multiplied, samples=shared), f"key {kind}, values array<double>")
    return out.withColumnRenamed("key", key)


def product_summary(rows: DataFrame, beta: DataFrame, key: str) -> DataFrame:
    """Summaries per row of a design's products with every sample."""
    return array_summary(products(rows, beta, key), [key])


def estimate_parameters(records: DataFrame, by: Sequence[str] = ("param", "i", "j"), share: float = 0.5) -> DataFrame:
    from terrafield.operators.relational import burn_in

    return summary(burn_in(records, share), by)


def fixed_effects(design: DataFrame, beta: DataFrame, names: Sequence[str], key: str = "obs_id") -> DataFrame:
    """(key, values): design(key, names...) times the coefficients beta(sample, names...) of every sample, in the order of `sample`."""
    long = beta.select(F.lit(1).alias("chain"), F.col("sample").alias("iteration"), F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("pos", "value"))
    rows = design.select(key, F.array(*[F.col(n).cast("double") for n in names]).alias("v"))
    return products(rows, long.withColumn("i", F.col("pos") + 1), key)


def noise_variance(log_noise: Column) -> Column:
    return F.exp(log_noise)


def normal_log_density(y: Column, mean: Column, log_var: Column) -> Column:
    r = y - mean
    return -0.5 * (F.log(F.lit(2.0) * F.pi()) + log_var + r * r * F.exp(-log_var))


def log_score(samples: DataFrame, by: str = "obs_id") -> DataFrame:
    """Per observation, the log of the mean predictive density; safe from underflow.

    samples(by, z, means, log_noises): arrays with an element per sample, so an observation is one row and nothing is shuffled.
    """
    ll = F.zip_with("means", "log_noises", lambda m, v: normal_log_density(F.col("z"), m, v))
    rows = samples.select(by, ll.alias("ll")).withColumn("top", F.array_max("ll"))
    total = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return rows.select(by, (F.col("top") + F.log(total / F.size("ll"))).alias("log_score"))


def dic(samples: DataFrame) -> DataFrame:
    """Deviance information criterion from samples(z, means, log_noises): DIC, and the log-likelihood at the posterior means.

    One pass: the mean over samples of an observation's log density, and its density at its mean, both summed.
    """
    n = F.size("means")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    each = F.aggregate(F.zip_with("means", "log_noises", lambda m, v: normal_log_density(F.col("z"), m, v)), F.lit(0.0), lambda a, x: a + x) / n
    at = normal_log_density(F.col("z"), mean("means"), mean("log_noises"))
    both = samples.agg(F.sum(each).alias("mean_ll"), F.sum(at).alias("ll_at_mean"))
    return both.select((-2 * (2 * F.col("mean_ll") - F.col("ll_at_mean"))).alias("dic"), "ll_at_mean")


def kernel_score(samples: DataFrame, by: str = "obs_id", bandwidth: float | None = None) -> DataFrame:
    """(by, kde_score): per row the log of a Gaussian kernel density of its samples at its own value z; samples(by, z, values).

    The bandwidth is given, or Silverman's: 0.9 min(sd, interquartile range / 1.34) n^(-1/5) of the row's samples. Nulls and NaN among samples don't count. A
    row whose samples don't vary, with fewer than two of them or without z has a null score. Rows are scored in batches where they are: no shuffle.
    """
    kind = samples.schema[by].dataType.simpleString()
    rows = samples.select(F.col(by).alias("key"), F.col("z").cast("double").alias("z"), F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v)).alias("values"))
    return rows.mapInArrow(partial(_kernel_scores, bandwidth=bandwidth), f"key {kind}, kde_score double").withColumnRenamed("key", by)


def _kernel_scores(batches, bandwidth, at_once=1 << 20):
    for b in batches:
        z, values = b.column("z").to_numpy(zero_copy_only=False), b.column("values")
        at, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False).astype(float)
        size = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        out = np.full(len(z), np.nan)
        for n in np.unique(size[size > 1]):
            every = np.nonzero(size == n)[0]
            for s in range(0, len(every), max(1, at_once // int(n))):
                rows = every[s : s + max(1, at_once // int(n))]
                x = flat[at[rows][:, None] + np.arange(n)]
                q1, q3 = np.quantile(x, (0.25, 0.75), axis=1)
                sd = x.std(axis=1, ddof=1)
                spread = np.where(q3 > q1, np.minimum(sd, (q3 - q1) / 1.34), sd)
                h = np.full(len(rows), bandwidth) if bandwidth else 0.9 * spread * float(n) ** -0.2
                with np.errstate(divide="ignore", invalid="ignore"):
                    e = -0.5 * ((z[rows, None] - x) / h[:, None]) ** 2
                    top = e.max(axis=1)
                    score = top + np.log(np.exp(e - top[:, None]).mean(axis=1)) - np.log(h) - 0.5 * np.log(2 * np.pi)
                out[rows] = np.where(h > 0, score, np.nan)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, from_pandas=True)], ["key", "kde_score"])
