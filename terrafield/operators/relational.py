"""Relational primitives of the model code: points, lookups, groups, arrays in long form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafield.operators.ranges import numbered, prefixes


def unique_points(df: DataFrame, cols=("x", "y")) -> DataFrame:
    return df.select(*cols).distinct()


def duplicated(df: DataFrame, cols, order) -> DataFrame:
    """Adds `dup`: true from a key's second row on. Rows are numbered in ranges of (key, order), so no task holds a key."""
    ranked = numbered(df, [*[F.col(c).asc_nulls_first() for c in cols], *[F.col(c).asc_nulls_first() for c in order]])
    first = ranked.groupBy(*cols).agg(F.min("rank").alias("_first")).withColumnsRenamed({c: f"_{k}" for k, c in enumerate(cols)})
    rows = ranked.join(first, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(cols)])
    return rows.select(*df.columns, (F.col("rank") > F.col("_first")).alias("dup"))


def zero_safe(c: str) -> Column:
    """-0.0 as 0.0, so that equal coordinates are equal keys."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))


def match_locations(obs: DataFrame, locs: DataFrame, cols=("x", "y")) -> DataFrame:
    """obs with the loc_id of their coordinates."""
    o, l = obs.withColumns({c: zero_safe(c) for c in cols}), locs.select("loc_id", *[zero_safe(c).alias(c) for c in cols])
    return o.join(l, list(cols))


def printed(c: str, digits: int = 15) -> Column:
    """A coordinate as text of so many significant digits: what is left of it when it goes through a file of text."""
    return F.format_string(f"%.{digits - 1}e", zero_safe(c))


def match_printed(obs: DataFrame, locs: DataFrame, cols=("x", "y"), digits: int = 15) -> DataFrame:
    """obs with the loc_id of the first location whose coordinates agree with theirs in `digits` significant digits.

    One equi-join on the printed coordinates; the locations of equal digits are reduced to their smallest loc_id before it. Programs differ in how they
    print a number halfway between two texts, so a location whose last bit decides is found by both. Rows without
    such a location, or with a null coordinate, are left out.
    """
    keys = [f"_k{k}" for k in range(len(cols))]
    less = F.lit(1 - 2.0**-52)
    both = [F.array_distinct(F.array(printed(c, digits), F.format_string(f"%.{digits - 1}e", zero_safe(c) * less))).alias(k) for c, k in zip(cols, keys)]
    first = locs.select("loc_id", *both)
    for k in keys:
        first = first.withColumn(k, F.explode(k))
    first = first.groupBy(*keys).agg(F.min("loc_id").alias("loc_id"))
    o = obs.withColumns({k: printed(c, digits) for c, k in zip(cols, keys)}).where(" and ".join(f"`{c}` is not null" for c in cols))
    return o.join(first, keys).drop(*keys)


def groups(obs: DataFrame, key="loc_id", value="obs_id") -> DataFrame:
    """(key, first, n, ids): a key's values in order."""
    return obs.groupBy(key).agg(F.min(value).alias("first"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("ids"))


def per_location(obs: DataFrame, cols=("x", "y")) -> DataFrame:
    return obs.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_obs"))


def overlap(a: DataFrame, b: DataFrame) -> bool:
    return not a.join(b, a.columns, "left_semi").limit(1).isEmpty()


def require_disjoint(a: DataFrame, b: DataFrame) -> None:
    if overlap(a, b):
        raise ValueError("the predicted locations must be disjoint from the observed ones")


def gather(obs: DataFrame, field: DataFrame, on="loc_id") -> DataFrame:
    """A per-location field at the observations."""
    return obs.join(field, on)


def scatter_add(obs: DataFrame, value: str, on) -> DataFrame:
    """Sums of an observation-wise vector per location."""
    return obs.groupBy(*([on] if isinstance(on, str) else on)).agg(F.sum(value).alias("total"))


def random_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `rank` from 1 in the order of a seeded hash (MD5 of seed and key, ties by key), equal in every run and in any engine."""
    from terrafield.operators.ranges import numbered

    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return numbered(df.withColumn("_h", h), [F.col("_h").asc(), F.col(key).asc()]).withColumn("rank", F.col("rank") + 1).drop("_h")


def first_index(df: DataFrame, condition: Column, index: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.when(condition, F.col(index))).alias("first_index"))


def burn_in(records: DataFrame, share: float = 0.5) -> DataFrame:
    """Records after the burn-in: iterations beyond share times a chain's last."""
    last = records.groupBy("chain").agg(F.max("iteration").alias("last"))
    return records.join(F.broadcast(last), "chain").where(F.col("iteration") > F.col("last") * F.lit(share)).drop("last")


def thin(records: DataFrame, keep: float, block: int = 100) -> DataFrame:
    """Iterations of each block of `block` whose multiple of keep is whole."""
    k = F.pmod(F.col("iteration") - 1, F.lit(block)) + 1
    return records.where(k * F.lit(keep) == F.floor(k * F.lit(keep)))


def concat_chains(*chains: DataFrame) -> DataFrame:
    out = chains[0]
    for c in chains[1:]:
        out = out.unionByName(c)
    return out


def with_intercept(df: DataFrame) -> DataFrame:
    return df.withColumn("intercept", F.lit(1.0))


# ----------------------------------------------------------------------------- three-way arrays as (i, j, k, value)


def cumsum_array(x: DataFrame, by=("i", "j"), along="k") -> DataFrame:
    """Adds `cumsum`: running totals of `value` along an axis, in blocks, so no task holds a group."""
    ranked = numbered(x, [*[F.col(c).asc_nulls_first() for c in by], F.col(along).asc()])
    first = ranked.groupBy(*by).agg(F.min("rank").alias("_first")).withColumnsRenamed({c: f"_{k}" for k, c in enumerate(by)})
    rows = ranked.join(first, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)])
    rows = rows.select(*x.columns, (F.col("rank") - F.col("_first") + 1).alias("_at"))
    return prefixes(rows, list(by), "_at", {"cumsum": F.col("value")}).drop("_at")


def multiply_array(x: DataFrame, m: DataFrame, axis: int) -> DataFrame:
    """Multiplies an array along an axis (1, 2, 3) by a matrix (row, col, m).

    Axis 3: x[i, j, ] M. Axis 2: M x[i, , j]. Axis 1: M x[, i, j]. The result has the matrix's other size along the axis.
    """
    c = ("i", "j", "k")[axis - 1]
    inner, outer = ("row", "col") if axis == 3 else ("col", "row")
    rest = [d for d in ("i", "j", "k") if d != c]
    y = x.join(F.broadcast(m) if _small(m) else m, x[c] == m[inner])
    return y.groupBy(*rest, F.col(outer).alias(c)).agg(F.sum(F.col("value") * F.col("m")).alias("value"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


# ----------------------------------------------------------------------------- bins and colours

# Upper bounds of the variance-loss bins, in per cent.
LOSS_BINS = (1, 2, 5, 10, 50, 100)


def cut_right_closed(value: Column, breaks=(0, *LOSS_BINS)) -> Column:
    """Label (a,b] of the bin a value falls in; the lowest bin is closed on both sides; else null."""
    out = F.when((value >= breaks[0]) & (value <= breaks[1]), F.lit(f"[{breaks[0]},{breaks[1]}]"))
    for a, b in zip(breaks[1:], breaks[2:]):
        out = out.when((value > a) & (value <= b), F.lit(f"({a},{b}]"))
    return out


def sturges(n: int) -> int:
    return math.ceil(math.log2(max(1, n)) + 1)


def histogram(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n): equal bins over the range, by Sturges' rule if not told; right-closed, the first closed on both sides."""
    s = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if not s.n:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    bins = bins or sturges(s.n)
    width = (float(s.hi) - float(s.lo)) / bins or 1.0
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(value) - F.lit(float(s.lo))) / F.lit(width)))).cast("int")
    out = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.lit(float(s.lo)) + (F.col("bin") - 1) * width).alias("low"), (F.lit(float(s.lo)) + F.col("bin") * width).alias("high"), "n")


def colour_index(df: DataFrame, value: str) -> DataFrame:
    """Adds `colour`, 1 to 91 of a 100-colour ramp by the value's place in the range, halves to even; null is 1."""
    s = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v, lo, hi = F.col(value).cast("double"), F.col("_lo").cast("double"), F.col("_hi").cast("double")
    place = F.when(hi > lo, F.bround((v - lo) / (hi - lo) * 90, 0) + 1)
    return df.crossJoin(F.broadcast(s)).withColumn("colour", F.coalesce(place, F.lit(1)).cast("int")).drop("_lo", "_hi")
