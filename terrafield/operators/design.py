"""Design tables, ordinary least squares and the priors that follow from the data."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrafield.operators.linalg import gram_np

INTERCEPT = "intercept"
#: Levels of a factor, at most: each but the first is a column.
MAX_LEVELS = 1000


def model_matrix(df: DataFrame, numeric=(), factors=()) -> tuple[DataFrame, list[str]]:
    """df with an intercept and treatment contrasts of the factors (first level by name left out); and the column names."""
    names, cols = [INTERCEPT, *numeric], {INTERCEPT: F.lit(1.0)}
    cols |= {c: F.col(c).cast("double") for c in numeric}
    for f in factors:
        found = df.select(f).where(F.col(f).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels of {f}")
        for level in sorted(r[0] for r in found)[1:]:
            cols[f"{f}{level}"] = F.when(F.col(f) == level, 1.0).otherwise(0.0)
            names.append(f"{f}{level}")
    return df.withColumns(cols), names


@dataclass
class Design:
    """A design: its table, its columns, which of them are constant within locations, and Gram matrices."""

    table: DataFrame
    names: list[str]
    gram: np.ndarray
    chol: np.ndarray
    which_locs: list[str]
    locs: DataFrame
    gram_locs: np.ndarray
    chol_locs: np.ndarray = field(default=None)


def which_constant(table: DataFrame, names, on="loc_id") -> list[str]:
    """Columns with one value per location: a maximum of distinct counts, exact and map-side combined."""
    per = table.groupBy(on).agg(*[(F.min(n) == F.max(n)).alias(n) for n in names])
    got = per.agg(*[F.min(F.col(n).cast("int")).alias(n) for n in names]).first()
    return [n for n in names if got[n] == 1]


def process_covariates(obs: DataFrame, numeric=(), on="loc_id", order="obs_id", one_obs_per_locs: bool = False, pp=None) -> Design:
    """The design of obs(obs_id, loc_id, covariates); collinear columns are refused.

    With a basis `pp` (operators.basis) its columns follow the design's in both Gram matrices, per observation and per location.
    """
    strings = [c for c in numeric if isinstance(obs.schema[c].dataType, StringType)]
    table, names = model_matrix(obs, [c for c in numeric if c not in strings], strings)
    g, _ = gram_np(table, names)
    if np.linalg.det(g) < 1e-10:
        raise ValueError("some covariates are linearly dependent")
    constant = which_constant(table, names, on)
    if one_obs_per_locs and len(constant) < len(names):
        raise ValueError(f"these covariates vary within locations: {sorted(set(names) - set(constant))}")
    first = table.groupBy(on).agg(*[F.min_by(n, order).alias(n) for n in constant])
    gl, _ = gram_np(first, constant)
    if pp is not None:
        phi = [f"phi{k}" for k in range(len(pp.knots))]
        values = pp.dense_rows().select(F.col("id").alias(on), *[F.col("phi")[k].alias(c) for k, c in enumerate(phi)])
        g, gl = gram_np(table.join(values, on), [*names, *phi])[0], gram_np(first.join(values, on), [*constant, *phi])[0]
    upper = lambda a: np.linalg.cholesky(a + 1e-10 * np.eye(len(a))).T
    return Design(table, names, g, upper(g), constant, first, gl, upper(gl))


def process_pp_prior(pp, bounds, name: str):
    """Bounds of a basis's log scale: none without a basis, (-6, 3) by default, two numbers in order."""
    if pp is None:
        if bounds is not None:
            raise ValueError(f"{name} bounds were given without a {name} basis")
        return None
    if bounds is None:
        warnings.warn(f"the bounds of the {name} log scale are set to (-6, 3)", stacklevel=2)
        return (-6.0, 3.0)
    if isinstance(bounds, str) or not hasattr(bounds, "__len__") or len(bounds) != 2 or not all(isinstance(b, (int, float)) for b in bounds):
        raise ValueError(f"the bounds of the {name} log scale should be two numbers")
    return tuple(sorted(map(float, bounds)))


# The kernels that carry a log step size, and how many each has.
KERNELS = (
    ("range_log_scale_sufficient", 1),
    ("range_log_scale_ancillary", 1),
    ("range_beta_sufficient", 4),
    ("range_beta_ancillary", 4),
    ("scale_beta_sufficient_mala", 2),
    ("scale_beta_ancillary_mala", 2),
    ("scale_log_scale_sufficient", 1),
    ("scale_log_scale_ancillary", 1),
    ("noise_beta_mala", 2),
    ("noise_log_scale", 1),
)


def transition_kernels(init: float = -4.0) -> dict[str, list[float]]:
    """Initial log step sizes of the ten kernels."""
    return {name: [init] * n for name, n in KERNELS}


@dataclass(frozen=True)
class Priors:
    sigma: tuple[float, float]
    alpha: tuple[float, float]

    @property
    def means(self) -> dict[str, float]:
        s, a = sum(self.sigma) / 2, sum(self.alpha) / 2
        return {"noise": s, "scale": s, "range": a}

    @property
    def variances(self) -> dict[str, float]:
        s, a = ((self.sigma[1] - self.sigma[0]) / 8) ** 2, ((self.alpha[1] - self.alpha[0]) / 8) ** 2
        return {"noise": s, "scale": s, "range": a}


def prior_bounds(residual_variance: float, max_dist: float, median_nn: float, smoothness: float) -> Priors:
    """Log variances between 1 and 99 per cent of the residuals'; log ranges between three neighbour distances and an eighth of the domain."""
    if smoothness not in (0.5, 1.5):
        raise ValueError("the smoothness is 0.5 or 1.5")
    base = -0.5 * math.log(8 * smoothness)
    return Priors((math.log(0.01 * residual_variance), math.log(0.99 * residual_variance)), (base + math.log(3 * median_nn), base + math.log(max_dist / 8)))


def beta_prior_log_density(beta, n_pp: int, mean: float, var: float, log_scale) -> float:
    """Log density (up to a constant) of coefficients: intercept N(mean, var), other regressors N(0, 100), basis rows N(0, expmat(log_scale))."""
    from terrafield.functions.kernels import expmat

    beta = np.atleast_2d(np.asarray(beta, float))
    reg, pp = beta[: len(beta) - n_pp], beta[len(beta) - n_pp :]
    out = -0.5 * (reg[0, 0] - mean) ** 2 / var - 0.5 * 0.01 * ((reg**2).sum() - reg[0, 0] ** 2)
    if n_pp:
        p = expmat(-np.asarray(log_scale, float))
        out += 0.5 * n_pp * np.linalg.slogdet(p)[1] - 0.5 * ((pp @ p) * pp).sum()
    return float(out)


def beta_prior_gradient(beta, n_pp: int, mean: float, var: float, log_scale) -> np.ndarray:
    from terrafield.functions.kernels import expmat

    beta = np.atleast_2d(np.asarray(beta, float))
    out = -beta / 100
    out[0, 0] = -(beta[0, 0] - mean) / var
    if n_pp:
        out[len(beta) - n_pp :] = -beta[len(beta) - n_pp :] @ expmat(-np.asarray(log_scale, float))
    return out
