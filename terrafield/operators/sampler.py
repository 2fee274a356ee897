"""Markov chain kernels of the hierarchical model.

The model: z_i = x_i' beta + w[loc(i)] + noise, noise variance exp(X_noise noise_beta), field w = sd * L^-1 (white), log variance of the
field X_scale scale_beta, L the factor of the log ranges X_range range_beta. A chain's state and the arrays of its model live in one
process (a Spark task per chain, see run_chains), as the field's solves are sequential; sums over observations enter as
per-location sufficient sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from terrafield.functions.kernels import canonical_range, derivative_field_wrt_scale
from terrafield.operators.design import beta_prior_gradient, beta_prior_log_density, transition_kernels
from terrafield.operators.linalg import Factor, Graph, draw_field
from terrafield.operators.vecchia import factor_rows


def renew_momentum(p: np.ndarray, rng, kept: float = 0.9) -> np.ndarray:
    """sqrt(kept) p + sqrt(1 - kept) N(0, 1)."""
    if not 0 <= kept <= 1:
        raise ValueError("kept must lie in [0, 1]")
    return math.sqrt(kept) * p + math.sqrt(1 - kept) * rng.standard_normal(np.shape(p))


@dataclass
class Data:
    """Arrays of a model: locations, neighbours (n x (m+1), own first, -1 where none), observations and designs.

    Designs of range and scale are per location, those of response and noise per observation; `basis` matrices are appended to
    a design's columns by the caller, n_pp says how many of its last columns they are. loc_columns: columns of x constant within locations.
    """

    xy: np.ndarray
    parents: np.ndarray
    loc: np.ndarray
    z: np.ndarray
    x: np.ndarray
    x_locs: np.ndarray
    loc_columns: list[int]
    x_range: np.ndarray
    x_scale: np.ndarray
    x_noise: np.ndarray
    smoothness: float = 1.5
    n_pp: dict = field(default_factory=lambda: {"range": 0, "scale": 0, "noise": 0})
    means: dict = field(default_factory=lambda: {"range": -2.0, "scale": 0.0, "noise": 0.0})
    variances: dict = field(default_factory=lambda: {"range": 1.0, "scale": 1.0, "noise": 1.0})
    bounds: dict = field(default_factory=dict)  # of the log scales, by parameter
    n_observed: int = 0  # locations before those to predict, where a caller keeps both together

    _graph: Graph | None = field(default=None, repr=False)

    @property
    def graph(self) -> Graph:
        """The neighbour graph's entries and levels; it never changes, so they are found once."""
        if self._graph is None:
            self._graph = Graph(self.parents)
        return self._graph

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.loc, v, len(self.xy))

    def least_squares(self) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, the OLS coefficients and the residual variance."""
        g = self.x.T @ self.x
        b = np.linalg.solve(g, self.x.T @ self.z)
        return g, b, float(((self.z - self.x @ b) ** 2).sum() / max(1, len(self.z) - len(b)))

    def noise_gram(self) -> np.ndarray:
        return self.x_noise.T @ self.x_noise

    # What the kernels need of the locations. fieldtables.FieldTables answers the same by joins and aggregations on Spark.

    def gram(self, name: str) -> np.ndarray:
        """X'X of the design of range or scale."""
        x = self.x_range if name == "range" else self.x_scale
        return x.T @ x

    def factor(self, range_beta: np.ndarray) -> Factor:
        return build_factor(self, range_beta)

    def prior_field(self, s: State, rng) -> np.ndarray:
        """A draw of the field from its prior."""
        return s.sd(self) * s.factor.solve(rng.standard_normal(len(self.xy)))

    def posterior_field(self, s: State, rng) -> np.ndarray:
        """A draw of the field given all else."""
        s0, s1, _ = self.stats(s)
        return draw_field(s.factor, s.sd(self), s0, s1, rng)

    def interwoven_system(self, s: State) -> tuple[np.ndarray, np.ndarray]:
        """A'A and A'(L c / sd), A = L X_locs / sd and c the field with the part of X_locs."""
        sd = s.sd(self)
        c = s.field + self.x_locs @ s.beta[self.loc_columns]
        a = np.column_stack([s.factor.times(col / sd) for col in self.x_locs.T])
        return a.T @ a, a.T @ s.factor.times(c / sd)

    def shifted_field(self, s: State, by: np.ndarray) -> np.ndarray:
        """The field plus X_locs by."""
        return s.field + self.x_locs @ by

    def scaled_field(self, s: State, by: np.ndarray) -> np.ndarray:
        """The field times exp(X_scale by / 2)."""
        return s.field * np.exp(0.5 * (self.x_scale @ by)[:, 0])

    def range_potential(self, s: State, beta: np.ndarray, ancillary: bool):
        return (range_ancillary if ancillary else range_sufficient)(s, self, beta)

    def scale_potential(self, s: State, beta: np.ndarray, ancillary: bool):
        return (scale_ancillary if ancillary else scale_sufficient)(s, self, beta)

    # What the kernels need of the observations. distributed.ObservationTable answers the same by aggregations on Spark.

    def stats(self, s: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per location, the sums of 1, e and e^2 over the noise variance, e = z - x beta."""
        w, e = 1 / s.noise(self), self.z - self.x @ s.beta
        return self.sums(w), self.sums(w * e), self.sums(w * e * e)

    def beta_system(self, s: State) -> tuple[np.ndarray, np.ndarray]:
        """X'WX and X'W(z - field), W the noise precision."""
        w = 1 / s.noise(self)
        return self.x.T @ (self.x * w[:, None]), self.x.T @ (w * (self.z - s.field[self.loc]))

    def noise_terms(self, s: State, beta: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Sum of log variances, of squared residuals over them, and X_noise' (1/2 - 1/2 r^2 / variance)."""
        r2 = (self.z - self.x @ s.beta - s.field[self.loc]) ** 2
        log_tau = (self.x_noise @ beta)[:, 0]
        q = r2 * np.exp(-log_tau)
        return float(log_tau.sum()), float(q.sum()), self.x_noise.T @ (0.5 - 0.5 * q)[:, None]


@dataclass
class Cells(Data):
    """Data whose observations are summed up in cells: those of one location with one row of the noise design.

    A normal likelihood needs no more of them than their number, sum x, z, x x', x z and z^2, so kernels cost as much for a cell of a million
    observations as for one of one. loc, x_noise: per cell; z and x stay empty but for the number of columns.
    """

    n: np.ndarray = None
    zz: np.ndarray = None
    xz: np.ndarray = None  # cells x p
    xx: np.ndarray = None  # cells x p x p

    # the first column of x is the intercept, so sums of x and z are among those of x x' and x z

    def least_squares(self):
        g, v = self.xx.sum(0), self.xz.sum(0)
        b = np.linalg.solve(g, v)
        return g, b, float(max(1e-300, self.zz.sum() - b @ v) / max(1, self.n.sum() - len(b)))

    def noise_gram(self):
        return self.x_noise.T @ (self.x_noise * self.n[:, None])

    def _squares(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per cell, the sums of e and e^2, e = z - x beta."""
        xb = self.xx @ beta
        return self.xz[:, 0] - xb[:, 0], self.zz - 2 * self.xz @ beta + xb @ beta

    def stats(self, s):
        w = np.exp(-(self.x_noise @ s.noise_beta)[:, 0])
        e, e2 = self._squares(s.beta)
        return self.sums(w * self.n), self.sums(w * e), self.sums(w * e2)

    def beta_system(self, s):
        w = np.exp(-(self.x_noise @ s.noise_beta)[:, 0])
        return np.tensordot(w, self.xx, 1), w @ (self.xz - self.xx[:, 0] * s.field[self.loc][:, None])

    def noise_terms(self, s, beta):
        log_tau = (self.x_noise @ beta)[:, 0]
        e, e2 = self._squares(s.beta)
        f = s.field[self.loc]
        q = (e2 - 2 * f * e + self.n * f * f) * np.exp(-log_tau)
        return float((self.n * log_tau).sum()), float(q.sum()), self.x_noise.T @ (0.5 * self.n - 0.5 * q)[:, None]


@dataclass
class State:
    """Parameters and what follows from them. range_beta is p x 1 or p x 3; log_scale has 1 or 6 entries per basis."""

    beta: np.ndarray
    range_beta: np.ndarray
    scale_beta: np.ndarray
    noise_beta: np.ndarray
    field: np.ndarray
    log_scale: dict = field(default_factory=dict)
    momenta: dict = field(default_factory=dict)
    steps: dict = field(default_factory=transition_kernels)
    factor: Factor | None = None

    def sd(self, d: Data) -> np.ndarray:
        return np.exp(0.5 * (d.x_scale @ self.scale_beta)[:, 0])

    def noise(self, d: Data) -> np.ndarray:
        return np.exp((d.x_noise @ self.noise_beta)[:, 0])


def _row_batches(parents: np.ndarray, rows_at_once: int = 2048):
    """(rows, their neighbours) of equally many neighbours each."""
    size = (parents >= 0).sum(1)
    for k in np.unique(size):
        rows = np.nonzero(size == k)[0]
        for s in range(0, len(rows), rows_at_once):
            yield rows[s : s + rows_at_once], parents[rows[s : s + rows_at_once], :k]


def build_factor(d: Data, range_beta: np.ndarray) -> Factor:
    """The factor of every location, by batches of equally many neighbours."""
    f = d.x_range @ canonical_range(range_beta)
    coef = np.zeros(d.parents.shape)
    for rows, near in _row_batches(d.parents):
        coef[rows, : near.shape[1]] = factor_rows(d.xy[near], f[near], d.smoothness)[0]
    return Factor(d.parents, coef, graph=d.graph)


def factor_at(s: State, d: Data, range_beta: np.ndarray) -> Factor:
    """The factor at range_beta: the state's own, if they are the state's coefficients."""
    return s.factor if s.factor is not None and range_beta is s.range_beta else build_factor(d, range_beta)


def sandwich(d: Data, range_beta: np.ndarray, left: np.ndarray, right: np.ndarray, log_det: bool = False) -> np.ndarray:
    """Factor.sandwich of the factor at range_beta; derivatives are made batch by batch and never held for all rows."""
    f = d.x_range @ canonical_range(range_beta)
    out = np.zeros(f.shape)
    for rows, near in _row_batches(d.parents):
        coef, deriv = factor_rows(d.xy[near], f[near], d.smoothness, True)
        g = left[rows, None, None] * np.einsum("ikpj,ik->ipj", deriv, right[near])
        if log_det:
            g = g + deriv[:, 0] / coef[:, 0, None, None]
        np.add.at(out, near, g)
    return out


def draw_normal(precision: np.ndarray, rhs: np.ndarray, rng) -> np.ndarray | None:
    """A draw from N(precision^-1 rhs, precision^-1), or None if the precision isn't finite and positive definite."""
    if not np.isfinite(precision).all():
        return None
    try:
        c = np.linalg.cholesky(precision)
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(c.T, np.linalg.solve(c, rhs) + rng.standard_normal(len(rhs)))


# ----------------------------------------------------------------------------- Gibbs kernels


def beta_centred(s: State, d: Data, rng) -> None:
    """Regression given the field."""
    b = draw_normal(*d.beta_system(s), rng)
    if b is not None:
        s.beta = b


def beta_interwoven(s: State, d: Data, rng) -> None:
    """Regressors constant within locations, given field plus their part: the field is shifted along."""
    if not d.loc_columns:
        return
    b = draw_normal(*d.interwoven_system(s), rng)
    if b is not None:
        old = s.beta[d.loc_columns].copy()
        s.beta[d.loc_columns] = b
        s.field = d.shifted_field(s, old - b)


def field_gibbs(s: State, d: Data, rng) -> None:
    """The latent field given all else."""
    s.field = d.posterior_field(s, rng)


# ----------------------------------------------------------------------------- potentials and gradients


def _prior(s: State, d: Data, name: str, beta: np.ndarray) -> float:
    return beta_prior_log_density(beta, d.n_pp[name], d.means[name], d.variances[name], s.log_scale.get(name, [0.0]))


def _prior_gradient(s: State, d: Data, name: str, beta: np.ndarray) -> np.ndarray:
    return beta_prior_gradient(beta, d.n_pp[name], d.means[name], d.variances[name], s.log_scale.get(name, [0.0]))


def _range_gradient(d: Data, by_field: np.ndarray) -> np.ndarray:
    """Gradient by log ranges -> by range_beta: the design's and the basis change's transposes."""
    basis = canonical_range(np.eye(by_field.shape[1])) if by_field.shape[1] == 3 else np.array([[2.0]])
    return d.x_range.T @ by_field @ basis.T


def range_ancillary(s: State, d: Data, beta: np.ndarray, grad: bool = True):
    """(U, gradient, field): the white noise of the field stays, the field moves with its factor."""
    sd = s.sd(d)
    white = s.factor.times(s.field / sd)
    f = factor_at(s, d, beta)
    w = sd * f.solve(white)
    s0, s1, s2 = d.stats(s)
    u = -_prior(s, d, "range", beta) + 0.5 * (s2 - 2 * w * s1 + w * w * s0).sum()
    if not grad:
        return u, None, (f, w)
    left = f.transpose_solve((s1 - w * s0) * sd)
    return u, -_prior_gradient(s, d, "range", beta) + _range_gradient(d, sandwich(d, beta, left, w / sd)), (f, w)


def range_sufficient(s: State, d: Data, beta: np.ndarray, grad: bool = True):
    """(U, gradient, factor): the field stays."""
    f = factor_at(s, d, beta)
    v = s.field / s.sd(d)
    lv = f.times(v)
    u = -_prior(s, d, "range", beta) + 0.5 * (lv**2).sum() - np.log(f.coef[:, 0]).sum()
    if not grad:
        return u, None, f
    by = -sandwich(d, beta, -lv, v, log_det=True)
    return u, -_prior_gradient(s, d, "range", beta) + _range_gradient(d, by), f


def noise_potential(s: State, d: Data, beta: np.ndarray):
    logs, squares, g = d.noise_terms(s, beta)
    return -_prior(s, d, "noise", beta) + 0.5 * logs + 0.5 * squares, -_prior_gradient(s, d, "noise", beta) + g


def scale_sufficient(s: State, d: Data, beta: np.ndarray):
    log_s = (d.x_scale @ beta)[:, 0]
    v = s.field * np.exp(-0.5 * log_s)
    lv = s.factor.times(v)
    u = -_prior(s, d, "scale", beta) + 0.5 * log_s.sum() + 0.5 * (lv**2).sum()
    g = 0.5 - 0.5 * v * s.factor.transpose_times(lv)
    return u, -_prior_gradient(s, d, "scale", beta) + d.x_scale.T @ g[:, None]


def scale_ancillary(s: State, d: Data, beta: np.ndarray):
    """(U, gradient): the field is scaled along."""
    w = s.field * np.exp(0.5 * (d.x_scale @ (beta - s.scale_beta))[:, 0])
    s0, s1, s2 = d.stats(s)
    u = -_prior(s, d, "scale", beta) + 0.5 * (s2 - 2 * w * s1 + w * w * s0).sum()
    return u, -_prior_gradient(s, d, "scale", beta) + d.x_scale.T @ (0.5 * w * (w * s0 - s1))[:, None]


# ----------------------------------------------------------------------------- Metropolis kernels

# How a log step size moves after each try, and after an accepted one; `it` counts iterations.
ADAPT = {
    "range": (lambda it: -15 / (it + 100), lambda it: 20 / (it + 100)),
    "noise": (lambda it: -1 / math.sqrt(it + 100), lambda it: 2 / math.sqrt(it + 100)),
    "noise_log_scale": (lambda it: -1 / math.sqrt(it + 100), lambda it: 4 / math.sqrt(it + 100)),
    "scale": (lambda it: -1 / math.sqrt(it + 100), lambda it: 2 / math.sqrt(it + 100)),
    "scale_log_scale": (lambda it: -0.25 / math.sqrt(it + 100), lambda it: 1 / math.sqrt(it + 100)),
}


def _adapt(s: State, key: str, family: str, it: int, accepted: bool) -> None:
    miss, hit = ADAPT[family]
    s.steps[key][0] += miss(it) + (hit(it) if accepted else 0.0)


def leapfrog(s: State, key: str, family: str, beta: np.ndarray, potential, whiten: np.ndarray, it: int, rng):
    """One Hamiltonian step of one leapfrog in coordinates whitened by an upper factor. Returns (new beta, last) if accepted, else None."""
    eps = math.exp(s.steps[key][0])
    p = renew_momentum(s.momenta.get(key, rng.standard_normal(beta.shape)), rng)
    u0, g0, *_ = potential(beta)
    half = p - 0.5 * eps * np.linalg.solve(whiten.T, g0)
    new = beta + eps * np.linalg.solve(whiten, half)
    u1, g1, *last = potential(new)
    end = half - 0.5 * eps * np.linalg.solve(whiten.T, g1)
    accepted = bool(np.isfinite(u1) and math.log(rng.random()) < u0 - u1 + 0.5 * (p**2).sum() - 0.5 * (end**2).sum())
    s.momenta[key] = end if accepted else -p
    _adapt(s, key, family, it, accepted)
    return (new, last) if accepted else None


def _whiten(gram: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(gram + 1e-10 * np.eye(len(gram))).T


def range_hmc(s: State, d: Data, it: int, rng) -> None:
    w = _whiten(d.gram("range"))
    if got := leapfrog(s, "range_beta_ancillary", "range", s.range_beta, lambda b: d.range_potential(s, b, True), w, it, rng):
        s.range_beta, (s.factor, s.field) = got[0], got[1][0]
    if got := leapfrog(s, "range_beta_sufficient", "range", s.range_beta, lambda b: d.range_potential(s, b, False), w, it, rng):
        s.range_beta, s.factor = got[0], got[1][0]


def noise_hmc(s: State, d: Data, it: int, rng) -> None:
    if got := leapfrog(s, "noise_beta_mala", "noise", s.noise_beta, lambda b: noise_potential(s, d, b), _whiten(d.noise_gram()), it, rng):
        s.noise_beta = got[0]


def scale_hmc(s: State, d: Data, it: int, rng) -> None:
    w = _whiten(d.gram("scale"))
    if got := leapfrog(s, "scale_beta_sufficient_mala", "scale", s.scale_beta, lambda b: d.scale_potential(s, b, False), w, it, rng):
        s.scale_beta = got[0]
    old = s.scale_beta
    if got := leapfrog(s, "scale_beta_ancillary_mala", "scale", old, lambda b: d.scale_potential(s, b, True), w, it, rng):
        s.field = d.scaled_field(s, got[0] - old)
        s.scale_beta = got[0]


# Plain walks of a log scale after each of its other moves, and their standard deviation.
WALKS = {"range": 10, "noise": 10, "scale": 4}
WALK_SD = 0.1


def _inside(d: Data, name: str, v: np.ndarray) -> bool:
    from terrafield.functions.kernels import expmat

    low, high = d.bounds.get(name, (-6.0, 3.0))
    e = np.log(np.maximum(np.linalg.eigvalsh(expmat(v)), 1e-300))
    return bool(low <= e.min() and e.max() <= high)


def _along(beta: np.ndarray, k: int, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """beta whose k last rows, whitened by the log scale `old`, are coloured by `new`."""
    from terrafield.functions.kernels import expmat

    up = lambda v: np.linalg.cholesky(expmat(v)).T
    out = beta.copy()
    out[-k:] = beta[-k:] @ np.linalg.inv(up(old)) @ up(new)
    return out


def log_scale_prior_walk(s: State, d: Data, name: str, rng) -> None:
    """Random walks of a log scale, coefficients stay: only their prior judges."""
    for _ in range(WALKS[name]):
        new = s.log_scale[name] + WALK_SD * rng.standard_normal(len(s.log_scale[name]))
        beta = getattr(s, f"{name}_beta")
        if _inside(d, name, new) and math.log(rng.random()) < _prior(replace(s, log_scale={**s.log_scale, name: new}), d, name, beta) - _prior(s, d, name, beta):
            s.log_scale[name] = new


def range_log_scale_potential(s: State, d: Data, q: np.ndarray, ancillary: bool):
    """(U, gradient, coefficients, factor or (factor, field)) at the log scale q, the coefficients moved along; infinite outside the bounds.

    The whitened coefficients don't change, so their prior drops out and the data's part counts alone.
    """
    k, old_q, old = d.n_pp["range"], s.log_scale["range"], s.range_beta
    if not _inside(d, "range", q):
        return math.inf, np.zeros_like(q), old, None
    beta = _along(old, k, old_q, q)
    u, g, last = d.range_potential(s, beta, ancillary)
    u, g = u + _prior(s, d, "range", beta), g + _prior_gradient(s, d, "range", beta)
    by = np.einsum("ik,ikc->c", g[-k:], derivative_field_wrt_scale(beta[-k:], q))
    return u, by, beta, last


def range_log_scale_hmc(s: State, d: Data, it: int, rng, ancillary: bool) -> None:
    """A Hamiltonian step of the range's log scale; the field stays, or (ancillary) moves with its factor."""
    q = s.log_scale["range"]
    key = "range_log_scale_ancillary" if ancillary else "range_log_scale_sufficient"
    if got := leapfrog(s, key, "range", q, lambda v: range_log_scale_potential(s, d, v, ancillary), np.eye(len(q)), it, rng):
        s.log_scale["range"], (s.range_beta, last) = got[0], got[1]
        if ancillary:
            s.factor, s.field = last
        else:
            s.factor = last


def variance_log_scale_walk(s: State, d: Data, name: str, key: str, it: int, rng, moves_field: bool = False) -> None:
    """A walk of the log scale of noise or scale, its coefficients move along; the field stays, or is scaled along."""
    new = s.log_scale[name] + math.exp(s.steps[key][0]) * rng.standard_normal(len(s.log_scale[name]))
    beta, ok = getattr(s, f"{name}_beta"), False
    if _inside(d, name, new):
        moved = _along(beta, d.n_pp[name], s.log_scale[name], new)
        potential = noise_potential if name == "noise" else lambda s, d, b: d.scale_potential(s, b, moves_field)
        # the prior of the whitened coefficients doesn't change, so only the data's part counts
        u0, u1 = (potential(s, d, b)[0] + _prior(s, d, name, b) for b in (beta, moved))
        ok = bool(math.log(rng.random()) < u0 - u1)
        if ok:
            if moves_field:
                s.field = d.scaled_field(s, moved - beta)
            setattr(s, f"{name}_beta", moved)
            s.log_scale[name] = new
    _adapt(s, key, f"{name}_log_scale", it, ok)


def log_scale_kernels(s: State, d: Data, name: str, it: int, rng) -> None:
    """All moves of a basis's log scale, see WALKS: after each move that takes the coefficients along, walks that leave them."""
    if not d.n_pp[name] or name not in s.log_scale:
        return
    if name == "noise":
        variance_log_scale_walk(s, d, name, "noise_log_scale", it, rng)
        log_scale_prior_walk(s, d, name, rng)
        return
    for ancillary in (False, True):
        if name == "range":
            range_log_scale_hmc(s, d, it, rng, ancillary)
        else:
            variance_log_scale_walk(s, d, name, f"scale_log_scale_{'ancillary' if ancillary else 'sufficient'}", it, rng, ancillary)
        log_scale_prior_walk(s, d, name, rng)


# ----------------------------------------------------------------------------- chains


def initial_state(d: Data, seed: int, chain: int) -> State:
    """OLS plus a draw of its error, prior means for the intercepts, a field drawn from its prior."""
    rng = np.random.Generator(np.random.PCG64([seed, chain]))
    g, b, var = d.least_squares()
    beta = b + np.linalg.cholesky(var * np.linalg.inv(g) + 1e-300 * np.eye(len(b))) @ rng.standard_normal(len(b))

    def first(x, name, cols=1):
        out = np.zeros((x.shape[1], cols))
        if len(out):
            out[0, 0] = d.means[name]
        return out

    comps = 3 if d.bounds.get("anisotropic") else 1
    s = State(beta, first(d.x_range, "range", comps), first(d.x_scale, "scale"), first(d.x_noise, "noise"), None)
    for name in ("range", "scale", "noise"):
        if d.n_pp[name]:
            low = d.bounds.get(name, (-6.0, 3.0))[0]
            s.log_scale[name] = np.array([low] * 3 + [0.0] * 3) if name == "range" and comps == 3 else np.array([low])
    s.factor = d.factor(s.range_beta)
    s.field = d.prior_field(s, rng)
    return s


def step(s: State, d: Data, it: int, rng, hyper: bool = True) -> State:
    """One iteration: regression, interweaving, field, then the covariance parameters."""
    beta_centred(s, d, rng)
    beta_interwoven(s, d, rng)
    field_gibbs(s, d, rng)
    if hyper:
        range_hmc(s, d, it, rng)
        noise_hmc(s, d, it, rng)
        scale_hmc(s, d, it, rng)
        for name in ("range", "noise", "scale"):
            log_scale_kernels(s, d, name, it, rng)
    return s


def record(s: State, chain: int, it: int, with_field: bool = True) -> list[tuple]:
    """Rows (chain, iteration, param, i, j, value) of a state; i and j count from 1."""
    out = [(chain, it, "beta", i + 1, 1, float(v)) for i, v in enumerate(s.beta)]
    for name in ("range_beta", "scale_beta", "noise_beta"):
        m = getattr(s, name)
        out += [(chain, it, name, i + 1, j + 1, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    for name, v in s.log_scale.items():
        out += [(chain, it, f"{name}_log_scale", i + 1, 1, float(x)) for i, x in enumerate(v)]
    if with_field:
        out += [(chain, it, "field", i + 1, 1, float(v)) for i, v in enumerate(s.field)]
    return out


RECORDS = "chain int, iteration int, param string, i int, j int, value double"


def kept_iterations(n: int, thinning: float) -> list[int]:
    """Iterations of a run whose multiple of `thinning` is a whole number."""
    return [i for i in range(1, n + 1) if i * thinning == math.floor(i * thinning)]


def chain_blocks(d: Data, chain: int, n: int, seed: int = 1, start: int = 0, state: State | None = None, thinning: float = 1.0, hyper: bool = True, with_field: bool = True, rows_at_once: int = 200_000):
    """Runs n more iterations from `start`; yields (None, records) block by block, then (state, the rest of the records)."""
    s = state or initial_state(d, seed, chain)
    if s.factor is None:
        s.factor = d.factor(s.range_beta)
    rng = np.random.Generator(np.random.PCG64([seed, chain, start + 1]))
    keep, rows = set(kept_iterations(n, thinning)), []
    for k in range(1, n + 1):
        step(s, d, start + k, rng, hyper)
        if k in keep:
            rows += record(s, chain, start + k, with_field)
        if len(rows) >= rows_at_once:
            yield None, rows
            rows = []
    yield s, rows


def run_chain(d: Data, chain: int, n: int, **how):
    """The same at once: (state, records). A run continues from the state it returned."""
    every = []
    for state, rows in chain_blocks(d, chain, n, **how):
        every += rows
    return state, every


RECORD_COLUMNS = ["chain", "iteration", "param", "i", "j", "value"]


def chain_frames(blocks, chain: int):
    """Blocks of a chain as pandas frames of RECORDS and `state`; the last row carries the state, without its factor, which follows from it."""
    import pickle

    import pandas as pd

    for state, rows in blocks:
        if rows:
            yield pd.DataFrame(rows, columns=RECORD_COLUMNS).assign(state=None)
        if state is not None:
            yield pd.DataFrame([(chain, None, None, None, None, None, pickle.dumps(replace(state, factor=None)))], columns=[*RECORD_COLUMNS, "state"])


def run_chains(spark, d: Data, chains: int, n: int, states: dict | None = None, **how):
    """(RECORDS, state) of several chains, a Spark task each, written in blocks; a lost task runs its chain again to the same numbers."""
    shared = spark.sparkContext.broadcast((d, states or {}))

    def run(frames):
        data, old = shared.value
        for pdf in frames:
            for c in pdf.chain:
                yield from chain_frames(chain_blocks(data, int(c), n, state=old.get(int(c)), **how), int(c))

    ids = spark.range(1, chains + 1, numPartitions=chains).selectExpr("cast(id as int) as chain")
    return ids.mapInPandas(run, f"{RECORDS}, state binary")


def run_chains_of(places, build, chains: int, n: int, **how):
    """The same over a table of locations, places(id, ...): each chain's task is dealt the rows in the order of id and makes its Data of them by
    build(an Arrow table), so the driver holds nothing of the locations' size."""
    from pyspark.sql import functions as F

    rows = places.withColumn("_chain", F.explode(F.sequence(F.lit(1), F.lit(chains))))
    rows = rows.repartitionById(chains, F.col("_chain")).sortWithinPartitions("id")

    def run(batches):
        import pyarrow as pa

        got = list(batches)
        if not got or not sum(b.num_rows for b in got):
            return
        chain = got[0].column("_chain")[0].as_py()
        data = build(pa.Table.from_batches(got).drop_columns("_chain"))
        del got
        kinds = pa.schema([("chain", pa.int32()), ("iteration", pa.int32()), ("param", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64()), ("state", pa.binary())])
        for pdf in chain_frames(chain_blocks(data, chain, n, **how), chain):
            yield pa.RecordBatch.from_pandas(pdf, schema=kinds, preserve_index=False)

    return rows.mapInArrow(run, f"{RECORDS}, state binary")


# ----------------------------------------------------------------------------- prediction


def prediction_rows(xy: np.ndarray, f: np.ndarray, parents: np.ndarray, smoothness: float) -> np.ndarray:
    """Factor rows of points on their neighbours, parents n x (k + 1) with a point's own index first; rows as in Factor.coef."""
    coef = np.zeros(parents.shape)
    for rows, near in _row_batches(parents):
        coef[rows, : near.shape[1]] = factor_rows(xy[near], f[near], smoothness)[0]
    return coef


def predict_field(xy_obs, parents_new, xy_new, f_obs, f_new, sd_obs, sd_new, field_obs, smoothness, rng=None, graph: Graph | None = None) -> np.ndarray:
    """The field at new locations given that at observed ones; without rng the conditional mean.

    parents_new: n_new x k indices into the observed locations followed by the new ones, -1 where none; the new ones' graph has no cycle. Rows
    are made in batches and solved level by level, so the cost is that of the neighbours, whatever the number of locations.
    """
    n, new = len(xy_obs), len(xy_new)
    parents = np.column_stack([n + np.arange(new), parents_new])
    coef = prediction_rows(np.concatenate([xy_obs, xy_new]), np.concatenate([f_obs, f_new]), parents, smoothness)
    graph = graph or prediction_graph(parents_new, n)
    white = np.concatenate([field_obs / sd_obs, np.zeros(new)])
    z = rng.standard_normal(new) if rng is not None else np.zeros(new)
    near = np.where(parents >= 0, parents, 0)
    for rows in graph.levels:
        rest = (coef[rows, 1:] * white[near[rows, 1:]]).sum(1)  # coefficients are 0 where there is no neighbour
        white[n + rows] = (z[rows] - rest) / coef[rows, 0]
    return sd_new * white[n:]


def prediction_graph(parents_new: np.ndarray, n_obs: int) -> Graph:
    """The graph of the new locations among themselves."""
    return Graph(np.column_stack([np.arange(len(parents_new)), np.where(parents_new >= n_obs, parents_new - n_obs, -1)]))
