"""Factor, solves and chain kernels against dense algebra and finite differences."""

import numpy as np
import pytest

from terrafield.functions.kernels import canonical_range, covariance
from terrafield.operators import design, diagnostics, linalg, sampler, vecchia


def _data(n=60, m=6, aniso=False, seed=0, k=2):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2))
    parents = np.full((n, m + 1), -1, np.int64)
    parents[:, 0] = np.arange(n)
    for i in range(1, n):
        near = np.argsort(((xy[:i] - xy[i]) ** 2).sum(1))[:m]
        parents[i, 1 : len(near) + 1] = near
    loc = np.repeat(np.arange(n), k)
    x_locs = np.column_stack([np.ones(n), xy[:, 0]])
    x = np.column_stack([x_locs[loc], rng.normal(size=n * k)])
    z = rng.normal(size=n * k) + x @ [1.0, 2.0, -1.0]
    return sampler.Data(xy, parents, loc, z, x, x_locs, [0, 1], x_locs, x_locs, x_locs[loc], bounds={"anisotropic": aniso})


def test_full_neighbourhoods_invert_the_covariance():
    d = _data(25, 24)
    f = sampler.build_factor(d, np.array([[-1.0], [0.4]]))
    lr = d.x_range @ canonical_range(np.array([[-1.0], [0.4]]))
    c = covariance(d.xy[:, None] - d.xy[None], lr[:, None], lr[None], 1.5)
    np.fill_diagonal(c, 1.00001)
    l = f.dense()
    off = l @ c @ l.T
    off[0, 0] = 1  # the first row is 1 by definition
    assert np.allclose(off, np.eye(25), atol=1e-4)


def test_products_and_solves():
    f = sampler.build_factor(_data(), np.array([[-1.0], [0.4]]))
    l, v = f.dense(), np.random.default_rng(1).normal(size=60)
    assert np.allclose(f.times(v), l @ v)
    assert np.allclose(f.transpose_times(v), l.T @ v)
    assert np.allclose(l @ f.solve(v), v)
    assert np.allclose(l.T @ f.transpose_solve(v), v)


@pytest.mark.parametrize("d", [1, 3])
@pytest.mark.parametrize("nu", [0.5, 1.5])
def test_factor_gradients_by_finite_differences(d, nu):
    rng = np.random.default_rng(2)
    xy, f = rng.random((7, 5, 2)), rng.normal(-1, 0.3, (7, 5, d))
    coef, deriv = vecchia.factor_rows(xy, f, nu, True)
    for p in range(5):
        for j in range(d):
            up, down = f.copy(), f.copy()
            up[:, p, j] += 1e-5
            down[:, p, j] -= 1e-5
            fd = (vecchia.factor_rows(xy, up, nu)[0] - vecchia.factor_rows(xy, down, nu)[0]) / 2e-5
            assert np.allclose(deriv[:, :, p, j], fd, rtol=2e-3, atol=2e-3 * np.abs(coef).max())


def _check_gradient(potential, beta, tol=2e-3):
    u, g = potential(beta)[:2]
    for i in np.ndindex(beta.shape):
        step = np.zeros_like(beta)
        step[i] = 1e-5
        fd = (potential(beta + step)[0] - potential(beta - step)[0]) / 2e-5
        assert g[i] == pytest.approx(fd, rel=tol, abs=tol * max(1, np.abs(g).max()))


@pytest.mark.parametrize("aniso", [False, True])
def test_potential_gradients(aniso):
    d = _data(aniso=aniso)
    s = sampler.initial_state(d, 1, 1)
    rng = np.random.default_rng(5)
    _check_gradient(lambda b: sampler.range_ancillary(s, d, b), s.range_beta + 0.1 * rng.normal(size=s.range_beta.shape), 5e-3)
    _check_gradient(lambda b: sampler.range_sufficient(s, d, b), s.range_beta + 0.1 * rng.normal(size=s.range_beta.shape), 5e-3)
    _check_gradient(lambda b: sampler.noise_potential(s, d, b), s.noise_beta + 0.1)
    _check_gradient(lambda b: sampler.scale_sufficient(s, d, b), s.scale_beta + 0.1)
    _check_gradient(lambda b: sampler.scale_ancillary(s, d, b), s.scale_beta + 0.1)


def test_prior_gradient():
    rng = np.random.default_rng(3)
    for cols, ls in ((1, [0.3]), (3, [0.1, 0.2, -0.1, 0.0, 0.1, 0.0])):
        _check_gradient(lambda b: (design.beta_prior_log_density(b, 4, -1.0, 2.0, ls), design.beta_prior_gradient(b, 4, -1.0, 2.0, ls)), rng.normal(size=(6, cols)))


def test_field_draws_have_the_posterior_moments():
    d = _data(20, 5)
    s = sampler.initial_state(d, 1, 1)
    rng = np.random.default_rng(4)
    l, sd, w = s.factor.dense(), s.sd(d), 1 / s.noise(d)
    q = (l.T @ l) / np.outer(sd, sd) + np.diag(d.sums(w))
    mean = np.linalg.solve(q, d.sums(w * (d.z - d.x @ s.beta)))
    draws = []
    for _ in range(3000):
        sampler.field_gibbs(s, d, rng)
        draws.append(s.field)
    draws, cov = np.array(draws), np.linalg.inv(q)
    assert np.allclose(draws.mean(0), mean, atol=5 * np.sqrt(np.diag(cov).max() / 3000))
    assert np.allclose(np.cov(draws.T), cov, atol=0.1 * np.diag(cov).max())


@pytest.mark.parametrize("coarse", [linalg.COARSE, 40, 0])
def test_draws_of_dense_fields_are_solved(coarse, monkeypatch):
    """Many locations within a range: scaled by the diagonal, gradients took 454 steps."""
    rng, n = np.random.default_rng(4), 1500
    xy = rng.normal(size=(n, 2)) * 0.01
    near = np.full((n, 6), -1, np.int64)
    near[:, 0] = np.arange(n)
    for i in range(1, n):
        got = np.argsort(((xy[:i] - xy[i]) ** 2).sum(1), kind="stable")[:5]
        near[i, 1 : 1 + len(got)] = got
    one = np.ones((n, 1))
    d = sampler.Data(xy, near, np.arange(n), rng.normal(size=n), one, one, [0], one, one, one)
    f, steps, plain = sampler.build_factor(d, np.array([[-1.0]])), [], linalg.conjugate_gradient
    sd, precision, rhs = np.full(n, 0.5), np.full(n, 148.0) * (np.arange(n) % 3 > 0), rng.normal(size=n)
    monkeypatch.setattr(linalg, "conjugate_gradient", lambda times, *a: plain(lambda v: steps.append(1) or times(v), *a))
    got = linalg.draw_field(f, sd, precision, rhs, np.random.default_rng(1), coarse)
    l, noise = f.dense() / sd, np.random.default_rng(1)
    b = rhs + l.T @ noise.standard_normal(n) + np.sqrt(precision) * noise.standard_normal(n)
    q = l.T @ l + np.diag(precision)
    assert np.linalg.norm(q @ got - b) < 1e-9 * np.linalg.norm(b) and len(steps) < 300


def test_chains_recover_the_regression_and_resume():
    d = _data(80, 5)
    s, rows = sampler.run_chain(d, 1, 150, seed=2)
    b = np.array([r[5] for r in rows if r[2] == "beta" and r[1] > 50]).reshape(-1, 3).mean(0)
    assert abs(b[2] + 1) < 0.3
    first, a = sampler.run_chain(d, 1, 5, seed=3)
    again, b = sampler.run_chain(d, 1, 5, seed=3)
    assert a == b
    _, more = sampler.run_chain(d, 1, 5, seed=3, start=5, state=first)
    assert {r[1] for r in more} == set(range(6, 11))
    parts = list(sampler.chain_blocks(d, 1, 5, seed=3, rows_at_once=100))
    assert len(parts) > 2 and [r for _, rows in parts for r in rows] == a and [s is None for s, _ in parts] == [True] * (len(parts) - 1) + [False]


def test_thinning_and_kernels():
    assert sampler.kept_iterations(100, 0.1) == list(range(10, 101, 10))
    k = design.transition_kernels(-5)
    assert len(k) == 10 and k["range_beta_sufficient"] == [-5] * 4 and k["noise_log_scale"] == [-5] and k["noise_beta_mala"] == [-5, -5]


def test_prior_bounds_of_a_basis():
    assert design.process_pp_prior(None, None, "x") is None
    assert design.process_pp_prior("basis", None, "x") == (-6, 3)
    assert design.process_pp_prior("basis", (2, 1), "x") == (1, 2)
    for bad in ("toto", (1, 2, 3), 1):
        with pytest.raises(ValueError):
            design.process_pp_prior("basis", bad, "x")
    with pytest.raises(ValueError):
        design.process_pp_prior(None, 1, "x")


def _size(x):
    x, n = x - x.mean(), len(x)
    return diagnostics.effective_size(np.array([x[: n - k] @ x[k:] / n for k in range(1 + int(10 * np.log10(n)))]), n)


def test_effective_size():
    rng = np.random.default_rng(0)
    white = rng.normal(size=4000)
    ar = np.zeros(4000)
    for i in range(1, 4000):
        ar[i] = 0.8 * ar[i - 1] + white[i]
    assert _size(white) == pytest.approx(4000, rel=0.15)
    assert _size(ar) == pytest.approx(4000 * 0.2 / 1.8, rel=0.35)
    assert _size(np.ones(10)) == 0


def test_momentum_keeps_its_variance():
    rng = np.random.default_rng(1)
    p = rng.standard_normal(20_000)
    assert sampler.renew_momentum(p, rng, 0.5).var() == pytest.approx(1, rel=0.05)
    with pytest.raises(ValueError):
        sampler.renew_momentum(p, rng, 2)


def test_conditional_mean_interpolates():
    d = _data(50, 8)
    f = np.full((51, 1), -2.0)
    w = np.sin(5 * d.xy[:, 0])
    near = np.argsort(((d.xy - d.xy[3]) ** 2).sum(1))[None, :8]
    got = sampler.predict_field(d.xy, near, d.xy[3:4] + 1e-6, f[:50], f[50:], np.ones(50), np.ones(1), w, 1.5)
    assert got[0] == pytest.approx(w[3], abs=1e-2)
    q = linalg.conjugate_gradient(lambda v: 2 * v, np.ones(4), np.full(4, 2.0))
    assert np.allclose(q, 0.5)


def test_levels_of_a_graph():
    d = _data(200, 5)
    level = np.zeros(200, int)
    for i in range(200):
        q = d.parents[i, 1:][d.parents[i, 1:] >= 0]
        level[i] = level[q].max() + 1 if len(q) else 0
    for k, rows in enumerate(d.graph.levels):
        assert sorted(rows) == np.nonzero(level == k)[0].tolist()
    assert sum(map(len, d.graph.levels)) == 200 and linalg.Graph(np.empty((0, 3), int)).levels == []
    with pytest.raises(ValueError):
        linalg.Graph(np.array([[0, 1], [1, 0]]))


@pytest.mark.parametrize("aniso", [False, True])
def test_batched_sandwiches(aniso):
    d = _data(aniso=aniso)
    beta = np.full((2, 3 if aniso else 1), -0.7)
    f, w = sampler.build_factor(d, beta), d.x_range @ canonical_range(beta)
    f.deriv = np.zeros((*d.parents.shape, d.parents.shape[1], w.shape[1]))
    for i, p in enumerate(d.parents):
        p = p[p >= 0]
        f.deriv[i, : len(p), : len(p)] = vecchia.factor_rows(d.xy[p][None], w[p][None], 1.5, True)[1][0]
    left, right = np.random.default_rng(6).normal(size=(2, 60))
    for log_det in (False, True):
        assert np.allclose(sampler.sandwich(d, beta, left, right, log_det), f.sandwich(left, right, log_det))


def _with_bases(aniso=False, seed=0):
    d = _data(50, 5, aniso, seed)
    phi = np.random.default_rng(7).normal(size=(50, 4))
    d.x_range, d.x_scale = np.column_stack([d.x_range, phi]), np.column_stack([d.x_scale, phi])
    d.x_noise = np.column_stack([d.x_noise, phi[d.loc]])
    d.n_pp = {"range": 4, "scale": 4, "noise": 4}
    s = sampler.initial_state(d, 1, 1)
    rng = np.random.default_rng(8)
    for name in ("range", "scale", "noise"):
        m = getattr(s, f"{name}_beta")
        m[-4:] = 0.1 * rng.normal(size=m[-4:].shape)
        s.log_scale[name] = np.array([-2.0, -1.5, -2.5, 0.1, 0.2, -0.1]) if name == "range" and aniso else np.array([-2.0])
    s.factor = sampler.build_factor(d, s.range_beta)
    return d, s


@pytest.mark.parametrize("aniso", [False, True])
@pytest.mark.parametrize("ancillary", [False, True])
def test_log_scale_gradients(aniso, ancillary):
    d, s = _with_bases(aniso)
    _check_gradient(lambda q: sampler.range_log_scale_potential(s, d, q, ancillary), s.log_scale["range"] + 0.1, 1e-2)
    assert sampler.range_log_scale_potential(s, d, s.log_scale["range"] + 50, ancillary)[0] == np.inf


@pytest.mark.parametrize("aniso", [False, True])
def test_every_log_scale_kernel_moves_within_its_bounds(aniso):
    d, s = _with_bases(aniso)
    seen = {n: [] for n in s.log_scale}
    rng = np.random.default_rng(9)
    for it in range(1, 30):
        for name in seen:
            sampler.log_scale_kernels(s, d, name, it, rng)
            assert sampler._inside(d, name, s.log_scale[name])
            seen[name].append(s.log_scale[name].copy())
    assert all(len(np.unique(np.round(v, 9), axis=0)) > 10 for v in seen.values())
    # a field that moves with the factor keeps its white noise, and the factor is that of the coefficients
    assert np.allclose(s.factor.coef, sampler.build_factor(d, s.range_beta).coef)
    assert all(s.steps[k][0] != -4 for k in ("range_log_scale_sufficient", "range_log_scale_ancillary", "scale_log_scale_sufficient", "scale_log_scale_ancillary", "noise_log_scale"))
    assert set(s.steps) == set(design.transition_kernels())


def test_log_scale_walk_has_the_prior_as_its_law():
    """Without any moves of the coefficients, the log scale given them: inverse-gamma like, compared with its density on a grid."""
    d, s = _with_bases()
    d.bounds["noise"] = (-6.0, 3.0)
    rng = np.random.default_rng(10)
    got = []
    for _ in range(4000):
        sampler.log_scale_prior_walk(s, d, "noise", rng)
        got.append(s.log_scale["noise"][0])
    grid = np.linspace(-6, 3, 2000)
    logs = np.array([design.beta_prior_log_density(s.noise_beta, 4, d.means["noise"], d.variances["noise"], [g]) for g in grid])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    mean = (grid * p).sum()
    assert np.mean(got[200:]) == pytest.approx(mean, abs=0.25)


def _cells(d):
    """The observations of d, summed up by location and row of the noise design."""
    key, at = np.unique(np.column_stack([d.loc, d.x_noise]), axis=0, return_inverse=True)
    at = at.ravel()
    n = len(key)
    xx = np.zeros((n, d.x.shape[1], d.x.shape[1]))
    np.add.at(xx, at, d.x[:, :, None] * d.x[:, None, :])
    xz = np.zeros((n, d.x.shape[1]))
    np.add.at(xz, at, d.x * d.z[:, None])
    return sampler.Cells(
        d.xy, d.parents, key[:, 0].astype(int), np.empty(0), np.empty((0, d.x.shape[1])), d.x_locs, d.loc_columns, d.x_range, d.x_scale, key[:, 1:], d.smoothness,
        d.n_pp, d.means, d.variances, d.bounds, n=np.bincount(at, minlength=n).astype(float), zz=np.bincount(at, d.z**2, n), xz=xz, xx=xx,
    )


def test_cells_say_the_same_as_their_observations():
    d = _data(40, 5, k=6)
    d.x_noise = np.column_stack([d.x_noise, np.arange(len(d.loc)) % 2])
    c = _cells(d)
    assert len(c.n) == 80
    s = sampler.initial_state(d, 1, 1)
    for a, b in zip(d.least_squares(), c.least_squares()):
        assert np.allclose(a, b)
    assert np.allclose(d.noise_gram(), c.noise_gram())
    for a, b in zip((*d.stats(s), *d.beta_system(s), *d.noise_terms(s, s.noise_beta + 0.2)), (*c.stats(s), *c.beta_system(s), *c.noise_terms(s, s.noise_beta + 0.2))):
        assert np.allclose(a, b)
    a, b = (sampler.run_chain(x, 1, 4, seed=5)[1] for x in (d, c))
    assert [r[:5] for r in a] == [r[:5] for r in b] and np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-6, atol=1e-8)


def test_prediction_against_the_joint_precision():
    """Conditional means of many new locations that hang on one another: -Q_nn^-1 Q_no w, of the joint factor."""
    d = _data(90, 6)
    n = 60
    parents = d.parents[n:, 1:]
    f = d.x_range @ canonical_range(np.array([[-1.0], [0.4]]))
    sd = np.exp(0.3 * d.xy[:, 0])
    w = np.sin(4 * d.xy[:n, 1])
    got = sampler.predict_field(d.xy[:n], parents, d.xy[n:], f[:n], f[n:], sd[:n], sd[n:], w, 1.5)
    l = sampler.build_factor(d, np.array([[-1.0], [0.4]])).dense()[n:]
    a, b = l[:, n:], l[:, :n]
    assert np.allclose(got, sd[n:] * np.linalg.solve(a, -b @ (w / sd[:n])))
    rng = np.random.default_rng(3)
    draws = np.array([sampler.predict_field(d.xy[:n], parents, d.xy[n:], f[:n], f[n:], sd[:n], sd[n:], w, 1.5, rng) for _ in range(3000)])
    cov = np.linalg.inv(a.T @ a) * np.outer(sd[n:], sd[n:])
    assert np.allclose(draws.mean(0), got, atol=5 * np.sqrt(np.diag(cov).max() / 3000))
    assert np.allclose(np.cov(draws.T), cov, atol=0.1 * np.diag(cov).max())
