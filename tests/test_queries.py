"""Queries that SQL can't express, on whole tables, against dense algebra and plain loops."""

from copy import deepcopy

import numpy as np
import pandas as pd
import pytest

from terrafield.functions.kernels import canonical_range, covariance
from terrafield.operators import basis, diagnostics, sampler, spatial
from terrafield.operators.noise import _xxhash, normals
from terrafield.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = {"field_draw", "field_draw_cholesky", "colour_sweep", "range_step", "table_chain", "ess", "kmeans_partition", "vecchia_full", "vecchia_anisotropic", "gibbs_field", "predict_field", "model_estimates", "distributed_chain"}


def _run(spark, name):
    return catalogue.queries()[name](spark, SF)


def test_every_query_has_sql_or_a_test_here():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == NAMES


def test_ess(spark):
    got = {r.i: r.ess for r in _run(spark, "ess").collect()}
    rows = catalogue.records(spark, SF).toPandas().sort_values("iteration")
    want = {}
    for (_, i), g in rows.groupby(["chain", "i"]):
        x = g[g.iteration > g.iteration.max() * 0.5].value.to_numpy()[1:]
        n = len(x)
        x = x - x.mean()
        c = np.array([(x[k:] * x[: n - k]).sum() / n for k in range(n)])
        best = None
        for p in range(min(n - 1, int(10 * np.log10(n))) + 1):
            t = np.array([[c[abs(a - b)] for b in range(p)] for a in range(p)]).reshape(p, p)
            phi = np.linalg.solve(t, c[1 : p + 1]) if p else np.zeros(0)
            var = c[0] - phi @ c[1 : p + 1]
            aic = n * np.log(var) + 2 * p
            if best is None or aic < best[0]:
                best = aic, var * n / (n - p - 1) / (1 - phi.sum()) ** 2
        want[i] = want.get(i, 0) + n * x.var(ddof=1) / best[1]
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)
    short = {r.i: r.ess for r in diagnostics.ess(catalogue.records(spark, SF), by=["i"], block=7).collect()}  # blocks shorter than the lags
    assert set(short) == set(want) and all(short[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_kmeans_partition(spark):
    t = _run(spark, "kmeans_partition").toPandas().sort_values("id")
    p = catalogue.locs(spark, SF).toPandas().sort_values("id")
    xy = p[["x", "y"]].to_numpy()
    assert t["id"].tolist() == p["id"].tolist()
    for c in [c for c in t.columns if c.endswith("_clust")]:
        k, own = int(c.split("_")[0]), t[c].to_numpy()
        assert set(own) == set(range(1, k + 1))
        centres = np.array([xy[own == j + 1].mean(0) for j in range(k)])
        d = ((xy[:, None] - centres) ** 2).sum(-1)
        assert (d.argmin(1) + 1 == own).mean() > 0.98  # a fixed point, to the tolerance of the fit
        rng, least = np.random.default_rng(0), np.inf
        for _ in range(20):
            m = xy[rng.permutation(len(xy))[:k]]
            for _ in range(50):
                at = ((xy[:, None] - m) ** 2).sum(-1).argmin(1)
                m = np.array([xy[at == j].mean(0) if (at == j).any() else m[j] for j in range(k)])
            least = min(least, ((xy[:, None] - m) ** 2).sum(-1).min(1).sum())
        assert d.min(1).sum() <= 1.1 * least


def _dense_rows(xy, lr, m, smoothness=1.5):
    """Factor rows by loops: neighbours are the m nearest of smaller index, ties by index."""
    out = []
    for i in range(len(xy)):
        d = ((xy[:i] - xy[i]) ** 2).sum(1)
        p = np.lexsort((np.arange(i), d))[:m]
        if not len(p):
            out.append(np.ones(1))
            continue
        s = covariance(xy[p][:, None] - xy[p][None], lr[p][:, None], lr[p][None], smoothness)
        np.fill_diagonal(s, 1.00001)
        c = covariance(xy[p] - xy[i], lr[p], np.broadcast_to(lr[i], lr[p].shape), smoothness)
        w = np.linalg.solve(s, c)
        g = (1.00001 - w @ c) ** -0.5
        out.append(np.concatenate([[g], -g * w]))
    return out


@pytest.mark.parametrize("name, beta, m", [("vecchia_full", [[-1.0], [0.3]], 10), ("vecchia_anisotropic", [[-1.0, 0.1, 0.0], [0.3, 0.0, 0.2]], 5)])
def test_factors(spark, name, beta, m):
    p = catalogue.locs(spark, SF).orderBy("id").toPandas()
    xy = p[["x", "y"]].to_numpy()
    lr = np.column_stack([np.ones(len(xy)), xy[:, 0]]) @ canonical_range(np.array(beta))
    rows = _run(spark, name).orderBy("child").collect()
    want = _dense_rows(xy, lr, m)
    assert [r.child for r in rows] == p["id"].tolist()
    for r, w in zip(rows, want):
        assert np.allclose(r.coef, w, rtol=1e-4, atol=1e-4 * np.abs(w).max())
        if name == "vecchia_full":
            assert r.n_deriv == len(w) ** 2


def test_gibbs_field(spark):
    """Chains in tasks say what they say in this process; that their kernels are right is tested in test_sampler."""
    got = sorted(map(tuple, _run(spark, "gibbs_field").collect()))
    d = catalogue._data(spark, SF)
    want = sorted(row for c in (1, 2) for row in sampler.run_chain(d, c, 10, with_field=False)[1])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-6)


def test_gibbs_field_leaves_locations_on_the_cluster(spark, monkeypatch):
    """No array of the locations' size passes the driver: nothing is collected to pandas or sent from lists."""

    def refused(*args, **how):
        raise AssertionError("the locations came to the driver")

    monkeypatch.setattr(type(spark.range(0)), "toPandas", refused)
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    got = _run(spark, "gibbs_field")
    assert got.count() == 2 * 10 * 5
    monkeypatch.undo()
    table = catalogue._places(spark, SF)
    mine, whole = catalogue._arrays(table.orderBy("id").toArrow()), catalogue._data(spark, SF)
    assert np.array_equal(mine.parents, whole.parents) and np.array_equal(mine.xy, whole.xy) and np.array_equal(mine.x, whole.x) and np.array_equal(mine.z, whole.z)


def test_predict_field(spark):
    got = {r.id: r.value for r in _run(spark, "predict_field").collect()}
    d = catalogue._data(spark, SF)
    n = d.n_observed
    l = sampler.build_factor(d, np.array([[-1.0]])).dense()[n:]
    want = np.linalg.solve(l[:, n:], -l[:, :n] @ d.z[:n])
    assert sorted(got) == list(range(n, len(d.xy)))
    assert np.allclose([got[i] for i in sorted(got)], want, rtol=1e-6, atol=1e-8)


def _lattice(spark):
    """The lattice's observations as plain arrays: nothing is summed up or aggregated."""
    index = catalogue._lattice_index(spark, SF)
    t = index.obs.orderBy("obs_id").toPandas()
    xy = np.array(index.locs.orderBy("id").select("x", "y").toPandas(), float)
    one = np.ones((len(xy), 1))
    x = np.column_stack([np.ones(len(t)), t["cov"]])
    return index, xy, one, x, t


def test_distributed_chain(spark):
    got = sorted(map(tuple, _run(spark, "distributed_chain").collect()))
    index, xy, one, x, t = _lattice(spark)
    d = sampler.Data(xy, index.parents(), t["loc_id"].to_numpy() - 1, t["z"].to_numpy(), x, one, [0], one, one, np.ones((len(t), 1)))
    want = sorted(sampler.run_chain(d, 1, 3, with_field=False)[1])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-4, atol=1e-6)


def test_model_estimates(spark):
    got = {(r.param, r.i, r.j): r for r in _run(spark, "model_estimates").collect()}
    index, xy, one, x, t = _lattice(spark)
    z = t["z"].to_numpy()
    resid = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    near = np.median(np.sqrt(d2.min(1)))
    np.fill_diagonal(d2, 0)
    low, high = np.log(0.01 * resid.var(ddof=1)), np.log(0.99 * resid.var(ddof=1))
    a, b = -0.5 * np.log(12) + np.log(3 * near), -0.5 * np.log(12) + np.log(np.sqrt(d2.max()) / 8)
    means = {"noise": (low + high) / 2, "scale": (low + high) / 2, "range": (a + b) / 2}
    variances = {"noise": ((high - low) / 8) ** 2, "scale": ((high - low) / 8) ** 2, "range": ((b - a) / 8) ** 2}
    per = t.groupby("loc_id")["cov"].nunique()
    assert (per > 1).any()  # so the covariate varies within locations
    d = sampler.Data(xy, index.parents(), t["loc_id"].to_numpy() - 1, z, x, one, [0], one, one, np.ones((len(t), 1)), means=means, variances=variances)
    values = {}
    for c in (1, 2):
        for _, it, param, i, j, v in sampler.run_chain(d, c, 6)[1]:
            if it > 3:
                values.setdefault((param, i, j), []).append(v)
    assert set(values) == set(got)
    for key, v in values.items():
        r = got[key]
        want = [np.mean(v), *np.quantile(v, (0.025, 0.5, 0.975)), np.std(v, ddof=1)]
        assert np.allclose([r.mean, r.q0_025, r.median, r.q0_975, r.sd], want, rtol=1e-3, atol=1e-4)


def test_orders_are_those_of_loops(spark):
    """The order of a fit's locations: a random one, then max-min from the point nearest the centroid; the rest stay as they were."""
    p = catalogue.locs(spark, SF).select("id", "x", "y")
    every = spatial.ordered_locations(p, "id", 3, most=50).orderBy("rank").toPandas()
    first = catalogue.rel.random_order(p, "id", 3).orderBy("rank").toPandas()
    assert first["rank"].tolist() == list(range(1, len(first) + 1)) and first["id"].tolist() != sorted(first["id"])
    assert every["id"].tolist()[50:] == first["id"].tolist()[50:] and every["rank"].tolist() == first["rank"].tolist()
    xy = every[["x", "y"]].to_numpy()[:50]
    for k in range(1, 50):
        far = ((xy[k:, None] - xy[None, :k]) ** 2).sum(-1).min(1)
        assert far[0] == pytest.approx(far.max())


def test_maxmin_order_covers_all_points(spark):
    """Beyond a fixed number, too: rounds of few candidates give the order of the plain loop, with places that coincide and an outlier."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(size=(700, 2)), rng.normal(size=(300, 2)) * 0.01, [[90.0, 3.0]]])
    xy = np.concatenate([xy, xy[:40]])
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "rank long, x double, y double")
    want = spatial.maxmin_order(xy)
    for batch in (60, 5000):
        got = spatial.maxmin_places(p, batch).toPandas().sort_values("new")
        assert got["rank"].tolist() == want.tolist() and got["new"].tolist() == list(range(1, len(xy) + 1))
    every = spatial.ordered_locations(p.withColumnRenamed("rank", "id"), "id", most=None).toPandas().sort_values("rank")
    far = [((v - every[["x", "y"]].to_numpy()[:k]) ** 2).sum(1).min() for k, v in enumerate(every[["x", "y"]].to_numpy()) if k > 1]
    assert all(a >= b - 1e-12 for a, b in zip(far, far[1:]))


def test_greatest_distance_is_that_of_all_points(spark):
    """The farthest pair lies beyond the first 10,000 rows; circles, lines and single places, too."""
    rng = np.random.default_rng(7)
    turn = rng.random(400) * 2 * np.pi
    x = rng.normal(size=12_000)
    sets = [np.concatenate([rng.normal(size=(11_000, 2)), [[60.0, 1.0], [-70.0, 4.0]]]), np.column_stack([np.cos(turn), np.sin(turn)]), np.column_stack([x, 2 * x]), np.ones((200, 2)), rng.normal(size=(1, 2))]
    for xy in sets:
        p = spark.createDataFrame(pd.DataFrame(xy, columns=["x", "y"]))
        for corners in (10_000, 0):
            assert basis.diameter(p, corners) == pytest.approx(basis.max_distance(xy), rel=1e-12, abs=0)


class _SameNoise(sampler.Data):
    """Arrays whose field is drawn from the noise that the tables use."""

    def prior_field(self, s, rng):
        return s.sd(self) * s.factor.solve(normals(self.ids, int(rng.integers(1 << 60))))

    def posterior_field(self, s, rng):
        seed, sd = int(rng.integers(1 << 60)), s.sd(self)
        s0, s1, _ = self.stats(s)
        l = s.factor.dense()
        noise = l.T @ normals(self.ids, 2 * seed) / sd + np.sqrt(s0) * normals(self.ids, 2 * seed + 1)
        return np.linalg.solve((l.T @ l) / np.outer(sd, sd) + np.diag(s0), s1 + noise)


@pytest.fixture(scope="module")
def field_arrays(spark):
    """The model of catalogue.field_tables as arrays, and its starting state."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").collect()
    v = np.array([r.embedding[:4] for r in e], float)
    xy, n = v[:, :2], len(v)
    parents = np.full((n, 6), -1, np.int64)
    parents[:, 0] = np.arange(n)
    for i in range(1, n):
        near = np.lexsort((np.arange(i), ((xy[:i] - xy[i]) ** 2).sum(1)))[:5]
        parents[i, 1 : 1 + len(near)] = near
    one = np.ones((n, 1))
    x = np.column_stack([one, v[:, 3]])
    d = _SameNoise(xy, parents, np.arange(n), v[:, 2], x, x, [0, 1], np.column_stack([one, xy[:, 0]]), one, one, means={"range": -2.0, "scale": -4.0, "noise": -5.0})
    d.ids = np.array([r.vec_id for r in e])
    s = sampler.State(np.array([0.0, 0.0]), np.array([[-2.0], [0.0]]), np.array([[-4.0]]), np.array([[-5.0]]), d.z.copy())
    s.factor = d.factor(s.range_beta)
    l, sd = s.factor.dense(), s.sd(d)
    s0, s1, _ = d.stats(s)
    return d, s, (l.T @ l) / np.outer(sd, sd) + np.diag(s0), s1


def _by_id(rows, ids):
    got = {r.id: r.value for r in rows}
    assert sorted(got) == sorted(ids.tolist())
    return np.array([got[i] for i in ids])


def test_field_draws(spark, field_arrays):
    d, s, q, s1 = field_arrays
    want = d.posterior_field(s, np.random.default_rng(1))
    assert np.allclose(_by_id(_run(spark, "field_draw").collect(), d.ids), want, rtol=1e-4, atol=1e-5)
    # L'(x - mean) is the noise, in whatever order: so are the squares' sums
    off = _by_id(_run(spark, "field_draw_cholesky").collect(), d.ids) - np.linalg.solve(q, s1)
    assert off @ q @ off == pytest.approx((normals(d.ids, 3) ** 2).sum(), rel=1e-6)


def test_colour_sweep(spark, field_arrays):
    d, s, q, s1 = field_arrays
    hashes = _xxhash(d.ids.view(np.uint64), np.array([42], np.uint64)).view(np.int64)
    colour = {}
    for i in np.lexsort((d.ids, hashes)):
        used = {colour.get(j) for j in np.nonzero(q[i])[0]}
        colour[i] = next(c for c in range(1, len(d.ids)) if c not in used)
    c, w, z = np.array([colour[i] for i in range(len(d.ids))]), s.field.copy(), normals(d.ids, 3)
    for k in range(1, c.max() + 1):
        rows = np.nonzero(c == k)[0]
        w[rows] += (s1[rows] - q[rows] @ w) / np.diag(q)[rows] + z[rows] / np.sqrt(np.diag(q)[rows])
    assert np.allclose(_by_id(_run(spark, "colour_sweep").collect(), d.ids), w, rtol=1e-6, atol=1e-8)


def test_range_step(spark, field_arrays):
    d, s, _, _ = field_arrays
    a = deepcopy(s)
    sampler.range_hmc(a, d, 1, np.random.default_rng(2))
    rows = _run(spark, "range_step").collect()
    got = {(r.param, r.id): r.value for r in rows if r.param != "field"}
    assert np.allclose([got["range_beta", 0], got["range_beta", 1]], a.range_beta[:, 0], rtol=1e-6)
    assert all(got[f"log_step_{k}", 0] == pytest.approx(a.steps[k][0]) for k in ("range_beta_ancillary", "range_beta_sufficient"))
    assert np.allclose(_by_id([r for r in rows if r.param == "field"], d.ids), a.field, rtol=1e-5, atol=1e-7)


def test_table_chain(spark, field_arrays):
    d = field_arrays[0]
    want = {r[2:5]: r[5] for r in sampler.run_chain(d, 1, 1)[1]}
    rows = _run(spark, "table_chain").collect()
    at = {int(i): k for k, i in enumerate(d.ids)}
    got = {(r.param, at[r.i - 1] + 1 if r.param == "field" else r.i, r.j): r.value for r in rows}
    assert set(got) == set(want) and len(rows) == len(want)
    assert all(got[k] == pytest.approx(v, rel=1e-3, abs=1e-4) for k, v in want.items())
