"""Fields of any number of locations: sparse factors, solves and draws on tables against dense algebra."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafield.functions.kernels import canonical_range
from terrafield.operators import chromatic, cholesky, fieldtables, noise, regions, sampler, spatial, triangular


def _data(n, m=5, seed=0):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2))
    parents = np.full((n, m + 1), -1, np.int64)
    parents[:, 0] = np.arange(n)
    for i in range(1, n):
        near = np.argsort(((xy[:i] - xy[i]) ** 2).sum(1), kind="stable")[:m]
        parents[i, 1 : len(near) + 1] = near
    one = np.ones((n, 1))
    x = np.column_stack([one, rng.normal(size=n)])
    return sampler.Data(xy, parents, np.arange(n), rng.normal(size=n), x, one, [0], np.column_stack([one, xy[:, 0]]), one, one)


def _precision(d, beta=((-1.5,), (0.3,)), seed=1):
    rng = np.random.default_rng(seed)
    l = sampler.build_factor(d, np.array(beta)).dense()
    return l.T @ l + np.diag(rng.uniform(0.5, 2, len(l))), rng.normal(size=len(l))


def _tables(spark, d, q, rhs):
    a, b = np.nonzero(q)
    ids = np.arange(len(rhs))
    return (
        spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "value": q[a, b]})),
        spark.createDataFrame(pd.DataFrame({"id": ids, "x": d.xy[:, 0], "y": d.xy[:, 1]})),
        spark.createDataFrame(pd.DataFrame({"id": ids, "value": rhs})),
    )


def _values(df):
    t = df.toPandas().sort_values("id")
    return t["value"].to_numpy()


def test_normals_are_the_same_as_column_and_array(spark):
    got = spark.range(-500, 20_000).select("id", noise.normal("id", 9).alias("v")).toPandas()
    assert np.allclose(got["v"], noise.normals(got["id"].to_numpy(), 9), rtol=1e-12, atol=1e-12)
    assert abs(got["v"].mean()) < 0.03 and abs(got["v"].std() - 1) < 0.03
    assert not np.allclose(noise.normals(np.arange(50), 1), noise.normals(np.arange(50), 2))


@pytest.mark.parametrize("n, leaf", [(2000, 120), (40, 500), (1, 10)])
def test_sparse_cholesky_equals_dense_algebra(spark, n, leaf):
    d = _data(n)
    q, rhs = _precision(d)
    c = cholesky.Cholesky.of(*_tables(spark, d, q, rhs), leaf=leaf)
    assert c.variables == n and c.log_det == pytest.approx(np.linalg.slogdet(q)[1], rel=1e-10)
    assert np.allclose(_values(c.solve()), np.linalg.solve(q, rhs), rtol=1e-8, atol=1e-10)
    # the factor in its order of elimination: from the deepest nodes up
    rows = [r for part in reversed(c.nodes) for r in part.collect()]
    order = [i for r in rows for i in r.own]
    at = {v: k for k, v in enumerate(order)}
    l = np.zeros((n, n))
    for r in rows:
        own, far = [at[i] for i in r.own], [at[i] for i in r.boundary]
        l[np.ix_(own, own)] = cholesky._unpacked(r.l11, len(own))
        l[np.ix_(far, own)] = np.reshape(r.l21, (len(far), len(own)))
    assert sorted(order) == list(range(n)) and np.allclose(l @ l.T, q[np.ix_(order, order)], atol=1e-9)
    want = np.linalg.solve(q, rhs)[order] + np.linalg.solve(l.T, noise.normals(np.array(order), 5))
    assert np.allclose(_values(c.solve(seed=5))[order], want, rtol=1e-7, atol=1e-9)
    if n == 2000:  # the order keeps most of the triangle empty
        assert len(rows) > 20 and c.nonzeros < 0.4 * n * (n + 1) / 2 and c.fill == c.nonzeros / np.count_nonzero(np.tril(q))


def test_fronts_are_bounded_and_halves_meet_in_separators_only(spark):
    d = _data(600)
    q, rhs = _precision(d)
    precision, locs, _ = _tables(spark, d, q, rhs)
    places, depth = cholesky.dissect(locs, 50)
    sizes = [r["count"] for r in places.groupBy("leaf").count().collect()]
    assert len(sizes) == 1 << depth and max(sizes) <= 2 * 600 / len(sizes)
    node = {r.id: r.node for r in cholesky.separators(precision, places, depth).collect()}
    for a, b in zip(*np.nonzero(q)):
        high, low = sorted((node[a], node[b]))
        assert low >> (low.bit_length() - high.bit_length()) == high  # one lies on the other's way to the root
    with pytest.raises(Exception, match="conjugate gradients"):
        cholesky.Cholesky.of(precision, locs, leaf=50, most=20)
    with pytest.raises(Exception, match="positive definite"):
        cholesky.Cholesky.of(precision.withColumn("value", F.when(F.col("a") == F.col("b"), -1.0).otherwise(F.col("value"))), locs, leaf=50)


def _vecchia(spark, f):
    ok = f.parents >= 0
    rows = [(i, f.parents[i][ok[i]].tolist(), f.coef[i][ok[i]].tolist()) for i in range(len(f.coef))]
    return spark.createDataFrame(rows, "child long, parents array<long>, coef array<double>")


def _edges(vecchia):
    return vecchia.select(F.col("child").alias("row"), F.explode("parents").alias("col"))


@pytest.mark.parametrize("most", [100_000, 60])
def test_solves_by_bands_equal_those_of_one_process(spark, most):
    d = _data(400)
    f = sampler.build_factor(d, np.array([[-1.5], [0.3]]))
    v = _vecchia(spark, f)
    level = triangular.levels(_edges(v), v.select(F.col("child").alias("id")), most)
    got = level.toPandas().sort_values("id")["level"].to_numpy()
    assert all((got[rows] == k).all() for k, rows in enumerate(f.levels)) and len(f.levels) == got.max() + 1
    t = triangular.Triangular.of(v, level, most)
    assert (len(t.spans) == 1) == (most > 400)
    z = np.random.default_rng(3).normal(size=400)
    zs = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "value": z}))
    assert np.allclose(_values(t.solve(zs)), f.solve(z), rtol=1e-10)
    assert np.allclose(_values(t.solve(zs, backward=True)), f.transpose_solve(z), rtol=1e-10)
    t.close()


def test_levels_of_few_rows_share_bands_and_large_ones_are_joined(spark):
    level = spark.createDataFrame([(i, k) for k, n in enumerate((3, 4, 50, 2, 9, 40)) for i in range(100 * k, 100 * k + n)], "id long, level int")
    assert triangular.bands(level, 10) == [(0, 1, True), (2, 2, False), (3, 3, True), (4, 4, True), (5, 5, False)]
    for most in (0, 100):
        with pytest.raises(Exception, match="cycle"):
            triangular.levels(spark.createDataFrame([(1, 2), (2, 1)], "row long, col long"), spark.range(1, 3), most)
    assert triangular.levels(spark.createDataFrame([], "row long, col long"), spark.range(0)).count() == 0


def _counted(monkeypatch, *modules):
    """A list that grows with every table that the modules write."""
    seen = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df, cut=m.cut: seen.append(1) or cut(df))
    return seen


def test_levels_of_deep_graphs_take_few_rounds(spark, monkeypatch):
    n, rng = 300, np.random.default_rng(5)
    every = [(i, int(j)) for i in range(1, n) for j in {i - 1 if i % 3 else 0, *rng.integers(0, i, 2)}]
    want = [0] * n
    for i, j in every:
        want[i] = max(want[i], want[j] + 1)
    seen = _counted(monkeypatch, triangular)
    got = triangular.levels(spark.createDataFrame([(7 * i, 7 * j) for i, j in every], "row long, col long"), spark.range(n).select((F.col("id") * 7).alias("id")), 50)
    assert [r.level for r in got.orderBy("id").collect()] == want
    chain = triangular.levels(spark.range(1, n).select(F.col("id").alias("row"), (F.col("id") - 1).alias("col")), spark.range(n), 50)
    assert [r.level for r in chain.orderBy("id").collect()] == list(range(n))
    assert len(seen) <= 2 * (3 + 2 * n // 50)
    turned = triangular.levels(spark.range(1, 40).select((F.col("id") - 1).alias("row"), F.col("id").alias("col")), spark.range(40), 30)  # parents have greater ids
    assert [r.level for r in turned.orderBy("id").collect()] == list(range(39, -1, -1))


@pytest.fixture(scope="module")
def model(spark):
    """One model as arrays and as tables, with a state of each that say the same."""
    d = _data(120, seed=4)
    rng = np.random.default_rng(2)
    d.loc = rng.integers(0, 110, 400)  # some locations have no observation
    d.x = np.column_stack([np.ones(400), rng.normal(size=400)])
    d.z, d.x_noise = rng.normal(size=400) + d.x @ [0.5, 1.0], np.column_stack([np.ones(400), d.x[:, 1] ** 2])
    d.x_scale = np.column_stack([np.ones(120), d.xy[:, 1]])
    s = sampler.initial_state(d, 3, 1)
    s.range_beta, s.scale_beta, s.noise_beta = np.array([[-1.5], [0.3]]), np.array([[0.2], [-0.1]]), np.array([[-0.2], [0.05]])
    s.factor = d.factor(s.range_beta)
    sites = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "x": d.xy[:, 0], "y": d.xy[:, 1], "one": 1.0, "rx": d.x_range[:, 1], "sy": d.x_scale[:, 1]}))
    child, k = np.nonzero(d.parents[:, 1:] >= 0)
    nn = spark.createDataFrame(pd.DataFrame({"child": child, "k": k + 1, "parent": d.parents[child, k + 1]}))
    obs = spark.createDataFrame(pd.DataFrame({"loc": d.loc, "z": d.z, "x0": d.x[:, 0], "x1": d.x[:, 1], "n1": d.x_noise[:, 1]}))
    t = fieldtables.FieldTables.build(obs, sites, nn, ["x0", "x1"], ["x0", "n1"], ["one", "rx"], ["one", "sy"], {"one": 0}, band_rows=50, means=d.means, variances=d.variances)
    return d, t, s


def _as_table(spark, t, s):
    from copy import deepcopy

    out = deepcopy(s)
    out.factor = t.factor(s.range_beta)
    out.field = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(s.field)), "value": s.field}))
    return out


def test_table_products_and_draws_equal_dense_algebra(spark, model):
    d, t, s = model
    f = _as_table(spark, t, s)
    v = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "value": s.field}))
    assert np.allclose(_values(f.factor.times(v)), s.factor.times(s.field)) and np.allclose(_values(f.factor.transpose_times(v)), s.factor.transpose_times(s.field))
    l, sd = s.factor.dense(), s.sd(d)
    s0, s1, _ = d.stats(s)
    q = (l.T @ l) / np.outer(sd, sd) + np.diag(s0)
    ids = np.arange(120)
    seed = 77
    b = s1 + l.T @ noise.normals(ids, 2 * seed) / sd + np.sqrt(s0) * noise.normals(ids, 2 * seed + 1)
    at = spark.createDataFrame(pd.DataFrame({"id": ids, "sd": sd, "precision": s0}))
    got = fieldtables.draw_field(f.factor, at, spark.createDataFrame(pd.DataFrame({"id": ids, "value": s1})), fieldtables.blocks_of(t.sites, 20), seed)
    assert np.allclose(_values(got), np.linalg.solve(q, b), rtol=1e-5, atol=1e-6)


def test_gradients_start_at_the_sparse_factors_solution(spark, model):
    """So no step is needed, however dense the places; with fronts too large, steps lead there."""
    d, t, s = model
    f = _as_table(spark, t, s)
    n, sd, l = len(d.xy), s.sd(d), s.factor.dense()
    q, b = l.T @ l / np.outer(sd, sd) + np.diag(np.full(n, 2.0)), np.cos(np.arange(n))
    at = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "sd": sd, "precision": 2.0}))
    right = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "value": b}))
    for how in ({"most": 0}, {"front": 1}):
        got = fieldtables.conjugate_gradient(f.factor, at, right, fieldtables.blocks_of(t.sites, 20), locs=t.sites, **how)
        assert np.allclose(_values(got), np.linalg.solve(q, b), rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("ancillary", [True, False])
def test_table_potentials_equal_those_of_arrays(spark, model, ancillary):
    d, t, s = model
    f = _as_table(spark, t, s)
    beta = s.range_beta + [[0.1], [-0.2]]
    want, got = d.range_potential(s, beta, ancillary), t.range_potential(f, beta, ancillary)
    assert got[0] == pytest.approx(want[0], rel=1e-9) and np.allclose(got[1], want[1], rtol=1e-6, atol=1e-7)
    if ancillary:
        assert np.allclose(_values(got[2][1]), want[2][1], rtol=1e-8, atol=1e-9)
    beta = s.scale_beta + [[0.3], [0.1]]
    want, got = d.scale_potential(s, beta, ancillary), t.scale_potential(f, beta, ancillary)
    assert got[0] == pytest.approx(want[0], rel=1e-9) and np.allclose(got[1], want[1], rtol=1e-8, atol=1e-9)


def test_kernels_on_tables_make_the_same_chain(spark, model):
    """Regression, interweaving, range, noise and scale draw the same numbers, so both chains are one."""
    from copy import deepcopy

    d, t, s = model
    a, b = deepcopy(s), _as_table(spark, t, s)
    r1, r2 = np.random.default_rng(8), np.random.default_rng(8)
    for kernel in (sampler.beta_centred, sampler.beta_interwoven):
        kernel(a, d, r1), kernel(b, t, r2)
        assert np.allclose(a.beta, b.beta, rtol=1e-8)
    moved = 0
    for kernel in (sampler.range_hmc, sampler.noise_hmc, sampler.scale_hmc):
        old = (a.range_beta, a.noise_beta, a.scale_beta)
        kernel(a, d, 1, r1), kernel(b, t, 1, r2)
        moved += any(x is not y for x, y in zip(old, (a.range_beta, a.noise_beta, a.scale_beta)))
        for name in ("range_beta", "noise_beta", "scale_beta"):
            assert np.allclose(getattr(a, name), getattr(b, name), rtol=1e-6)
    assert moved and a.steps == b.steps and np.allclose(_values(b.field), a.field, rtol=1e-6, atol=1e-8)


def test_colours_and_sweeps(spark):
    d = _data(90, m=3, seed=7)
    q, rhs = _precision(d)
    precision, locs, right = _tables(spark, d, q, rhs)
    ids = locs.select("id")
    colours = chromatic.colouring(precision.where("a < b").select("a", "b"), ids)
    c = colours.toPandas().sort_values("id")["colour"].to_numpy()
    by_rounds = chromatic.colouring(precision.where("a < b").select("a", "b"), ids, most=40)  # rounds first, then a task
    assert by_rounds.toPandas().sort_values("id")["colour"].tolist() == c.tolist()
    a, b = np.nonzero(np.triu(q, 1))
    assert len(c) == 90 and (c[a] != c[b]).all() and c.min() == 1 and c.max() <= 1 + np.count_nonzero(q, axis=1).max()
    update = chromatic.ColourUpdate(precision, colours)
    w0 = np.random.default_rng(1).normal(size=90)
    got = _values(update.sweep(spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "value": w0})), right, 6))
    update.close()

    def sweep(w, z, rhs=rhs):
        w = w.copy()
        for k in range(1, c.max() + 1):
            rows = np.nonzero(c == k)[0]
            w[rows] = (rhs[rows] - q[rows] @ w + np.diag(q)[rows] * w[rows]) / np.diag(q)[rows] + z[rows] / np.sqrt(np.diag(q)[rows])
        return w

    assert np.allclose(got, sweep(w0, noise.normals(np.arange(90), 6)), rtol=1e-9, atol=1e-10)
    # a sweep is w -> a w + b + c z: the field's own mean and covariance are what it leaves as they are
    mean, cov, zero = np.linalg.solve(q, rhs), np.linalg.inv(q), np.zeros(90)
    of_w = np.column_stack([sweep(e, zero, zero) for e in np.eye(90)])
    of_z = np.column_stack([sweep(zero, e, zero) for e in np.eye(90)])
    assert np.allclose(sweep(mean, zero), mean) and np.allclose(of_w @ cov @ of_w.T + of_z @ of_z.T, cov) and np.abs(np.linalg.eigvals(of_w)).max() < 1


@pytest.mark.parametrize("region", [40, 10_000])
def test_prediction_by_regions_equals_one_process(spark, region):
    d = _data(300, seed=9)
    n = 120
    ids = np.arange(300)
    design = np.column_stack([np.ones(300), d.xy[:, 0]])
    rows = [(int(i), float(x), float(y), design[i].tolist(), [1.0]) for i, (x, y) in zip(ids, d.xy)]
    every = spark.createDataFrame(rows, "id long, x double, y double, xr array<double>, xs array<double>")
    child, k = np.nonzero(d.parents[n:, 1:] >= 0)
    nn = spark.createDataFrame(pd.DataFrame({"child": child + n, "parent": d.parents[n:][child, k + 1]}))
    rng = np.random.default_rng(5)
    fields = rng.normal(size=(3, n))
    params = [(np.array([[-1.5 + 0.2 * s], [0.3]]), np.array([[0.1 * s]]), 40 + s) for s in range(3)]
    field = spark.createDataFrame([(s, i, float(v)) for s in range(3) for i, v in enumerate(fields[s])], "sample int, id long, value double")
    new, seen = every.where(F.col("id") >= n), every.where(F.col("id") < n)
    for noisy in (False, True):
        got = {r.id: r["values"] for r in regions.predict(new, seen, nn, field, params, noise=noisy, region=region).collect()}
        assert sorted(got) == list(range(n, 300))
        for s, (rb, sb, seed) in enumerate(params):
            f = design @ canonical_range(rb)
            l = np.zeros((300, 300))
            coef = sampler.prediction_rows(d.xy, f, d.parents, 1.5)
            l[np.repeat(ids, 6)[(d.parents >= 0).ravel()], d.parents[d.parents >= 0]] = coef[d.parents >= 0]
            sd = np.exp(0.5 * sb[0, 0])
            z = noise.normals(ids[n:], seed) if noisy else 0.0
            want = sd * np.linalg.solve(l[n:, n:], z - l[n:, :n] @ (fields[s] / sd))
            assert np.allclose([got[i][s] for i in range(n, 300)], want, rtol=1e-8, atol=1e-10)


@pytest.mark.parametrize("most", [10_000, 5])
def test_transfers_end_below_lloyds_rounds(spark, most):
    rng = np.random.default_rng(11)
    xy, k = rng.random((400, 2)) ** 2, 7
    c = xy[rng.permutation(400)[:k]].copy()
    for _ in range(100):  # Lloyd's rounds, to their end
        own = ((xy[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([xy[own == j].mean(0) for j in range(k)])

    def within(own):
        return sum(((xy[own == j] - xy[own == j].mean(0)) ** 2).sum() for j in range(k) if (own == j).any())

    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "x": xy[:, 0], "y": xy[:, 1], "own": own}))
    for first in (own, rng.integers(0, k, 400)):
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "x": xy[:, 0], "y": xy[:, 1], "own": first}))
        got = spatial.transfers(df, k, most=most if first is own else 10_000).toPandas().sort_values("id")["own"].to_numpy()
        assert within(got) <= within(first) + 1e-12 and len(set(got)) == k
        best = within(got)
        for i in range(0, 400, 7):  # no single change lowers it
            for j in range(k):
                other = got.copy()
                other[i] = j
                assert within(other) >= best * (1 - 1e-8)


def test_transfers_take_few_passes(spark, monkeypatch):
    """A pass moves its points until none of them gains; with a move each at most, these took 34 passes."""
    rng = np.random.default_rng(3)
    xy = rng.normal(size=(3000, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "x": xy[:, 0], "y": xy[:, 1], "own": ((xy[:, None] - xy[None, :6]) ** 2).sum(-1).argmin(1)}))
    cuts, plain = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda d: cuts.append(1) or plain(d))
    got = spatial.transfers(df, 6).toPandas()["own"]
    assert len(cuts) <= 8 and set(got) == set(range(6))


def test_colours_of_dense_graphs_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    every = sorted({(min(i, j), max(i, j)) for i in range(120) for j in map(int, rng.integers(0, 120, 20)) if i != j})  # a fourth of all pairs
    seen = _counted(monkeypatch, chromatic)
    got = chromatic.colouring(spark.createDataFrame(every, "a long, b long"), spark.range(120), 40)
    hashes, near, want = noise._xxhash(np.arange(120).view(np.uint64), np.array([42], np.uint64)).view(np.int64), [[] for _ in range(120)], {}
    for a, b in every:
        near[a].append(b)
        near[b].append(a)
    for i in np.argsort(hashes).tolist():
        want[i] = next(c for c in range(1, 121) if c not in {want.get(j) for j in near[i]})
    assert {r.id: r.colour for r in got.collect()} == want
    assert len(seen) <= 2 + 2 * 3  # rounds by the degree took more


@pytest.mark.parametrize("most", [100_000, 25])
def test_colours_of_few_rows_are_drawn_in_one_step(spark, monkeypatch, most):
    d = _data(90, m=3, seed=7)
    q, rhs = _precision(d)
    precision, locs, right = _tables(spark, d, q, rhs)
    colours = chromatic.colouring(precision.where("a < b").select("a", "b"), locs.select("id")).toPandas().sort_values("id")["colour"].to_numpy()
    w = np.random.default_rng(1).normal(size=90)
    field = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "value": w}))
    table = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "colour": colours.astype(np.int32)}))
    update = chromatic.ColourUpdate(precision, table) if most > 90 else chromatic.ColourUpdate(precision, table, most)
    seen = _counted(monkeypatch, chromatic, triangular)
    got = _values(update.sweep(field, right.where("id % 9 > 0"), 6))
    update.close()
    z, rhs = noise.normals(np.arange(90), 6), np.where(np.arange(90) % 9 > 0, rhs, 0.0)
    for k in range(1, colours.max() + 1):
        rows = np.nonzero(colours == k)[0]
        w[rows] += (rhs[rows] - q[rows] @ w) / np.diag(q)[rows] + z[rows] / np.sqrt(np.diag(q)[rows])
    assert np.allclose(got, w, rtol=1e-9, atol=1e-10)
    assert colours.max() > 4 and len(seen) <= (2 if most > 90 else colours.max() + 1)
