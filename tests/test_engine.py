"""The engine on Spark: spatial index, bases, designs, models, and the catalogue against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafield.model import Model, SpatialIndex
from terrafield.operators import basis, design, linalg, plotdata, spatial, vecchia
from terrafield.operators import relational as rel
from terrafield.plans import catalogue
from terrafield.streaming import records as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(str([None if v is None or v != v else round(float(v), 9) + 0.0 if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((150, 2))
    xy = np.concatenate([xy, xy[:50]])
    pdf = pd.DataFrame({"obs_id": np.arange(200), "x": xy[:, 0], "y": xy[:, 1], "v1": rng.random(200), "z": np.sin(6 * xy[:, 0]) + 0.1 * rng.normal(size=200)})
    return SpatialIndex.build(spark.createDataFrame(pdf), m=5)


def test_index(index):
    assert index.locs.count() == 150 and index.obs.count() == 200
    assert index.nn.count() == 150 * 5 - 15
    p = index.parents()
    assert (p[:, 1:] < np.arange(150)[:, None]).all()
    xy = np.array(index.locs.orderBy("id").select("x", "y").toPandas())
    for i in (3, 70, 149):
        near = np.argsort(((xy[:i] - xy[i]) ** 2).sum(1))[:5]
        assert p[i, 1 : len(near) + 1].tolist() == near.tolist()
    assert index.groups().where("n = 2").count() == 50
    with pytest.raises(ValueError):
        rel.require_disjoint(index.locs.select("x", "y"), index.locs.select("x", "y").limit(1))


def test_partition_sizes_and_colours(index):
    assert spatial.partition_sizes(2000) == [2, 3]
    out = index.partitions()
    assert {"2_clust", "3_clust", "2_colour", "3_colour"} <= set(out.columns) and out.count() == 150
    assert spatial.greedy_colouring(4, [(0, 1), (1, 2), (0, 2)]) == [1, 2, 3, 1]


def test_neighbour_count_of_two_thousand_points(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "x": rng.random(2000), "y": rng.random(2000)}))
    near = spatial.nearest_neighbours(df, 10)
    assert spatial.with_self(near, df).count() == 21_945
    grid = spatial.nearest_neighbours(df, 10, broadcast_points=100)
    assert sorted(map(tuple, near.select("child", "k", "parent").collect())) == sorted(map(tuple, grid.select("child", "k", "parent").collect()))


def test_basis_against_dense(spark, index):
    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=30, seed=3)
    phi = {r.id: np.array(r.phi) for r in pp.dense_rows().collect()}
    y = np.random.default_rng(2).normal(size=(30, 2))
    for r in pp.times(y).collect():
        assert np.allclose([r.pp0, r.pp1], phi[r.id] @ y)
    v = index.locs.select("id", F.col("x").alias("value"))
    vx = {r.id: r.value for r in v.collect()}
    assert np.allclose(pp.transpose_times(v), sum(phi[i] * vx[i] for i in phi))
    assert 0 <= pp.variance_loss().agg(F.min("loss")).first()[0]
    tight = basis.PredictiveProcess.fit(index.locs, 5, knots=pp.knots, matern_range=0.001)
    assert tight.verdict() == "quite a bit of loss" and basis.PredictiveProcess.fit(index.locs, 5, knots=pp.knots, matern_range=5.0).verdict() == "great"


def test_design(index):
    d = design.process_covariates(index.obs, ["v1", "x"])
    assert d.names == ["intercept", "v1", "x"] and d.which_locs == ["intercept", "x"] and d.locs.count() == 150
    with pytest.raises(ValueError):
        design.process_covariates(index.obs.withColumn("v2", F.col("v1") * 2), ["v1", "v2"])
    with pytest.raises(ValueError):
        design.process_covariates(index.obs, ["v1"], one_obs_per_locs=True)


def test_sandwich_against_the_driver(spark, index):
    locs = index.locs.withColumns({"intercept": F.lit(1.0), "lr0": F.lit(-2.0) + F.col("x")})
    v = vecchia.factor(spatial.with_self(index.nn, index.locs), locs, grad=True)
    f = linalg.Factor.collect(v)
    xy = np.array(index.locs.orderBy("id").select("x", "y").toPandas())
    t = v.orderBy("child").collect()
    f.deriv = np.zeros((150, 6, 6, 1))
    for i, r in enumerate(t):
        n = len(r.coef)
        f.deriv[i, :n, :n] = np.array(r.deriv).reshape(n, n, 1)
    got = {r.id: r.grad for r in vecchia.sandwiches(v, index.locs.select("id", F.col("x").alias("value")), index.locs.select("id", F.col("y").alias("value")), 1, log_det=True).collect()}
    want = f.sandwich(xy[:, 0], xy[:, 1], log_det=True)[:, 0]
    assert np.allclose([got[i + 1] for i in range(150)], want)
    lv = {r.id: r.value for r in linalg.matvec(vecchia.entries(v), index.locs.select("id", F.col("y").alias("value"))).collect()}
    assert np.allclose([lv[i + 1] for i in range(150)], f.times(xy[:, 1]))


def test_model(spark, index):
    m = Model.build(index, covariates=["v1"], n_chains=2)
    m.run(6).run(4)
    assert m.done == 10 and len(m.checkpoints) == 2
    assert m.records.where("param = 'beta'").count() == 2 * 10 * 2
    assert m.estimate().where("param = 'field'").count() == 150
    new = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.51, 0.5)], "id long, x double, y double")
    assert m.predict_field(new).count() == 2
    with pytest.raises(ValueError):
        m.predict_field(index.locs.limit(1))
    rows = spark.createDataFrame([(1, 1.0, 0.3)], "obs_id long, intercept double, v1 double")
    assert m.predict_fixed_effects(rows).count() == 1 and m.predict_noise(new).count() == 2
    with pytest.raises(ValueError):
        m.predict_noise(new.withColumn("v1", F.lit(1.0)), ["v1"])
    tables = plotdata.diagnostic_tables(m.records, fields=True)
    assert list(tables)[:2] == ["range_beta", "noise_beta"] and list(tables)[-1] == "field"
    assert tables["beta"]["trace"].count() == 2 * 5 * 2 and tables["field"]["psrf"].count() > 0
    with pytest.raises(ValueError):
        m.predict_fixed_effects(rows.drop("v1"))
    assert m.effective_sizes().count() == 5 and m.summary().count() > 5
    assert m.psrf("beta").count() > 0
    for bad in ({"smoothness": 1.0}, {"n_chains": 1}, {"range_bounds": (1, 2)}):
        with pytest.raises(ValueError):
            Model.build(index, **bad)


def test_model_with_bases(spark, index):
    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=10, seed=1)
    m = Model.build(index, covariates=["v1"], noise_pp=pp, range_pp=pp, n_chains=2, anisotropic=True).run(4)
    # 200 observations, but one cell per location, as the noise design is constant within locations
    assert m.data.x_range.shape == (150, 11) and m.data.x_noise.shape == (150, 11) and m.data.n.sum() == 200
    assert m.records.where("param = 'range_beta'").count() == 2 * 4 * 11 * 3
    assert m.records.where("param = 'range_log_scale'").count() == 2 * 4 * 6
    new = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.51, 0.5)], "id long, x double, y double")
    assert m.predict_noise(new).count() == 2 and m.predict_field(new).count() == 2


def test_models_over_cells_and_over_a_table_agree(spark, index, monkeypatch):
    """Two ways to ask the observations: sums by cell on the driver, and aggregations on the cluster."""
    from terrafield import model
    from terrafield.operators import distributed

    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=6, seed=1)
    monkeypatch.setattr(model, "RECORDS_AT_ONCE", 300)
    a = Model.build(index, covariates=["v1"], noise_x=["v1"], noise_pp=pp)
    b = Model.build(index, covariates=["v1"], noise_x=["v1"], noise_pp=pp, max_cells=10)
    assert isinstance(b.data, distributed.ObservationTable) and len(a.data.n) == 200
    a.run(2).run(1)
    b.run(2).run(1)
    rows = [sorted(map(tuple, m.records.collect())) for m in (a, b)]
    assert [r[:5] for r in rows[0]] == [r[:5] for r in rows[1]]
    assert np.allclose([r[5] for r in rows[0]], [r[5] for r in rows[1]], rtol=1e-4, atol=1e-6)
    assert {r.section for r in a.summary().collect()} == {"data", "index", "model", "basis", "prior", "states", "chains", "records"} and "150 locations" in str(a)


def test_prediction_at_many_and_repeated_places(spark, index):
    m = Model.build(index, covariates=["v1"]).run(8)
    rng = np.random.default_rng(3)
    xy = rng.random((300, 2))
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(300), xy)] + [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(xy[:40])]
    got = {r.id: r for r in m.predict_field(spark.createDataFrame(rows, "id long, x double, y double")).collect()}
    assert len(got) == 340
    at = {(x, y): got[i] for i, x, y in rows[:300]}
    for i, x, y in rows[300:]:
        assert got[i][1:] == at[x, y][1:]
    # far from all locations the prior's spread, near one of them the field there
    near = index.locs.orderBy("id").limit(1).select(F.lit(1).alias("id"), (F.col("x") + 1e-7).alias("x"), "y")
    one = m.predict_field(near).first()
    field = m.estimate().where("param = 'field' and i = 1").first()
    assert one.mean == pytest.approx(field.mean, abs=0.05) and one.q0_025 <= one.median <= one.q0_975
    # a design that is told, by id, is the design's own
    new = spark.createDataFrame(rows[:30], "id long, x double, y double")
    ones = np.ones((30, 1))
    assert sorted(m.predict_field(new).collect()) == sorted(m.predict_field(new, range_new=ones, scale_new=ones).collect())


@pytest.mark.parametrize("case", ["x", "basis", "both", "both_on_obs", "basis_three"])
def test_products_of_designs_and_bases(spark, index, case):
    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=8, seed=2)
    phi = {r.id: np.array(r.phi) for r in pp.dense_rows().collect()}
    rng = np.random.default_rng(4)
    locs = index.locs.withColumn("intercept", F.lit(1.0))
    of = {r.id: np.array([1.0, r.x]) for r in locs.collect()}
    cols = 3 if case == "basis_three" else 2
    y = rng.normal(size=({"x": 2, "basis": 8, "basis_three": 8}.get(case, 10), cols))
    if case == "x":
        got, want = basis.times(y, locs, ["intercept", "x"]), {i: v @ y for i, v in of.items()}
    elif case.startswith("basis"):
        got, want = basis.times(y, pp=pp), {i: v @ y for i, v in phi.items()}
    elif case == "both":
        got, want = basis.times(y, locs, ["intercept", "x"], pp), {i: np.concatenate([of[i], phi[i]]) @ y for i in phi}
    else:
        obs = index.obs.select("obs_id", "loc_id", "v1")
        got = basis.times(y[1:], obs, ["v1"], pp, on="loc_id", key="obs_id")
        want = {r.obs_id: np.concatenate([[r.v1], phi[r.loc_id]]) @ y[1:] for r in obs.collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(np.allclose(r[1:], want[r[0]]) for r in rows)


def test_products_refuse_wrong_shapes(index):
    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=8, seed=2)
    for how in ({"y": np.ones(3)}, {"y": np.ones(3), "x": index.locs, "names": ["x"]}, {"y": np.ones(7), "pp": pp}, {"y": np.ones(8), "x": index.locs, "names": ["x"], "pp": pp}):
        with pytest.raises(ValueError):
            basis.times(**how)


def test_gram_with_a_basis(spark, index):
    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=6, seed=2)
    d = design.process_covariates(index.obs, ["v1", "x"], pp=pp)
    phi = {r.id: np.array(r.phi) for r in pp.dense_rows().collect()}
    rows = index.obs.collect()
    x = np.array([[1.0, r.v1, r.x, *phi[r.loc_id]] for r in rows])
    assert np.allclose(d.gram, x.T @ x) and np.allclose(d.chol.T @ d.chol, x.T @ x + 1e-10 * np.eye(9))
    first = {}
    for r in rows:
        first.setdefault(r.loc_id, np.array([1.0, r.x, *phi[r.loc_id]]))
    x = np.array(list(first.values()))
    assert np.allclose(d.gram_locs, x.T @ x) and d.names == ["intercept", "v1", "x"]


def test_losses_of_knots_and_the_map(spark, index):
    pp = basis.PredictiveProcess.fit(index.locs, 5, knots=12, seed=3)
    every = pp.every_loss().collect()
    assert [r.kind for r in every].count("knot") == 12 and len(every) == 162
    assert all(0 <= r.loss <= 100 for r in every)
    inv = np.linalg.inv(pp.knot_factor)
    assert np.allclose([r.loss for r in every if r.kind == "knot"], 100 * np.maximum(0, 1.000001 - (inv**2).sum(1)) / 1.000001)
    assert {r.name for r in pp.summary().collect()} >= {"knots", "verdict", "mean_loss"} and "12 knots" in str(pp)
    rows = plotdata.knot_map(pp, index.locs).orderBy("draw").collect()
    assert [r.draw for r in rows] == list(range(1, 163)) and [r.kind for r in rows] == ["location"] * 150 + ["knot"] * 12
    losses = [r.loss for r in rows[:150]]
    assert losses == sorted(losses) and all(r.bin is not None for r in rows[:150]) and rows[-1].bin is None
    plain = plotdata.knot_map(pp, index.locs, losses=False, knots=False).collect()
    assert len(plain) == 150 and all(r.loss is None for r in plain)


def test_neighbours_on_a_grid_do_not_mind_far_points(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((1500, 2))
    xy[:400] = 0.5 + 1e-5 * rng.random((400, 2))
    xy[7], xy[8], xy[9:40] = (900, -900), (0.2, 1e4), xy[50]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500), "x": xy[:, 0], "y": xy[:, 1]}))
    for ordered in (True, False):
        want = sorted(map(tuple, spatial.nearest_neighbours(df, 6, ordered).select("child", "k", "parent").collect()))
        got = sorted(map(tuple, spatial.grid_neighbours(df, 6, ordered, cell_rows=20).select("child", "k", "parent").collect()))
        joined = spatial.grid_neighbours(df, 6, ordered, cell_rows=20, depth=8, directory=10)  # more cells than that are searched by joins
        assert sorted(map(tuple, joined.select("child", "k", "parent").collect())) == got
        assert got == want
    few = spatial.grid_neighbours(df, 6, children="id >= 1490")
    assert sorted(map(tuple, few.select("child", "k", "parent").collect())) == [w for w in sorted(map(tuple, spatial.nearest_neighbours(df, 6).select("child", "k", "parent").collect())) if w[0] >= 1490]
    with pytest.raises(ValueError):
        spatial.nearest_of(df, df, 1, most=100)
    assert spatial.grid_neighbours(df.where("false"), 3).count() == 0


def test_numbers_and_totals_over_ranges(spark):
    from terrafield.operators.ranges import numbered

    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id", (F.col("id") / 7).alias("v"))
    rows = numbered(df, [F.col("h").desc()], ("id", "v")).orderBy(F.col("h").desc()).collect()
    n, v = 0, 0.0
    for k, r in enumerate(rows):
        assert r.rank == k and r.before_id == n and r.before_v == pytest.approx(v)
        n, v = n + r.id, v + r.v
    assert numbered(df.where("false"), [F.col("h")], ("id",)).count() == 0


def test_summaries_over_ranges_and_arrays(spark):
    from terrafield.operators import posterior

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 3000), "b": rng.choice(["x", None], 3000), "value": np.round(rng.normal(size=3000), 1)})
    pdf.loc[rng.integers(0, 3000, 200), "value"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.unionByName(spark.createDataFrame([(9, "x", None), (8, "x", 2.5)], "a long, b string, value double"))
    got = {(r.a, r.b): r for r in posterior.summary(df, ["a", "b"]).collect()}
    assert (got[9, "x"].mean, got[9, "x"].median) == (None, None) and got[8, "x"].median == 2.5 and got[8, "x"].sd is None
    rows = df.groupBy("a", "b").agg(F.collect_list("value").alias("values"))
    arrays = {(r.a, r.b): r for r in posterior.array_summary(rows, ["a", "b"]).collect()}
    for (a, b), r in got.items():
        v = pdf[(pdf.a == a) & (pdf.b.isna() if b is None else pdf.b == b)].value.dropna().to_numpy()
        if len(v) > 1:
            want = [v.mean(), *np.quantile(v, (0.025, 0.5, 0.975)), v.std(ddof=1)]
            assert np.allclose(r[2:], want) and np.allclose(arrays[a, b][2:], want)
        else:
            assert arrays[a, b] == r


def test_colours_and_arrays(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "id int, v double")
    assert [r.colour for r in rel.colour_index(df, "v").orderBy("id").collect()] == [1, 46, 91, 1]
    x = spark.createDataFrame([(n % 2, n // 2 % 2, n // 4, float(n + 1)) for n in range(12)], "i int, j int, k int, value double")
    m = spark.createDataFrame([(n % 3, n // 3, float(n + 1)) for n in range(9)], "row int, col int, m double")
    got = {(r.i, r.j, r.k): r.value for r in rel.multiply_array(x, m, 3).collect()}
    assert [got[n % 2, n // 2 % 2, n // 4] for n in range(12)] == [38, 44, 50, 56, 83, 98, 113, 128, 128, 152, 176, 200]
    m = spark.createDataFrame([(n % 2, n // 2, float(n + 1)) for n in range(4)], "row int, col int, m double")
    got = {(r.i, r.j, r.k): r.value for r in rel.multiply_array(x.where("k < 2"), m, 1).collect()}
    assert [got[n % 2, n // 2 % 2, n // 4] for n in range(8)] == [7, 10, 15, 22, 23, 34, 31, 46]


def test_streamed_summary(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, "beta", 1, 1, float(i)) for i in range(1, 11)], "chain int, iteration int, param string, i int, j int, value double")
    rows.write.parquet(str(tmp_path / "records"))
    q = stream.start_summary(spark, str(tmp_path / "records"), "running", str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n, mean from running").first()[:] == (10, 5.5)


def test_observations_on_the_cluster_give_the_same_chain(spark):
    from terrafield.operators import distributed, sampler

    rng = np.random.default_rng(8)
    n = 40
    xy = rng.random((n, 2))
    parents = np.full((n, 5), -1, np.int64)
    parents[:, 0] = np.arange(n)
    for i in range(1, n):
        near = np.argsort(((xy[:i] - xy[i]) ** 2).sum(1))[:4]
        parents[i, 1 : len(near) + 1] = near
    loc = np.repeat(np.arange(n), 3)
    one, x_locs = np.ones((n, 1)), np.column_stack([np.ones(n), xy[:, 0]])
    x = np.column_stack([x_locs[loc], rng.normal(size=len(loc))])
    z = x @ [1.0, 2.0, -1.0] + rng.normal(size=len(loc))
    local = sampler.Data(xy, parents, loc, z, x, x_locs, [0, 1], one, one, x_locs[loc])
    pdf = pd.DataFrame({"loc": loc, "z": z, "intercept": x[:, 0], "x": x[:, 1], "v": x[:, 2]})
    far = distributed.ObservationTable.of(spark.createDataFrame(pdf), xy, parents, x_locs, [0, 1], one, one, ["intercept", "x", "v"], ["intercept", "x"])
    a, b = (sampler.run_chain(d, 1, 3, seed=4)[1] for d in (local, far))
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-5, atol=1e-7)


def test_a_run_reports_its_diagnostics(spark, index, capsys):
    m = Model.build(index, covariates=["v1"], n_chains=2).run(12, report=0.5)
    shown = capsys.readouterr().out
    assert "12 iterations in" in shown and "psrf" in shown
    got = {(r.param, r.i, r.j): r for r in m.diagnose(0.5).collect()}
    values = {}
    for r in m.records.where("param <> 'field'").collect():
        values.setdefault((r.param, r.i, r.j), {}).setdefault(r.chain, []).append((r.iteration, r.value))
    assert set(got) == set(values)
    for key, chains in values.items():
        kept = [np.array([v for t, v in sorted(c) if t > 6]) for c in chains.values()]
        within, between, n, k = np.mean([c.var(ddof=1) for c in kept]), np.var([c.mean() for c in kept], ddof=1), len(kept[0]), len(kept)
        if within > 0:
            assert np.isclose(got[key].psrf, (k + 1) / k * between / within * (n - 1) / n + (n + 1) / n)
        else:
            assert got[key].psrf is None
    m.records = m.records.where("chain = 1")
    assert {r.psrf for r in m.diagnose().collect()} == {None}


def test_locations_match_in_the_digits_that_text_keeps(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(size=(200, 2)) * 10.0 ** rng.integers(-8, 9, (200, 1)), [[0.1 + 0.2, 1.0], [0.3, 1.0], [0.0, -0.0]]])
    locs = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(xy)], "loc_id long, x double, y double")
    text = [tuple(float(f"{v:.15g}") for v in row) for row in xy]
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(text)] + [(900, None, 1.0), (901, 5e300, float("nan")), (902, -0.0, 0.0)]
    obs = spark.createDataFrame(rows, "obs_id long, x double, y double")
    got = {r.obs_id: r.loc_id for r in rel.match_printed(obs, locs).collect()}
    # 0.1 + 0.2 and 0.3 agree in 15 digits: the first one is taken
    assert got == {i + 1: i + 1 for i in range(len(xy))} | {202: 201, 902: 203}
    exact = {r.obs_id for r in rel.match_locations(obs, locs).collect()}
    assert exact < set(got) and len(got) - len(exact) > 100
    assert rel.match_printed(obs, locs.limit(0)).count() == 0


def test_a_model_joins_no_observations_with_themselves(spark, index, monkeypatch):
    """Both designs are columns of one table: it was joined with itself by obs_id, all rows shuffled twice for each aggregation."""
    from terrafield import model as of

    tables, plain = [], of._cells
    monkeypatch.setattr(of, "_cells", lambda table, *a: tables.append(table) or plain(table, *a))
    m = of.Model.build(index, covariates=["v1"], noise_x=["v1"])
    assert m.data.x_noise.shape[1] == 2
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(tables[0]) == joins(index.obs)
