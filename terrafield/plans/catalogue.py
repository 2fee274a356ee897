"""The catalogue of queries: every operator on the driver tables, with DuckDB SQL wherever SQL can express it."""

from __future__ import annotations

from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafield.functions import kernels as K
from terrafield.operators import basis, chromatic, cholesky, design, diagnostics, fieldtables, linalg, plotdata, posterior, regions, sampler, spatial, triangular, vecchia
from terrafield.operators import relational as rel
from terrafield.operators.ranges import numbered
from terrafield.session import cut, ship
from terrafield.sources import tables as T

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query(spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ----------------------------------------------------------------------------- the tables in their roles


def obs(spark: SparkSession, d: str) -> DataFrame:
    return T.lattice_observations(T.read(spark, d, "lineitem"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return T.point_locations(T.read(spark, d, "embeddings"))


def locs(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).withColumnRenamed("loc_id", "id")


def records(spark: SparkSession, d: str, components: int = 4) -> DataFrame:
    return T.chain_records(T.read(spark, d, "events"), components)


OBS = "o as (select cast(l_quantity as double) as x, cast(l_discount as double) as y, cast(l_extendedprice as double) as z, cast(l_tax as double) as cov, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)"
PTS = "p as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, label from embeddings)"
REC = "rec as (select event_type as chain, cast(row_number() over (partition by event_type order by ts, event_id) as integer) as iteration, cast(user_id % 4 as integer) as i, cast(value as double) as value from events)"
KEPT = f"{REC}, kept as (select * from (select *, max(iteration) over (partition by chain) as last from rec) where iteration > last * 0.5e0)"
ALL = ["x", "y", "z", "cov", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# ----------------------------------------------------------------------------- posterior summaries and records


def _summary_sql(by: str, source: str = "kept", value: str = "value") -> str:
    q = ", ".join(f"round(quantile_cont({value}, {p}), 6) as {n}" for p, n in ((0.025, "q0_025"), (0.5, "median"), (0.975, "q0_975")))
    return f"select {by}, round(avg({value}), 6) as mean, {q}, round(stddev_samp({value}), 6) as sd from {source} group by {by}"


def _rounded(s: DataFrame, by) -> DataFrame:
    return s.select(*by, *[r(c).alias(c) for c in ("mean", "q0_025", "median", "q0_975", "sd")])


@query(f"with {KEPT} {_summary_sql('chain, i')}")
def posterior_summary(spark, d):
    return _rounded(posterior.summary(rel.burn_in(records(spark, d)), ["chain", "i"]), ["chain", "i"])


@query(f"with {KEPT} {_summary_sql('i')}")
def estimate_parameters(spark, d):
    return _rounded(posterior.estimate_parameters(records(spark, d), ["i"]), ["i"])


@query(f"with {KEPT} select chain, iteration, i, value from kept")
def burnin_filter(spark, d):
    return rel.burn_in(records(spark, d)).select("chain", "iteration", "i", "value")


@query(f"with {REC} select chain, iteration, value from rec where iteration % 10 = 0")
def thinning(spark, d):
    return rel.thin(records(spark, d), 0.1).select("chain", "iteration", "value")


@query(f"with {REC} select chain, i, iteration, round(sum(value) over (partition by chain, i order by iteration), 4) as cumsum from rec")
def cumsum_records(spark, d):
    x = records(spark, d)
    return rel.cumsum_array(x, ("chain", "i"), "iteration").select("chain", "i", "iteration", r("cumsum", 4).alias("cumsum"))


@query(f"with {REC} select chain, cast(min(iteration) filter (value > 50) as integer) as first_index from rec group by chain")
def first_index(spark, d):
    return rel.first_index(records(spark, d), F.col("value") > 50, "iteration", ["chain"])


@query(f"with {REC}, l as (select max(iteration) as last from rec) select chain, cast(iteration + case when i < 2 then 0 else last end as integer) as iteration, value from rec, l")
def concat_chains(spark, d):
    x = records(spark, d)
    last = x.agg(F.max("iteration")).first()[0] or 0
    return rel.concat_chains(x.where("i < 2"), x.where("i >= 2").withColumn("iteration", F.col("iteration") + last)).select("chain", "iteration", "value")


def _array(spark, d) -> DataFrame:
    """(i, j, k, value): user, hour and event-number cells of the events."""
    e = T.read(spark, d, "events")
    c = e.select(F.pmod("user_id", F.lit(3)).cast("int").alias("i"), F.pmod("event_id", F.lit(4)).cast("int").alias("j"), F.pmod(F.floor(F.col("event_id") / 4).cast("long"), F.lit(5)).cast("int").alias("k"), F.col("value").cast("double").alias("value"))
    return c.groupBy("i", "j", "k").agg(F.sum("value").alias("value"))


ARR = "arr as (select cast(user_id % 3 as integer) as i, cast(event_id % 4 as integer) as j, cast((event_id // 4) % 5 as integer) as k, sum(cast(value as double)) as value from events group by all)"


def _matrix(spark, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select((F.col("id") % rows).cast("int").alias("row"), F.floor(F.col("id") / rows).cast("int").alias("col"), (F.col("id") % 7 - 2).cast("double").alias("m"))


def _matrix_sql(rows: int, cols: int) -> str:
    return f"m as (select cast(id % {rows} as integer) as row, cast(id // {rows} as integer) as col, cast(id % 7 - 2 as double) as m from range({rows * cols}) t(id))"


def _multiply(spark, d, axis):
    n = (3, 4, 5)[axis - 1]
    return rel.multiply_array(_array(spark, d), _matrix(spark, n, 2) if axis == 3 else _matrix(spark, 2, n), axis).select("i", "j", "k", r("value", 4).alias("value"))


@query(f"with {ARR}, {_matrix_sql(2, 3)} select m.row as i, j, k, round(sum(value * m), 4) as value from arr join m on arr.i = m.col group by all")
def array_multiply_1(spark, d):
    return _multiply(spark, d, 1)


@query(f"with {ARR}, {_matrix_sql(2, 4)} select i, m.row as j, k, round(sum(value * m), 4) as value from arr join m on arr.j = m.col group by all")
def array_multiply_2(spark, d):
    return _multiply(spark, d, 2)


@query(f"with {ARR}, {_matrix_sql(5, 2)} select i, j, m.col as k, round(sum(value * m), 4) as value from arr join m on arr.k = m.row group by all")
def array_multiply_3(spark, d):
    return _multiply(spark, d, 3)


# ----------------------------------------------------------------------------- convergence

_PSRF = """
    lim as (select {bysel} min(c) as n from (select chain, {bysel} count(*) as c from it group by chain {bycomma}) {bygroup}),
    cut as (select it.* from it join lim on {bylim} where it.i <= lim.n),
    cs as (select chain, {bysel} i, sum(x) over (partition by chain {bycomma} order by i) as s, sum(x * x) over (partition by chain {bycomma} order by i) as s2 from cut),
    ends as (select distinct {bycut} cut.i as e, greatest(cast(ceil(cut.i * 0.5) as bigint), 1) as lb from cut join lim on {bylim2} where cut.i > lim.n * 0.5),
    w as (select {byends} ends.e, a.chain, cast(ends.e - ends.lb as double) as n, (a.s - b.s) / (ends.e - ends.lb) as m, (a.s2 - b.s2) / (ends.e - ends.lb) as q
          from ends join cs a on a.i = ends.e {bya} join cs b on b.i = ends.lb and b.chain = a.chain {byb}),
    g as (select {bysel} e, max(n) as n, cast(count(*) as double) as k, avg(m) as gm, avg((q - m * m) * n / (n - 1)) as wv, avg(m * m) as mm from w group by e {bycomma}),
    curve as (select {bysel} e, (k + 1) / k * ((mm - gm * gm) * k / (k - 1) / wv) * ((n - 1) / n) + (n + 1) / n as psrf from g)
"""
_PSRF_1 = _PSRF.format(bysel="", bycomma="", bygroup="", bylim="true", bylim2="true", bycut="", byends="", bya="", byb="")
_PSRF_C = _PSRF.format(bysel="comp,", bycomma=", comp", bygroup="group by comp", bylim="it.comp = lim.comp", bylim2="cut.comp = lim.comp", bycut="cut.comp,", byends="ends.comp,", bya="and a.comp = ends.comp", byb="and b.comp = ends.comp")


def _numbered(spark, d) -> DataFrame:
    w = Window.partitionBy("chain", "comp").orderBy("iteration")
    return records(spark, d).withColumnRenamed("i", "comp").select("chain", "comp", F.row_number().over(w).alias("i"), "value")


@query(f"with {REC}, it as (select chain, iteration as i, value as x from rec), {_PSRF_1} select cast(e as integer) as e, round(psrf, 6) as psrf from curve")
def psrf_curve(spark, d):
    return diagnostics.psrf(records(spark, d).select("chain", F.col("iteration").alias("i"), "value")).select("e", r("psrf").alias("psrf"))


_COMP = "it as (select chain, i as comp, row_number() over (partition by chain, i order by iteration) as i, value as x from rec)"


@query(f"with {REC}, {_COMP}, {_PSRF_C} select cast(e as integer) as e, round(quantile_cont(psrf, 1.0), 6) as q100, round(quantile_cont(psrf, 0.99), 6) as q99, round(quantile_cont(psrf, 0.9), 6) as q90, round(quantile_cont(psrf, 0.5), 6) as q50 from curve group by e")
def psrf_quantiles(spark, d):
    q = diagnostics.psrf_quantiles(diagnostics.psrf(_numbered(spark, d), by=["comp"]))
    return q.select("e", *[r(c).alias(c) for c in ("q100", "q99", "q90", "q50")])


@query()
def ess(spark, d):
    return diagnostics.ess(records(spark, d), by=["i"])


@query(f"with {REC}, l as (select max(iteration) as last from rec) select chain, iteration, i, value, cast((i - 1 + 6) % 6 + 1 as integer) as colour from rec, l where iteration > last * 0.5e0")
def trace_data(spark, d):
    return plotdata.trace(records(spark, d))


# ----------------------------------------------------------------------------- relational core on replicated observations


@query(f"with {OBS} select distinct x, y from o")
def unique_locs(spark, d):
    return rel.unique_points(obs(spark, d))


@query(f"with {OBS} select x, y, z, cov, l_orderkey, l_linenumber, row_number() over (partition by x, y order by {', '.join(ALL)}) > 1 as dup from o")
def duplicated_flag(spark, d):
    return rel.duplicated(obs(spark, d), ["x", "y"], ALL).select("x", "y", "z", "cov", "l_orderkey", "l_linenumber", "dup")


@query(f"with {OBS} select x, y, count(*) as n_obs from o group by x, y")
def obs_per_loc(spark, d):
    return rel.per_location(obs(spark, d))


@query(f"with {OBS} select x, y, round(sum(z), 2) as total from o group by x, y")
def scatter_add(spark, d):
    return rel.scatter_add(obs(spark, d), "z", ["x", "y"]).select("x", "y", r("total", 2).alias("total"))


@query(f"with {OBS} select o.x, o.y, z, n as field from o join (select x, y, count(*) as n from o group by x, y) f on o.x = f.x and o.y = f.y")
def gather(spark, d):
    o = obs(spark, d)
    return rel.gather(o, o.groupBy("x", "y").agg(F.count(F.lit(1)).alias("field")), ["x", "y"]).select("x", "y", "z", "field")


@query(f"with {OBS}, l as (select x, y, dense_rank() over (order by x, y) as loc_id from (select distinct x, y from o)) select loc_id, o.x, o.y, z from o join l on o.x = l.x and o.y = l.y")
def match_locations(spark, d):
    o = obs(spark, d)
    u = rel.unique_points(o)
    l = numbered(u, [F.col("x").asc(), F.col("y").asc()]).select("x", "y", (F.col("rank") + 1).alias("loc_id"))
    return rel.match_locations(o, l).select("loc_id", "x", "y", "z")


@query(f"with {OBS}, l as (select x, y, dense_rank() over (order by x, y) as loc_id from (select distinct x, y from o)) select loc_id, o.x, o.y, z from o join l on o.x = l.x and o.y = l.y")
def match_printed_locations(spark, d):
    """Thirds of the coordinates, which went through text, find the locations that didn't."""
    o = obs(spark, d)
    u = rel.unique_points(o)
    l = numbered(u, [F.col("x").asc(), F.col("y").asc()]).select((F.col("rank") + 1).alias("loc_id"), *[(F.col(c) / 3).alias(f"{c}_3") for c in "xy"])
    read = o.withColumns({f"{c}_3": F.format_string("%.14e", F.col(c) / 3).cast("double") for c in "xy"})
    return rel.match_printed(read, l, ("x_3", "y_3")).select("loc_id", "x", "y", "z")


@query(f"with {OBS} select x, y, min(l_orderkey) as first, count(*) as n from o group by x, y")
def location_groups(spark, d):
    return rel.groups(obs(spark, d).withColumn("loc_id", F.struct("x", "y")), "loc_id", "l_orderkey").select("loc_id.x", "loc_id.y", "first", "n")


@query(f"with {OBS} select distinct x, y from o where cov > 0.05 intersect select distinct x, y from o where cov <= 0.01")
def locs_intersect(spark, d):
    o = obs(spark, d)
    return o.where("cov > 0.05").select("x", "y").intersect(o.where("cov <= 0.01").select("x", "y"))


@query(f"with {OBS} select distinct x, y from o where z < 20000 except select distinct x, y from o where z >= 103000")
def locs_setdiff(spark, d):
    o = obs(spark, d)
    return o.where("z < 20000").select("x", "y").distinct().join(o.where("z >= 103000").select("x", "y"), ["x", "y"], "left_anti")


@query(f"with {OBS} select x, y, z, 1.0e0 as intercept from o order by z desc, {', '.join(ALL)} limit 100")
def top_values(spark, d):
    return rel.with_intercept(obs(spark, d)).orderBy(F.desc("z"), *ALL).limit(100).select("x", "y", "z", "intercept")


@query(f"""with {OBS}, s as (select min(z) as lo, max(z) as hi, count(*) as n, ceil(log2(count(*)) + 1) as k from o)
    select cast(greatest(1, least(k, ceil((z - lo) / ((hi - lo) / k)))) as integer) as bin, count(*) as n from o, s group by all""".replace("count(*) as n from o, s", "count(*) as n from o, s"))
def histogram(spark, d):
    return rel.histogram(obs(spark, d), "z").select("bin", "n")


@query(f"with {PTS}, s as (select min(x) as lo, max(x) as hi from p) select id, cast(round_even((x - lo) / (hi - lo) * 90, 0) + 1 as integer) as colour from p, s")
def color_index(spark, d):
    return rel.colour_index(locs(spark, d), "x").select("id", "colour")


@query(f"""with {PTS} select case when l >= 0 and l <= 1 then '[0,1]' when l <= 2 then '(1,2]' when l <= 5 then '(2,5]' when l <= 10 then '(5,10]' when l <= 50 then '(10,50]' when l <= 100 then '(50,100]' end as bin, count(*) as n
    from (select least(100, abs(x) * 200) as l from p) group by all""")
def varloss_bins(spark, d):
    l = locs(spark, d).select(F.least(F.lit(100.0), F.abs("x") * 200).alias("l"))
    return l.select(rel.cut_right_closed(F.col("l")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- neighbours and graphs

_NN = "pr as (select c.id as child, q.id as parent, (c.x - q.x) * (c.x - q.x) + (c.y - q.y) * (c.y - q.y) as d2 from p c join p q on {on}), nn as (select child, parent, d2, row_number() over (partition by child order by d2, parent) as k from pr)"
NN_BEFORE, NN_ALL = _NN.format(on="q.id < c.id"), _NN.format(on="q.id <> c.id")


@query(f"with {PTS}, {NN_BEFORE} select child, cast(k as integer) as k, parent, round(d2, 8) as d2 from nn where k <= 10")
def ordered_knn(spark, d):
    return spatial.nearest_neighbours(locs(spark, d), 10).select("child", "k", "parent", r("d2", 8).alias("d2"))


@query(f"with {PTS}, {NN_BEFORE} select child, cast(k as integer) as k, parent, round(d2, 8) as d2 from nn where k <= 5")
def ordered_knn_grid(spark, d):
    return spatial.grid_neighbours(locs(spark, d).select("id", "x", "y"), 5).select("child", "k", "parent", r("d2", 8).alias("d2"))


@query(f"with {PTS}, {NN_ALL} select child, parent, round(sqrt(d2), 8) as dist from nn where k = 1")
def knn1(spark, d):
    return spatial.nearest_neighbours(locs(spark, d), 1, ordered=False).select("child", "parent", r(F.sqrt("d2"), 8).alias("dist"))


@query(f"with {PTS}, {NN_ALL} select round(quantile_cont(sqrt(d2), 0.5), 8) as median_dist from nn where k = 1")
def median_nn_dist(spark, d):
    near = spatial.nearest_neighbours(locs(spark, d), 1, ordered=False).select(F.sqrt("d2").alias("d"))
    return posterior.quantiles(near, [], "d", {"median_dist": 0.5}).select(r("median_dist", 8).alias("median_dist"))


@query(f"""with {PTS}, kn as (select label as id, avg(x) as x, avg(y) as y from p group by label), pr as (select p.id as child, kn.id as knot, (p.x - kn.x) * (p.x - kn.x) + (p.y - kn.y) * (p.y - kn.y) as d2 from p, kn),
    nn as (select *, row_number() over (partition by child order by d2, knot) as k from pr) select child, cast(k as integer) as k, knot from nn where k <= 3""")
def nearest_knots(spark, d):
    p = locs(spark, d)
    knots = p.groupBy(F.col("label").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return spatial.nearest_of(p, knots, 3).select("child", "k", F.col("parent").cast("int").alias("knot"))


def _nn_self(spark, d, m: int) -> DataFrame:
    p = locs(spark, d)
    return spatial.with_self(spatial.nearest_neighbours(p, m), p)


NN_SELF3 = f"{NN_BEFORE}, ns as (select child, parent from nn where k <= 3 union all select id, id from p)"


@query(f"with {PTS}, {NN_SELF3} select distinct s.parent as a, t.parent as b from ns s join ns t on s.child = t.child where s.parent < t.parent")
def moral_graph(spark, d):
    return spatial.moral_graph(_nn_self(spark, d, 3))


@query(f"""with {PTS}, {NN_SELF3}, g as (select distinct s.parent as a, t.parent as b from ns s join ns t on s.child = t.child where s.parent < t.parent)
    select distinct least(ca.label, cb.label) as a, greatest(ca.label, cb.label) as b from g join p ca on ca.id = g.a join p cb on cb.id = g.b where ca.label <> cb.label""")
def cluster_graph(spark, d):
    return spatial.cluster_graph(spatial.moral_graph(_nn_self(spark, d, 3)), locs(spark, d).select("id", F.col("label").alias("cluster")))


@query(f"""with recursive {PTS}, {NN_SELF3}, g as (select distinct s.parent as a, t.parent as b from ns s join ns t on s.child = t.child where s.parent < t.parent),
    links as (select distinct ca.label as v, cb.label as u from g join p ca on ca.id = g.a join p cb on cb.id = g.b where ca.label <> cb.label),
    near as (select v, list(u) as us from (select v, u from links union select u, v from links) group by v),
    every as (select cast(id as integer) as v, coalesce(us, []) as us from range(10) t(id) left join near on near.v = id),
    col(v, cs) as (select -1, cast([] as integer[]) union all
        select e.v, list_append(cs, cast(list_min(list_filter(range(1, 12), lambda c: not list_contains(list_transform(us, lambda u: coalesce(cs[u + 1], 0)), c))) as integer)) from col join every e on e.v = col.v + 1)
    select cast(k - 1 as integer) as cluster, cs[k] as colour from col, range(1, 11) t(k) where col.v = 9""")
def cluster_colouring(spark, d):
    p = locs(spark, d)
    links = [(x.a, x.b) for x in spatial.cluster_graph(spatial.moral_graph(_nn_self(spark, d, 3)), p.select("id", F.col("label").alias("cluster"))).collect()]
    return spark.createDataFrame(list(enumerate(spatial.greedy_colouring(10, links))), "cluster int, colour int")


@query(f"""with recursive {PTS}, o as (select id, x, y, row_number() over (order by md5('1:' || cast(id as varchar)), id) as r from p),
    s0 as (select o.*, first_value(r) over w as sel, first_value(x) over w as sx, first_value(y) over w as sy from o, (select avg(x) as cx, avg(y) as cy from o) c
           window w as (order by (x - cx) * (x - cx) + (y - cy) * (y - cy), r)),
    st(k, r, x, y, far, sel) as (
        select cast(1 as bigint), r, x, y, case when r = sel then -1.0e0 else (x - sx) * (x - sx) + (y - sy) * (y - sy) end, sel from s0 union all
        select k + 1, r, x, y, case when r = sel then -1.0e0 else least(far, (x - sx) * (x - sx) + (y - sy) * (y - sy)) end, sel from
            (select k, r, x, y, far, first_value(r) over w as sel, first_value(x) over w as sx, first_value(y) over w as sy, count(*) over () as n from st window w as (order by far desc, r)) where k < n)
    select o.id, k as rank from (select distinct k, sel from st) join o on o.r = sel""")
def maxmin_order(spark, d):
    return spatial.ordered_locations(locs(spark, d).select("id", "x", "y"), "id", most=None).select("id", "rank")


@query()
def kmeans_partition(spark, d):
    p = locs(spark, d).select("id", "x", "y")
    return spatial.kmeans_partitions(p, spatial.partition_sizes(p.count())).drop("x", "y")


# ----------------------------------------------------------------------------- kernels and the factor


@query(f"with {PTS} select id, round(exp(-sqrt(x * x + y * y)), 10) as matern_05, round((1 + sqrt(x * x + y * y)) * exp(-sqrt(x * x + y * y)), 10) as matern_15 from p")
def matern(spark, d):
    dist = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return locs(spark, d).select("id", r(K.matern(dist, 0.5), 10).alias("matern_05"), r(K.matern(dist, 1.5), 10).alias("matern_15"))


@query(f"with {PTS} select id, round(greatest(x * 900, y * 900) + ln(1 + exp(-abs(x * 900 - y * 900))), 8) as lse from p")
def logsumexp(spark, d):
    return locs(spark, d).select("id", r(K.log_sum_exp(F.col("x") * 900, F.col("y") * 900), 8).alias("lse"))


@query(f"with {PTS} select id, x as m11, x + y as m21, x + y as m12, y as m22 from p")
def symmat_2x2(spark, d):
    at, coords = K.symmat_places(3), [F.col("x"), F.col("y"), F.col("x") + F.col("y")]
    return locs(spark, d).select("id", *[coords[at[i, j]].alias(f"m{i + 1}{j + 1}") for i in range(2) for j in range(2)])


_EXPM = "e as (select *, (a + c) / 2 as mean, (a - c) / 2 as half, sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as dl from ab)"
_EXPM_OUT = "exp(mean) * ((exp(dl) + exp(-dl)) / 2 + sh * half) as xx, exp(mean) * ((exp(dl) + exp(-dl)) / 2 - sh * half) as yy, exp(mean) * sh * b as xy"
_SH = "s as (select *, case when dl > 1e-12 then (exp(dl) - exp(-dl)) / 2 / dl else 1.0 end as sh from e)"


@query(f"with {PTS}, ab as (select id, 2 * x as a, 2 * y as c, x + y as b from p), {_EXPM}, {_SH}, f as (select id, {_EXPM_OUT} from s) select id, round(xx, 7) as xx, round(yy, 7) as yy, round(xy, 7) as xy from f")
def expmat_2x2(spark, d):
    xx, yy, xy = K.expm2(2 * F.col("x"), 2 * F.col("y"), F.col("x") + F.col("y"))
    return locs(spark, d).select("id", r(xx, 7).alias("xx"), r(yy, 7).alias("yy"), r(xy, 7).alias("xy"))


def _pairs(spark, d, m: int = 5) -> DataFrame:
    p = locs(spark, d)
    c, q = p.select(F.col("id").alias("child"), F.col("x").alias("cx"), F.col("y").alias("cy")), p.select(F.col("id").alias("parent"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return spatial.nearest_neighbours(p, m).join(c, "child").join(q, "parent")


@query(f"""with {PTS}, {NN_BEFORE}, f as (select id, x, y, exp(2 * (-1.0e0 + 0.3e0 * x)) as r from p),
    g as (select child, parent, (c.r + q.r) / 2 as mid, c.r * q.r as prod, nn.d2 from nn join f c on c.id = child join f q on q.id = parent where k <= 5)
    select child, parent, round(power(prod, 0.25) * power(mid, -0.5) * exp(-sqrt(d2 / mid)) * (1 + sqrt(d2 / mid)), 8) as cov from g""")
def nonstat_cov_iso(spark, d):
    j = _pairs(spark, d)
    r1, r2 = (F.exp(2 * (F.lit(-1.0) + 0.3 * F.col(c))) for c in ("cx", "qx"))
    return j.select("child", "parent", r(K.nonstat_iso(F.col("cx") - F.col("qx"), F.col("cy") - F.col("qy"), r1, r2), 8).alias("cov"))


@query(f"""with {PTS}, {NN_BEFORE}, ab as (select id, x, y, 2 * (-1.0e0 + 0.3e0 * x + 0.5e0 * y) as a, 2 * (-1.0e0 + 0.3e0 * x - 0.5e0 * y) as c, 2 * 0.4e0 * x as b from p), {_EXPM}, {_SH}, f as (select id, x, y, {_EXPM_OUT} from s),
    g as (select child, parent, c.x - q.x as dx, c.y - q.y as dy, (c.xx + q.xx) / 2 as mxx, (c.yy + q.yy) / 2 as myy, (c.xy + q.xy) / 2 as mxy,
                 c.xx * c.yy - c.xy * c.xy as d1, q.xx * q.yy - q.xy * q.xy as d2 from nn join f c on c.id = child join f q on q.id = parent where k <= 5),
    h as (select *, mxx * myy - mxy * mxy as det from g), u as (select *, sqrt(greatest((dx * dx * myy - 2 * dx * dy * mxy + dy * dy * mxx) / det, 0)) as q from h)
    select child, parent, round(power(d1 * d2, 0.25) * power(det, -0.5) * exp(-q) * (1 + q), 8) as cov from u""")
def nonstat_cov_aniso(spark, d):
    def sigma(x, y):
        return K.range_matrix(F.lit(-1.0) + 0.3 * F.col(x), 0.5 * F.col(y), 0.4 * F.col(x))

    j = _pairs(spark, d)
    return j.select("child", "parent", r(K.nonstat_aniso(F.col("cx") - F.col("qx"), F.col("cy") - F.col("qy"), sigma("cx", "cy"), sigma("qx", "qy")), 8).alias("cov"))


def _with_range(p: DataFrame) -> DataFrame:
    return p.withColumn("intercept", F.lit(1.0))


#: log range of the demonstration field: -1 + 0.3 x.
BETA = np.array([[-1.0], [0.3]])


def _factor(spark, d, m, **how) -> DataFrame:
    p = locs(spark, d)
    return vecchia.factor(_nn_self(spark, d, m), vecchia.log_range(_with_range(p), BETA, ["intercept", "x"]).select("id", "x", "y", "lr0"), **how)


_M1 = f"""f as (select id, x, y, exp(2 * (-1.0e0 + 0.3e0 * x)) as r from p),
    c1 as (select child, parent, (c.r + q.r) / 2 as mid, c.r * q.r as prod, nn.d2 from nn join f c on c.id = child join f q on q.id = parent where k = 1),
    s1 as (select child, parent, power(prod, 0.25) * power(mid, -0.5) * exp(-sqrt(d2 / mid)) * (1 + sqrt(d2 / mid)) as s from c1),
    m1 as (select child, parent, power(1.00001e0 - s * s / 1.00001e0, -0.5) as l0, -power(1.00001e0 - s * s / 1.00001e0, -0.5) * s / 1.00001e0 as l1 from s1)"""


@query(f"with {PTS}, {NN_BEFORE}, {_M1} select child, parent, round(l0, 3) as l0, round(l1 / l0, 5) as s from m1")
def vecchia_m1(spark, d):
    v = _factor(spark, d, 1).where(F.size("coef") == 2)
    return v.select("child", F.col("parents")[1].alias("parent"), r(F.col("coef")[0], 3).alias("l0"), r(F.col("coef")[1] / F.col("coef")[0], 5).alias("s"))


@query(f"""with {PTS}, {NN_BEFORE},
    b as (select n1.child, n1.parent as p1, n2.parent as p2 from (select * from nn where k = 1) n1 join (select * from nn where k = 2) n2 on n1.child = n2.child),
    f as (select id, x, y, exp(2 * (-1.0e0 + 0.3e0 * x)) as r from p),
    g as (select b.child, p1, p2,
      ((c.x-a.x)*(c.x-a.x)+(c.y-a.y)*(c.y-a.y))/((c.r+a.r)/2) as q1, power(c.r*a.r,0.25)*power((c.r+a.r)/2,-0.5) as w1,
      ((c.x-z.x)*(c.x-z.x)+(c.y-z.y)*(c.y-z.y))/((c.r+z.r)/2) as q2, power(c.r*z.r,0.25)*power((c.r+z.r)/2,-0.5) as w2,
      ((a.x-z.x)*(a.x-z.x)+(a.y-z.y)*(a.y-z.y))/((a.r+z.r)/2) as q3, power(a.r*z.r,0.25)*power((a.r+z.r)/2,-0.5) as w3
      from b join f c on c.id=b.child join f a on a.id=b.p1 join f z on z.id=b.p2),
    k as (select child,p1,p2, w1*exp(-sqrt(q1))*(1+sqrt(q1)) as s1, w2*exp(-sqrt(q2))*(1+sqrt(q2)) as s2, w3*exp(-sqrt(q3))*(1+sqrt(q3)) as s12 from g),
    h as (select *, (1.00001e0*s1-s12*s2)/(1.00001e0*1.00001e0-s12*s12) as a1, (1.00001e0*s2-s12*s1)/(1.00001e0*1.00001e0-s12*s12) as a2 from k)
    select child, p1, p2, round(a1, 4) as a1, round(a2, 4) as a2 from h""")
def vecchia_m2(spark, d):
    v = _factor(spark, d, 2).where(F.size("coef") == 3)
    c = F.col("coef")
    return v.select("child", F.col("parents")[1].alias("p1"), F.col("parents")[2].alias("p2"), r(-c[1] / c[0], 4).alias("a1"), r(-c[2] / c[0], 4).alias("a2"))


@query()
def vecchia_full(spark, d):
    return _factor(spark, d, 10, grad=True).select("child", "coef", F.size("deriv").alias("n_deriv"))


@query()
def vecchia_anisotropic(spark, d):
    p = vecchia.log_range(_with_range(locs(spark, d)), np.array([[-1.0, 0.1, 0.0], [0.3, 0.0, 0.2]]), ["intercept", "x"])
    return vecchia.factor(_nn_self(spark, d, 5), p, components=3, grad=True).select("child", "coef")


_L1 = f"{_M1}, l as (select child as row, child as col, l0 as value from m1 union all select child, parent, l1 from m1 union all select min(id), min(id), 1.0e0 from p)"


def _entries(spark, d) -> DataFrame:
    return cut(vecchia.entries(_factor(spark, d, 1)))


@query(f"with {PTS}, {NN_BEFORE}, {_L1} select l.row as id, round(sum(l.value * p.y), 3) as value from l join p on p.id = l.col group by l.row")
def sparse_matvec(spark, d):
    v = linalg.matvec(_entries(spark, d), locs(spark, d).select("id", F.col("y").alias("value")))
    return v.select("id", r("value", 3).alias("value"))


@query(f"with {PTS}, {NN_BEFORE}, {_L1} select s.col as a, t.col as b, round(sum(s.value * t.value) / 4 + (case when s.col = t.col then 10 else 0 end), 1) as value from l s join l t on s.row = t.row group by s.col, t.col")
def posterior_precision(spark, d):
    p = locs(spark, d)
    q = linalg.posterior_precision(_entries(spark, d), p.select("id", F.lit(2.0).alias("sd")), p.select("id", F.lit(10.0).alias("value")))
    return q.select("a", "b", r("value", 1).alias("value"))


@query(f"with {PTS}, {NN_BEFORE}, {_L1} select row, col, round(value / (select 1.0e0), 3) as value from l")
def decompressed_factor(spark, d):
    p = locs(spark, d)
    nn = _nn_self(spark, d, 1)
    return spatial.decompress(_factor(spark, d, 1).select("child", "coef"), nn).select("row", "col", r("value", 3).alias("value"))


@query(f"""with {PTS}, {NN_BEFORE}, f as (select id, x, y, exp(2 * (-1.0e0 + 0.3e0 * x)) as r from p),
    e as (select child, parent, c.x as l, c.y as yc, q.y as yp, nn.d2, c.r as rc, q.r as rp from nn join f c on c.id = child join f q on q.id = parent where k = 1),
    v as (select *, unnest([0, 1, 2]) as move from e),
    m as (select *, rc * case when move = 1 then exp(1e-5) else 1 end as a, rp * case when move = 2 then exp(1e-5) else 1 end as b from v),
    k as (select *, power(a * b, 0.25) * power((a + b) / 2, -0.5) * exp(-sqrt(d2 / ((a + b) / 2))) * (1 + sqrt(d2 / ((a + b) / 2))) as c from m),
    h as (select child, parent, any_value(l) as l, any_value(yc) as yc, any_value(yp) as yp, max(c) filter (move = 0) as c, (max(c) filter (move = 1) - max(c) filter (move = 0)) / 1e-5 as d1, (max(c) filter (move = 2) - max(c) filter (move = 0)) / 1e-5 as d2 from k group by child, parent),
    g as (select *, c / 1.00001e0 as s, power(1.00001e0 - c * c / 1.00001e0, -0.5) as g from h),
    w as (select child as id, l, yc, yp, s, g, d1 as dc from g union all select parent, l, yc, yp, s, g, d2 from g),
    u as (select id, g * g * g * s * dc as dg, l, yc, yp, s, g, dc from w)
    select id, cast(0 as integer) as component, round(sum(l * (dg * yc - (dg * s + g * dc / 1.00001e0) * yp) + dg / g), 1) as grad from u group by id""")
def sandwich(spark, d):
    p = locs(spark, d)
    v = cut(_factor(spark, d, 1, grad=True))
    got = vecchia.sandwiches(v, p.select("id", F.col("x").alias("value")), p.select("id", F.col("y").alias("value")), 1, log_det=True)
    return got.select("id", "component", r("grad", 1).alias("grad"))


#: Two knots and a range for the bases below: with one neighbour each, SQL can say their rows.
KNOTS = np.array([[-0.5, -0.5], [0.5, 0.5]])
_NUG = "(1 + 1e-6)"
_MAT = "(1 + t) * exp(-t)"
_PP = f"""kd as (select {_MAT} as c from (select sqrt(2.0e0) / 2 as t)),
    ki as (select power({_NUG}, 0.5) as i1, c / {_NUG} as s2, power({_NUG} - c * c / {_NUG}, 0.5) as i2 from kd),
    kn as (select id, x, y, (x + 0.5) * (x + 0.5) + (y + 0.5) * (y + 0.5) as a, (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) as b from p),
    ks as (select id, x, y, a <= b as one, {_MAT} / {_NUG} as s from (select *, sqrt(least(a, b)) / 2 as t from kn)),
    phi as (select id, x, y, s * case when one then i1 else s2 * i1 end as f1, s * case when one then 0 else i2 end as f2 from ks, ki)"""
_LOSS = f"100 * greatest(0, {_NUG} - f1 * f1 - f2 * f2) / {_NUG}"


def _basis(spark, d) -> basis.PredictiveProcess:
    return basis.PredictiveProcess.fit(locs(spark, d).select("id", "x", "y"), 1, knots=KNOTS, matern_range=2.0)


@query(f"with {PTS}, {_PP} select 'location' as kind, id, round({_LOSS}, 6) as loss from phi union all select 'knot', unnest([1, 2]), 0.0")
def pp_variance_loss(spark, d):
    return _basis(spark, d).every_loss().select("kind", "id", F.abs(r("loss")).alias("loss"))


@query(f"with {PTS}, {_PP} select id, round(f1 + 2 * f2 + 3 + 4 * x, 8) as value0, round(5 * f1 - f2 - x, 8) as value1 from phi")
def pp_times(spark, d):
    x = rel.with_intercept(locs(spark, d))
    y = np.array([[3.0, 0.0], [4.0, -1.0], [1.0, 5.0], [2.0, -1.0]])
    return basis.times(y, x, ["intercept", "x"], _basis(spark, d)).select("id", r("value0", 8).alias("value0"), r("value1", 8).alias("value1"))


# ----------------------------------------------------------------------------- designs and regression


def _orders(spark, d) -> DataFrame:
    return T.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("z"))


@query("""select o_orderkey, 1.0e0 as intercept, case when o_orderpriority = '2-HIGH' then 1.0e0 else 0.0e0 end as p2, case when o_orderpriority = '3-MEDIUM' then 1.0e0 else 0.0e0 end as p3,
    case when o_orderpriority = '4-NOT SPECIFIED' then 1.0e0 else 0.0e0 end as p4, case when o_orderpriority = '5-LOW' then 1.0e0 else 0.0e0 end as p5 from orders""")
def model_matrix(spark, d):
    t, names = design.model_matrix(_orders(spark, d), factors=["o_orderpriority"])
    return t.select("o_orderkey", "intercept", *[F.col(f"`{n}`").alias(f"p{k + 2}") for k, n in enumerate(names[1:])])


@query(f"""with {OBS}, g as (select count(*) as n, sum(cov) as s1, sum(cov * cov) as s2, sum(z) as sz, sum(cov * z) as cz from o)
    select 'intercept' as i, 'intercept' as j, round(cast(n as double), 4) as value from g union all select 'intercept', 'cov', round(s1, 4) from g union all select 'cov', 'cov', round(s2, 4) from g
    union all select 'intercept', 'y', round(sz, 1) from g union all select 'cov', 'y', round(cz, 1) from g""")
def gram(spark, d):
    g = linalg.gram(rel.with_intercept(obs(spark, d)), ["intercept", "cov"], "z")
    return g.select("i", "j", F.when(F.col("j") == "y", r("value", 1)).otherwise(r("value", 4)).alias("value"))


@query(f"""with {OBS}, u as (select x, y, min(cov) = max(cov) as c, min(x) = max(x) as cx from o group by x, y) select cast(1 as integer) as intercept, cast(min(cast(c as integer)) as integer) as cov, cast(min(cast(cx as integer)) as integer) as x from u""")
def which_locs(spark, d):
    t = rel.with_intercept(obs(spark, d)).withColumns({"loc_id": F.struct("x", "y")})
    got = design.which_constant(t, ["intercept", "cov", "x"])
    return spark.createDataFrame([tuple(int(n in got) for n in ("intercept", "cov", "x"))], "intercept int, cov int, x int")


@query(f"with {OBS} select round(regr_intercept(z, cov), 3) as intercept, round(regr_slope(z, cov), 3) as slope from o")
def ols(spark, d):
    b = linalg.ols(rel.with_intercept(obs(spark, d)), ["intercept", "cov"], "z")
    return spark.createDataFrame([(round(float(b[0]), 3), round(float(b[1]), 3))], "intercept double, slope double")


@query(f"""with {PTS}, {NN_ALL}, b as (select regr_slope(y, x) as s, regr_intercept(y, x) as c from p), v as (select var_samp(y - c - s * x) as v from p, b),
    far as (select max(d2) as m from pr), near as (select quantile_cont(sqrt(d2), 0.5) as m from nn where k = 1)
    select round(ln(0.01 * v), 6) as sigma_min, round(ln(0.99 * v), 6) as sigma_max, round(-0.5 * ln(12) + ln(3 * near.m), 6) as alpha_min, round(-0.5 * ln(12) + ln(sqrt(far.m) / 8), 6) as alpha_max from v, far, near""")
def prior_params(spark, d):
    p = rel.with_intercept(locs(spark, d))
    b = linalg.ols(p, ["intercept", "x"], "y")
    v = p.agg(F.var_samp(F.col("y") - float(b[0]) - float(b[1]) * F.col("x"))).first()[0]
    near = posterior.quantiles(spatial.nearest_neighbours(p, 1, ordered=False).select(F.sqrt("d2").alias("d")), [], "d", {"near": 0.5}).first().near
    far = basis.diameter(p)
    pr = design.prior_bounds(v, far, near, 1.5)
    return spark.createDataFrame([tuple(round(float(c), 6) for c in (*pr.sigma, *pr.alpha))], "sigma_min double, sigma_max double, alpha_min double, alpha_max double")


@query(f"""with {OBS}, w as (select *, exp(-0.1e0 * x) as p, z - y * 1000 as t from o), g as (select sum(p) as a, sum(p * cov) as b, sum(p * cov * cov) as c, sum(p * t) as u, sum(p * cov * t) as v from w)
    select round((c * u - b * v) / (a * c - b * b), 3) as intercept, round((a * v - b * u) / (a * c - b * b), 3) as slope from g""")
def beta_centred_mean(spark, d):
    o = rel.with_intercept(obs(spark, d)).withColumns({"w": F.exp(-0.1 * F.col("x")), "t": F.col("z") - F.col("y") * 1000})
    g, v = linalg.gram_np(o, ["intercept", "cov"], "t", "w")
    b = np.linalg.solve(g, v)
    return spark.createDataFrame([(round(float(b[0]), 3), round(float(b[1]), 3))], "intercept double, slope double")


# ----------------------------------------------------------------------------- prediction and scores

_S = "s as (select id as sample, cast(id as double) / 10 as intercept, 1 - cast(id as double) / 20 as x from range(1, 21) t(id))"


def _samples(spark) -> DataFrame:
    return spark.range(1, 21).select(F.col("id").alias("sample"), (F.col("id").cast("double") / 10).alias("intercept"), (1 - F.col("id").cast("double") / 20).alias("x"))


@query(f"with {PTS}, {_S}, v as (select p.id as obs_id, s.intercept + p.x * s.x as value from p, s) {_summary_sql('obs_id', 'v')}")
def fixed_effects_pred(spark, d):
    dsg = rel.with_intercept(locs(spark, d)).withColumnRenamed("id", "obs_id")
    return _rounded(posterior.array_summary(posterior.fixed_effects(dsg, _samples(spark), ["intercept", "x"], "obs_id"), ["obs_id"]), ["obs_id"])


@query(f"with {PTS}, {_S}, v as (select p.id as obs_id, exp(s.intercept + p.x * s.x) as value from p, s) {_summary_sql('obs_id', 'v')}")
def noise_pred(spark, d):
    dsg = rel.with_intercept(locs(spark, d)).withColumnRenamed("id", "obs_id")
    v = posterior.fixed_effects(dsg, _samples(spark), ["intercept", "x"]).withColumn("values", F.transform("values", posterior.noise_variance))
    return _rounded(posterior.array_summary(v, ["obs_id"]), ["obs_id"])


def _predictive(spark, d) -> DataFrame:
    f = posterior.fixed_effects(rel.with_intercept(locs(spark, d)).withColumnRenamed("id", "obs_id"), _samples(spark), ["intercept", "x"])
    z = locs(spark, d).select(F.col("id").alias("obs_id"), F.col("y").alias("z"))
    return f.join(z, "obs_id").select("obs_id", "z", F.transform("values", lambda v: v + 0.1).alias("means"), F.transform("values", lambda v: F.lit(-1.0)).alias("log_noises"))


@query(f"""with {PTS}, {_S}, v as (select p.id as obs_id, p.y as z, s.intercept + p.x * s.x as value from p, s), h as (select obs_id, any_value(z) as z, count(*) as n, stddev_samp(value) as sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from v group by obs_id),
    b as (select *, 0.9e0 * case when iqr > 0 then least(sd, iqr / 1.34e0) else sd end * power(n, -0.2e0) as h from h)
    select v.obs_id, round(ln(avg(exp(-0.5e0 * power((v.z - v.value) / b.h, 2)) / (b.h * sqrt(2 * pi())))), 4) as kde_score from v join b on b.obs_id = v.obs_id group by v.obs_id""")
def kde_score(spark, d):
    f = posterior.fixed_effects(rel.with_intercept(locs(spark, d)).withColumnRenamed("id", "obs_id"), _samples(spark), ["intercept", "x"])
    z = locs(spark, d).select(F.col("id").alias("obs_id"), F.col("y").alias("z"))
    return posterior.kernel_score(f.join(z, "obs_id"), "obs_id").select("obs_id", r("kde_score", 4).alias("kde_score"))


_LL = "-0.5e0 * (ln(2 * pi()) + (-1.0e0) + (z - mean) * (z - mean) * exp(1.0e0))"
_PRED = f"v as (select p.id as obs_id, s.sample, p.y as z, 0.1e0 + s.intercept + p.x * s.x as mean from p, s)"


@query(f"with {PTS}, {_S}, {_PRED} select obs_id, round(ln(avg(exp({_LL}))), 6) as log_score from v group by obs_id")
def log_score(spark, d):
    return posterior.log_score(_predictive(spark, d)).select("obs_id", r("log_score").alias("log_score"))


@query(f"""with {PTS}, {_S}, {_PRED}, e as (select sample, sum({_LL}) as ll from v group by sample), a as (select obs_id, any_value(z) as z, avg(mean) as mean from v group by obs_id), b as (select sum({_LL}) as ll_ from a)
    select round(-2 * (2 * avg(ll) - any_value(ll_)), 4) as dic, round(any_value(ll_), 4) as ll_at_mean from e, b""")
def dic(spark, d):
    return posterior.dic(_predictive(spark, d)).select(r("dic", 4).alias("dic"), r("ll_at_mean", 4).alias("ll_at_mean"))


# ----------------------------------------------------------------------------- plots


@query(f"""with {PTS}, s as (select min(x) as lo, max(x) as hi from p), t as (select cast(id as integer) as tick, lo + (hi - lo) * id / 4 as v from s, range(5) t(id))
    select tick, case when v = 0 then 0.0 else round(v * power(10.0e0, 2 - floor(log10(abs(v)))), 0) / power(10.0e0, 2 - floor(log10(abs(v)))) end as value from t""")
def colour_scale(spark, d):
    return plotdata.colour_scale(locs(spark, d), "x")


@query(f"""with {PTS}, v as (select id, x, y, vx from p, range(50) t(vx)) select id, cast(vx as integer) as vertex,
    round(x + exp(0.5e0 * 2 * (-1.0e0 + 0.3e0 * x)) * 0.1e0 / 2.447747e0 * cos(vx * 2 * pi() / 50), 6) as vx, round(y + exp(0.5e0 * 2 * (-1.0e0 + 0.3e0 * x)) * 0.1e0 / 2.447747e0 * sin(vx * 2 * pi() / 50), 6) as vy from v""".replace("range(50) t(vx)", "range(50) t(vx)"))
def ellipses(spark, d):
    p = vecchia.log_range(_with_range(locs(spark, d)), BETA, ["intercept", "x"])
    return plotdata.ellipses(p).select("id", "vertex", r("vx").alias("vx"), r("vy").alias("vy"))


# ----------------------------------------------------------------------------- chains


def _model(v: np.ndarray, parents: np.ndarray) -> sampler.Data:
    """A model on locations, the rows of v: response from the third component, one covariate."""
    n = len(v)
    one = np.ones((n, 1))
    x = np.column_stack([one, v[:, 3]])
    return sampler.Data(v[:, :2], parents, np.arange(n), v[:, 2], x, x, [0, 1], one, one, one, means={"range": -2.0, "scale": -4.0, "noise": -5.0})


def _data(spark, d) -> sampler.Data:
    """The model on the locations of all vectors as arrays of this process; label 9 comes last. Queries make them in their tasks, see _places."""
    e = T.read(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    t = e.orderBy(F.col("label") == 9, "vec_id").select("label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4)]).toPandas()
    v = t[[f"e{k}" for k in range(4)]].to_numpy()
    xy, n = v[:, :2], len(v)
    parents = np.full((n, 6), -1, np.int64)
    parents[:, 0] = np.arange(n)
    near = spatial.nearest_neighbours(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double"), 5).toPandas()
    parents[near.child.to_numpy(), near.k.to_numpy()] = near.parent.to_numpy()
    data = _model(v, parents)
    data.n_observed = int((t.label != 9).sum())
    return data


def _places(spark, d) -> DataFrame:
    """(id, x, y, z, cov, near): the locations of all vectors, numbered from 0 with label 9 last, each with its five nearest of smaller numbers in their order."""
    e = T.read(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    component = lambda k: F.coalesce(F.col("embedding")[k].cast("double"), F.lit(float("nan")))
    e = e.select((F.col("label") == 9).alias("last"), "vec_id", *[component(k).alias(c) for k, c in enumerate(("x", "y", "z", "cov"))])
    p = cut(numbered(e, [F.col("last").asc(), F.col("vec_id").asc()]).select(F.col("rank").alias("id"), "x", "y", "z", "cov"))
    near = spatial.nearest_neighbours(p, 5).groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "parent"))).alias("near"))
    near = near.select("id", F.col("near.parent").alias("near"))
    return cut(p.join(near, "id", "left").select("id", "x", "y", "z", "cov", F.coalesce("near", F.expr("cast(array() as array<bigint>)")).alias("near")))


def _arrays(places: pa.Table) -> sampler.Data:
    """The model's arrays from the rows of _places in the order of id."""
    n, near = len(places), places.column("near").combine_chunks()
    size = near.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), size)
    parents = np.full((n, 6), -1, np.int64)
    parents[:, 0] = np.arange(n)
    parents[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = near.flatten().to_numpy()
    return _model(np.column_stack([places.column(c).to_numpy() for c in ("x", "y", "z", "cov")]), parents)


@query()
def gibbs_field(spark, d):
    """Records of two short chains with all kernels, a task each that makes its arrays of the table."""
    return sampler.run_chains_of(_places(spark, d), _arrays, 2, 10, with_field=False).where("state is null").drop("state")


@query()
def predict_field(spark, d):
    """The conditional mean at the locations of label 9, given the response at all others: by regions, a task each."""
    e = T.read(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    e = numbered(e, [(F.col("label") == 9).asc(), F.col("vec_id").asc()])
    one = F.array(F.lit(1.0))
    p = cut(e.select(F.col("rank").alias("id"), (F.col("label") == 9).alias("new"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z"))], one.alias("xr"), one.alias("xs")))
    n = p.where("not new").count()
    near = spatial.nearest_neighbours(p, 5, children=f"id >= {n}").select("child", "parent")
    field = p.where("not new").select(F.lit(0).alias("sample"), "id", F.col("z").alias("value"))
    got = regions.predict(p.where("new"), p.where("not new"), cut(near), field, [(np.array([[-1.0]]), np.array([[0.0]]), 0)], noise=False, region=256)
    return got.select("id", F.col("values")[0].alias("value"))


# ----------------------------------------------------------------------------- fields of any number of locations

# the tree of a factor with one neighbour each, its levels, and the matrix L'L / 4 + 10
_TREE = f"""{_L1}, t as (select p.id, m1.parent, coalesce(m1.l0, 1.0e0) as l0, m1.l1, p.y from p left join m1 on m1.child = p.id),
    lv as (with recursive w as (select id, 0 as depth from t where parent is null union all select t.id, w.depth + 1 from t join w on t.parent = w.id) select * from w),
    q as (select t.id, t.parent, t.y, lv.depth, t.l0 * t.l0 / 4 + coalesce(c.s, 0) / 4 + 10 as own, t.l0 * t.l1 / 4 as up
          from t join lv on lv.id = t.id left join (select parent, sum(l1 * l1) as s from t where parent is not null group by parent) c on c.parent = t.id)"""
# eliminated from the deepest level up: what is left of the diagonal and of the right-hand side; then solved from the root down
_MEAN = f"""{_TREE}, e as (with recursive w as (
      select id, parent, depth, own as left_own, y as left_y, up from q where depth = (select max(depth) from q)
      union all
      select q.id, q.parent, q.depth, q.own - coalesce(c.a, 0), q.y - coalesce(c.b, 0), q.up
      from q left join (select parent, sum(up * up / left_own) as a, sum(up * left_y / left_own) as b from w group by parent) c on c.parent = q.id
      where q.depth = (select max(depth) from w) - 1) select * from w),
    x as (with recursive w as (select id, left_y / left_own as value from e where parent is null
      union all select e.id, (e.left_y - e.up * w.value) / e.left_own from e join w on e.parent = w.id) select * from w)"""


@query(f"""with {PTS}, {NN_BEFORE}, {_TREE}, w as (with recursive w as (select id, y / l0 as value from t where parent is null
    union all select t.id, (t.y - t.l1 * w.value) / t.l0 from t join w on t.parent = w.id) select * from w) select id, round(value, 3) + 0.0e0 as value from w""")
def field_solve(spark, d):
    """L^-1 y for the factor with one neighbour each, by bands of levels."""
    p, v = locs(spark, d), cut(_factor(spark, d, 1))
    level = triangular.levels(v.select(F.col("child").alias("row"), F.explode("parents").alias("col")), p.select("id"))
    t = triangular.Triangular.of(v, level)
    x = t.solve(p.select("id", F.col("y").alias("value")))
    t.close()
    return x.select("id", (r("value", 3) + 0.0).alias("value"))


def _sites(p: DataFrame) -> DataFrame:
    return p.select("id", F.lit(2.0).alias("sd"), F.lit(10.0).alias("precision"))


@query(f"with {PTS}, {NN_BEFORE}, {_MEAN} select id, round(value, 6) + 0.0e0 as value from x")
def posterior_mean_gradients(spark, d):
    """Q^-1 y by conjugate gradients over tables, Q as in posterior_precision."""
    p, v = locs(spark, d), cut(_factor(spark, d, 1))
    level = v.select(F.col("child").alias("id"), F.lit(0).alias("level"))  # products need none
    x = fieldtables.conjugate_gradient(fieldtables.TableFactor(v, level), _sites(p), p.select("id", F.col("y").alias("value")), fieldtables.blocks_of(p), tol=1e-10, locs=p)
    return x.select("id", (r("value") + 0.0).alias("value"))


@query(f"with {PTS}, {NN_BEFORE}, {_MEAN} select x.id, round(x.value, 6) + 0.0e0 as value, round((select sum(ln(left_own)) from e), 3) as log_det from x")
def posterior_mean_cholesky(spark, d):
    """The same by a sparse Cholesky factor, with its log determinant."""
    p = locs(spark, d)
    q = linalg.posterior_precision(_entries(spark, d), p.select("id", F.lit(2.0).alias("sd")), p.select("id", F.lit(10.0).alias("value")))
    c = cholesky.Cholesky.of(cut(q), p, p.select("id", F.col("y").alias("value")), leaf=128)
    return c.solve().select("id", (r("value") + 0.0).alias("value"), F.lit(round(c.log_det, 3)).alias("log_det"))


def field_tables(spark, d, **how) -> tuple[fieldtables.FieldTables, DataFrame]:
    """(model, its observations): the first two components of the vectors are places, the third is observed, the fourth a covariate."""
    e = T.read(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    e = cut(e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "cov"))], F.lit(1.0).alias("one")))
    means = {"range": -2.0, "scale": -4.0, "noise": -5.0}
    near = spatial.nearest_neighbours(e, 5)
    obs = e.select(F.col("id").alias("loc"), "z", "one", "cov")
    return fieldtables.FieldTables.build(obs, e, near, ["one", "cov"], ["one"], ["one", "x"], ["one"], {"one": 0, "cov": 1}, means=means, **how), e


def table_state(model: fieldtables.FieldTables, field: DataFrame) -> sampler.State:
    """A state to start from: prior means, and a field(id, value)."""
    s = sampler.State(np.array([0.0, 0.0]), np.array([[-2.0], [0.0]]), np.array([[-4.0]]), np.array([[-5.0]]), field)
    s.factor = model.factor(s.range_beta)
    return s


@query()
def field_draw(spark, d):
    """A draw of the field given the observations, by conjugate gradients over tables."""
    model, e = field_tables(spark, d)
    s = table_state(model, e.select("id", F.col("z").alias("value")))
    return model.posterior_field(s, np.random.default_rng(1))


@query()
def field_draw_cholesky(spark, d):
    """A draw from the same distribution by a sparse Cholesky factor of its precision."""
    model, e = field_tables(spark, d)
    s = table_state(model, e.select("id", F.col("z").alias("value")))
    sums = model.location_sums(s)
    q = linalg.posterior_precision(s.factor.entries("row"), model.with_sd(s).select("id", "sd"), sums.select("id", F.col("s0").alias("value")))
    return cholesky.Cholesky.of(cut(q), e.select("id", "x", "y"), sums.select("id", F.col("s1").alias("value"))).solve(seed=3)


@query()
def colour_sweep(spark, d):
    """A sweep over the field by colours of its neighbour graph, from the observations on."""
    model, e = field_tables(spark, d)
    s = table_state(model, e.select("id", F.col("z").alias("value")))
    sums = model.location_sums(s)
    q = cut(linalg.posterior_precision(s.factor.entries("row"), model.with_sd(s).select("id", "sd"), sums.select("id", F.col("s0").alias("value"))))
    update = chromatic.ColourUpdate(q, chromatic.colouring(spatial.moral_graph(model.nn_self), e.select("id")))
    out = update.sweep(s.field, sums.select("id", F.col("s1").alias("value")), seed=3)
    update.close()
    return out


@query()
def range_step(spark, d):
    """The range coefficients and the field after both Hamiltonian steps of the range, from the observations on; the field stays a table."""
    model, e = field_tables(spark, d)
    s = table_state(model, e.select("id", F.col("z").alias("value")))
    sampler.range_hmc(s, model, 1, np.random.default_rng(2))
    rows = [("range_beta", k, float(v)) for k, v in enumerate(s.range_beta[:, 0])] + [(f"log_step_{k}", 0, float(v[0])) for k, v in sorted(s.steps.items()) if k.startswith("range_beta")]
    return spark.createDataFrame(rows, "param string, id long, value double").unionByName(s.field.select(F.lit("field").alias("param"), "id", "value"))


@query()
def table_chain(spark, d):
    """Records of a short chain with all kernels whose field and observations stay tables."""
    model, _ = field_tables(spark, d, tolerance=1e-6)
    return fieldtables.run_chain(model, 1, 1)[1]


@query(f"with {REC}, l as (select max(iteration) as last from rec) select chain, iteration, i, value from rec, l where iteration > last * 0.5e0")
def log_scale_trace(spark, d):
    return plotdata.log_scale_trace(records(spark, d)).select("chain", "iteration", "i", "value")


@query(f"with {PTS} select id, row_number() over (order by md5('7:' || cast(id as varchar)), id) as rank from p")
def random_order(spark, d):
    return rel.random_order(locs(spark, d).select("id", "x", "y"), "id", 7).select("id", "rank")


@query(f"""with {PTS}, {_PP}, v as (select [sum(p.y), sum(p.x * p.y), sum(f1 * p.y), sum(f2 * p.y)] as v from phi join p on p.id = phi.id)
    select cast(k as integer) as row, round(v[k + 1], 6) as value from v, range(4) t(k)""")
def pp_crossprod(spark, d):
    v = linalg.crossprod(rel.with_intercept(locs(spark, d)), ["intercept", "x"], "y", _basis(spark, d))
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(v)], "row int, value double")


@query(f"with {REC}, {_COMP}, {_PSRF_C} select comp as i, cast(e as integer) as e, round(psrf, 6) as psrf from curve")
def psrf_components(spark, d):
    return plotdata.psrf_lines(diagnostics.psrf(_numbered(spark, d), by=["comp"])).select(F.col("comp").alias("i"), "e", r("psrf").alias("psrf"))


@query(f"""with {PTS}, {_PP}, l as (select id, x, y, {_LOSS} as loss from phi),
    m as (select *, row_number() over (order by loss, id) as draw, case when loss >= 0 and loss <= 1 then '[0,1]' when loss <= 2 then '(1,2]' when loss <= 5 then '(2,5]' when loss <= 10 then '(5,10]' when loss <= 50 then '(10,50]' when loss <= 100 then '(50,100]' end as bin from l)
    select 'location' as kind, id, x, y, round(loss, 6) as loss, bin, draw from m
    union all select 'knot', k, case when k = 1 then -0.5 else 0.5 end, case when k = 1 then -0.5 else 0.5 end, null, null, (select count(*) from p) + k from range(1, 3) t(k)""")
def variance_loss_map(spark, d):
    return plotdata.knot_map(_basis(spark, d), locs(spark, d).select("id", "x", "y")).withColumn("loss", r("loss"))


def _lattice_index(spark, d):
    from terrafield.model import SpatialIndex

    o = obs(spark, d).select((F.col("x") / 50).alias("x"), (F.col("y") * 10).alias("y"), (F.col("z") / 10_000).alias("z"), "cov")
    return SpatialIndex.build(cut(o.withColumn("obs_id", F.monotonically_increasing_id())), m=5)


@query()
def model_estimates(spark, d):
    """A model of all replicated observations, end to end: index, designs, priors, two chains, posterior summaries."""
    from terrafield.model import Model

    return Model.build(_lattice_index(spark, d), covariates=["cov"]).run(6).estimate()


@query()
def distributed_chain(spark, d):
    """Records of a chain whose observations stay on the cluster; the driver holds arrays of the locations' size."""
    from terrafield.operators.distributed import ObservationTable

    index = _lattice_index(spark, d)
    xy = np.array(index.locs.orderBy("id").select("x", "y").toPandas(), float)
    one = np.ones((len(xy), 1))
    table = index.obs.select((F.col("loc_id") - 1).alias("loc"), "z", F.lit(1.0).alias("intercept"), "cov")
    data = ObservationTable.of(table, xy, index.parents(), one, [0], one, one, ["intercept", "cov"], ["intercept"])
    rows = sampler.run_chain(data, 1, 3, with_field=False)[1]
    data.table.unpersist()
    return spark.createDataFrame(rows, sampler.RECORDS)
