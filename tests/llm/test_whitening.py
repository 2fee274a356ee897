"""Whitening against eigenvectors of the exact covariance, and odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from terrafield.llm import whitening

SF = "/root/testdata/sf0.001"


def _expected(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, fit, n, s, e[::-1], v[:, ::-1]


def test_whitened_rows_equal_the_covariance_route(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    copies = df.limit(20).unionByName(df)
    rows = copies.collect()
    x, fit, n, s, e, v = _expected([r.embedding for r in rows])
    got = whitening.whiten(copies).collect()
    assert len(got) == 16 * len(rows)
    want = (x - s / n) @ v[:, :16] / np.sqrt(e[:16])
    at = {}
    for k, r in enumerate(rows):
        at.setdefault(r.vec_id, k)
    sign = {}
    for r in got:
        k, j = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(x[k], s))
        sign.setdefault(j, np.sign(r.whitened * want[k, j]))
        assert r.whitened == pytest.approx(sign[j] * want[k, j], abs=1e-9)
        assert r.explained == pytest.approx(e[j] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_tree_merges_many_parts(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(40)
    a = {(r.vec_id, r.component): r for r in whitening.whiten(df, components=3).collect()}
    b = {(r.vec_id, r.component): r for r in whitening.whiten(df.coalesce(1), components=3).collect()}
    assert a.keys() == b.keys()
    flip = {j: np.sign(a[0, j].whitened * b[0, j].whitened) for j in (1, 2, 3)}
    assert all(a[k].whitened == pytest.approx(flip[k[1]] * b[k].whitened, abs=1e-9) for k in a)


FIELDS = "vec_id long, embedding array<double>, x string, id string, `a.b` string"


def _frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in vectors], FIELDS)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.0, 1.0, 0.5]), (1, [0.0, 1.0, 0.5]), (None, [1.0, -1.0, 0.5]), (3, [2.0, 0.25, 0.5]), (4, [-1.0, 3.0, 0.5])]
    bad = [(5, None), (6, [None, 1.0, 2.0]), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1e300, 0.0, 0.0]), (10, []), (11, [1.0, 2.0])]
    rows = whitening.whiten(_frame(spark, good + bad)).collect()
    assert sorted((r.vec_id or -1, r.component) for r in rows) == sorted((i or -1, k) for i, _ in good for k in (1, 2, 3))
    assert {r.n for r in rows} == {4} and all((r.whitened is None) == (r.component == 3) for r in rows)  # the third entry never varies
    x = [[64 * a + 10**6 for a in v] for _, v in (good[0], *good[2:])]
    for r in rows:
        if r.vec_id == 3:
            assert r.deviation == sum((4 * Fraction(x[2][k]) - sum(Fraction(v[k]) for v in x)) ** 2 for k in range(3))
    assert rows[0].identity_error < 1e-12


def test_degenerate_tables(spark):
    assert whitening.whiten(_frame(spark, [(1, [1.0, 2.0])]).where("false")).count() == 0
    assert whitening.whiten(_frame(spark, [(1, None), (2, [])])).count() == 0
    rows = whitening.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in rows)


def test_sums_beyond_longs_are_exact(spark):
    big = 2.0**52
    rows = whitening.whiten(_frame(spark, [(k, [big * (k + 1), -big]) for k in range(3)])).collect()
    n, x = 3, [64 * int(big) * (k + 1) + 10**6 for k in range(3)]
    for r in rows:
        d = (n * x[r.vec_id] - sum(x)) ** 2
        assert r.deviation == (d if d < 1 << 63 else None)
    c = whitening.Centre(3, [sum(x), 3 * x[0]], max(x))
    assert c.shifted(np.array([[x[0], x[0]]]))[0].tolist() == [3 * x[0] - sum(x), 0]
