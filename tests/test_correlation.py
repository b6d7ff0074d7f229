"""Correlations and variance inflation against numpy."""

import random

import numpy as np
import pytest

from tablescope.plans.correlation import correlations, inflation, variance_inflation


def table(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(5, 2)
        rows.append((a, None if i % 9 == 0 else b, 2 * a - b + rng.gauss(0, 0.3), float("nan") if i % 13 == 0 else rng.random(), 7.0, "t"))
    return rows, spark.createDataFrame(rows, "a double, `b.x` double, c double, d double, k double, t string")


def test_pairs(spark):
    rows, df = table(spark)
    x = np.array([[np.nan if v is None else v for v in r[:5]] for r in rows])
    got = {(r.column_a, r.column_b): r for r in correlations(df).collect()}
    names = ["a", "b.x", "c", "d", "k"]
    assert len(got) == 10
    for (p, q), r in got.items():
        i, j = names.index(p), names.index(q)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r.n_rows == both.sum()
        assert r.correlation is None if "k" in (p, q) else r.correlation == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])


def test_inflation(spark):
    rows, df = table(spark)
    x = np.array([[np.nan if v is None else v for v in r[:4]] for r in rows])
    x = x[~np.isnan(x).any(axis=1)]
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    got = variance_inflation(df, ["a", "b.x", "c", "d"]).collect()
    assert [r.vif for r in got] == [pytest.approx(v) for v in want] and {r.n_rows for r in got} == {len(x)} and got[2].vif > 10
    with_constant = {r.column: r.vif for r in variance_inflation(df, ["a", "d", "k"]).collect()}
    assert with_constant["k"] is None and with_constant["a"] == pytest.approx(1, abs=0.1)


def test_columns_given_by_others(spark):
    df = spark.range(100).selectExpr("cast(id AS double) AS a", "cast(pow(id, 2) AS double) AS b", "cast(3 * id + 1 AS double) AS c", "cast(id % 7 AS double) AS e")
    got = {r.column: r.vif for r in variance_inflation(df).collect()}
    assert got["a"] is None and got["c"] is None and got["b"] > 1 and got["e"] == pytest.approx(1, abs=0.2)
    assert inflation(np.eye(1)) == [1.0]


def test_few_columns_and_no_rows(spark):
    one = spark.createDataFrame([(1.0, "x")], "a double, s string")
    assert correlations(one).collect() == [] and [tuple(r) for r in variance_inflation(one).collect()] == [(0, "a", 1, 1.0)]
    empty = spark.createDataFrame([], "a double, b double")
    assert [(r.n_rows, r.correlation) for r in correlations(empty).collect()] == [(0, None)] and [r.vif for r in variance_inflation(empty).collect()] == [None, None]
