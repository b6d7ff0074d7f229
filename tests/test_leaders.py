"""Most frequent values by a sketch that proposes and a scan that proves."""

import collections
import random

import pytest

from tablescope.plans import leaders as L


def brute(rows, n):
    counts = collections.Counter(v for v, _ in rows if v is not None)
    top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    mean = lambda v: (lambda xs: sum(xs) / len(xs) if xs else None)([m for w, m in rows if w == v and m is not None])
    return [(v, c, mean(v)) for v, c in top]


def check(spark, rows, n=5, kind="string"):
    df = spark.createDataFrame(rows, f"`a.b` {kind}, m double").repartition(5)
    found = L.leaders(df, "a.b", n, "m")
    want = brute(rows, n)
    assert [(r.value, r["count"]) for r in found.rows] == [w[:2] for w in want] and found.n_rows == len(rows)
    assert [r.mean for r in found.rows] == [w[2] if w[2] is None else pytest.approx(w[2]) for w in want]
    return found


def test_frequent_values_are_proved(spark, monkeypatch):
    monkeypatch.setattr(L, "TRACKED", 256)
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else f"hot{int(rng.paretovariate(1)) % 9}" if rng.random() < 0.7 else f"rare{i}", rng.random() if i % 3 else None) for i in range(20_000)]
    assert check(spark, rows).proved


def test_a_flat_column_falls_back_to_all_values(spark, monkeypatch):
    monkeypatch.setattr(L, "TRACKED", 64)
    rows = [(f"v{i % 3000:04}", float(i)) for i in range(6000)] + [("v2999", 1.0)]
    assert not check(spark, rows).proved


def test_ties_are_in_value_order_or_not_proved(spark, monkeypatch):
    monkeypatch.setattr(L, "TRACKED", 64)
    rng = random.Random(2)
    rows = [(i % 400, 1.0) for i in range(4000)] + [(7, 2.0)] * 900
    rng.shuffle(rows)
    check(spark, rows, 3, "int")


def test_few_values_and_none(spark):
    assert check(spark, [("b", 1.0), ("a", 2.0), (None, 3.0), ("b", None)]).proved
    assert check(spark, [(None, 1.0)] * 4).rows == []
    df = spark.createDataFrame([], "v string")
    assert L.leaders(df, "v", 3) == L.Leaders([], 0, True)


def test_nested_values_are_grouped(spark):
    df = spark.sql("SELECT array(id % 3) AS v FROM range(10)")
    found = L.leaders(df, "v", 1)
    assert not found.proved and [(r.value, r["count"]) for r in found.rows] == [([0], 4)]


def test_two_scans(spark):
    """The table is read twice, and no shuffle has more rows than the sketches or the candidates."""
    from tablescope.plans.insights import topn_segments
    from tablescope.plans.semantic import Table

    df = spark.range(5000).selectExpr("cast(id % 90 AS string) AS code", "cast(id AS double) AS price")
    spark.sparkContext.setJobGroup("two scans", "")
    row = topn_segments(Table(df, {"code": "high_cardinality", "price": "financial"}), "code").collect()[0]
    spark.sparkContext.setJobGroup("", "")
    assert (row.top_value, row.top_count) == ("0", 56)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("two scans")) <= 8
