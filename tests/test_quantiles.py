import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.plans import quantiles
from tablescope.plans.quantiles import Positive, Quantiles, SketchKind, exact_quantiles

PS = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


def expected(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


def test_quartiles(one):
    assert exact_quantiles(one([4.0, 1.0, 3.0, 2.0], "double"), F.col("x"), [0.25, 0.5, 0.75]) == [1.75, 2.5, 3.25]


def test_empty_and_missing(one):
    assert exact_quantiles(one([None, None], "double"), F.col("x"), [0.5]) == [None]
    assert exact_quantiles(one([None, 3.0], "double"), F.col("x"), [0.5, 0.99]) == [3.0, 3.0]


@pytest.fixture
def small_sketches(monkeypatch):
    """Tiny sketches, so that a small table needs many narrowing scans."""
    monkeypatch.setattr(quantiles, "OPENING", SketchKind(100, 0.05))
    monkeypatch.setattr(quantiles, "NARROWING", SketchKind(200, 0.02))


@pytest.mark.parametrize("shape", ["unique", "hot value", "two values", "hot ends", "integers"])
def test_narrowing_is_exact(spark, small_sketches, shape):
    rng = random.Random(7)
    n = 6000
    values = {
        "unique": [rng.gauss(0, 1e6) for _ in range(n)],
        "hot value": [5.0 if rng.random() < 0.4 else rng.random() * 10 for _ in range(n)],
        "two values": [1.0 if rng.random() < 0.5 else 2.0 for _ in range(n)],
        "hot ends": [0.0 if rng.random() < 0.3 else 9.0 if rng.random() < 0.4 else rng.random() * 9 for _ in range(n)],
        "integers": [float(rng.randrange(40)) for _ in range(n)],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    assert exact_quantiles(df, F.col("x"), PS) == pytest.approx([expected(values, p) for p in PS], rel=1e-12)


def test_missed_proposals_are_noticed(spark, small_sketches, monkeypatch):
    """With a margin far below the sketch error most proposals miss; the counts must catch that."""
    monkeypatch.setattr(quantiles, "OPENING", SketchKind(100, 1e-6))
    monkeypatch.setattr(quantiles, "NARROWING", SketchKind(200, 1e-6))
    rng = random.Random(1)
    values = [rng.random() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    assert exact_quantiles(df, F.col("x"), PS) == pytest.approx([expected(values, p) for p in PS], rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=60))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, F.col("x"), [0.25, 0.5, 0.99]) == pytest.approx([expected(values, p) for p in (0.25, 0.5, 0.99)], rel=1e-9, abs=1e-9)


def test_positive_values_are_ranks_of_the_same_search(spark, small_sketches):
    rng = random.Random(3)
    rows = [(0.0 if rng.random() < 0.5 else rng.gauss(0, 100), float(-i), None if i % 3 else 1.0 * i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = Quantiles({n: (F.col(n), (0.25, Positive(0.5), Positive(0.9))) for n in "abc"}).solve(df)
    for i, n in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None]
        positive = [v for v in values if v > 0]
        want = [expected(values, 0.25), *([expected(positive, 0.5), expected(positive, 0.9)] if positive else [None, None])]
        assert got[n] == [w if w is None else pytest.approx(w, rel=1e-12) for w in want]


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_columns(spark, monkeypatch):
    """A profile of 12 columns and one of 48: the same number of jobs, also where quantiles need more scans."""
    from tablescope.plans.profile import QUALITY_QUANTILES, profile
    from tablescope.plans.quality import numeric_health

    monkeypatch.setattr(quantiles, "OPENING", SketchKind(1000, 0.05))
    one = spark.range(20_000).repartition(4)
    wide = {n: one.select(*[((F.col("id") * 7919) % 20_011 + i).cast("double").alias(f"x{i}") for i in range(n)]) for n in (12, 48)}
    counts = {n: jobs_of(spark, f"columns {n}", lambda d=d: numeric_health(profile(d, quantiles=QUALITY_QUANTILES)).collect()) for n, d in wide.items()}
    assert counts[12] == counts[48] > 3
