"""Recipes: statistics of many steps found together, the same results as step by step."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import cleaning
from tablescope.plans import recipe
from tablescope.plans.quantiles import approximate_quantile
from tablescope.plans.recipe import Recipe


@pytest.fixture
def untidy(spark):
    rng = random.Random(9)
    rows = [
        (i, None if i % 7 == 0 else rng.gauss(50, 20), None if i % 5 == 0 else rng.choice(["a", "b", "b ", "c"]), None if i % 11 == 0 else rng.randrange(40), rng.choice([None, "x", "y"]), float(rng.randrange(1, 100)))
        for i in range(700)
    ]
    return spark.createDataFrame(rows + rows[:30], "id long, v double, label string, n int, kind string, pay double").repartition(3)


STEPS = [
    ("fill_missing", {"name": "v", "strategy": "median"}),
    ("trim_whitespace", {"name": "label"}),
    ("fill_missing", {"name": "label", "strategy": "mode"}),
    ("drop_missing_rows", {"name": "kind"}),
    ("fill_missing", {"name": "n", "strategy": "mean"}),
    ("log_transform", {"name": "pay"}),
    ("standard_scale", {"name": "v"}),
    ("one_hot_encode", {"name": "kind"}),
    ("minmax_scale", {"name": "pay_log"}),
]


def built(steps):
    made = Recipe()
    for operation, arguments in steps:
        made = made.then(operation, **arguments)
    return made


@pytest.fixture
def searches(monkeypatch):
    calls, plain = [], recipe.answers
    monkeypatch.setattr(recipe, "answers", lambda df, requests: calls.append(len(requests)) or plain(df, requests))
    return calls


def rows_of(df):
    return sorted(map(repr, df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()))


def test_one_search_for_a_run_of_steps(untidy, searches):
    df = untidy
    for operation, arguments in STEPS:  # each bound alone, on the rows it sees
        df = recipe.OPERATIONS[operation](df, **arguments).df
    made = built(STEPS)
    got = made.run(untidy)
    assert got.columns == df.columns and rows_of(got) == rows_of(df)
    # v is asked for once more after it is filled; pay_log exists only then
    assert searches == [5, 2]


def test_steps_behind_removed_duplicates_are_a_new_run(untidy, searches):
    steps = [STEPS[0], ("remove_duplicates", {}), ("fill_missing", {"name": "n", "strategy": "mode"}), ("drop_missing_rows", {}), STEPS[5]]
    df = untidy
    for operation, arguments in steps:
        df = recipe.OPERATIONS[operation](df, **arguments).df
    assert rows_of(built(steps).run(untidy)) == rows_of(df) and searches == [1, 1, 1]


def test_rows_dropped_by_a_filled_column(untidy, searches):
    """Filled cells are there when their rows would be dropped: the step waits for the fill."""
    steps = [("fill_missing", {"name": "v", "strategy": "mean"}), ("drop_missing_rows", {"name": "v"}), ("fill_missing", {"name": "n", "strategy": "median"})]
    got = built(steps).run(untidy)
    assert got.count() == untidy.count() and searches == [1, 1]


def test_renamed_and_missing_columns(untidy, searches):
    steps = [("rename_column", {"old": "v", "new": "w"}), ("fill_missing", {"name": "w", "strategy": "mean"}), ("rename_column", {"old": "w", "new": "z"}), ("standard_scale", {"name": "z"}), ("fill_missing", {"name": "v", "strategy": "mean"})]
    results = built(steps).bind(untidy)
    assert results[-1].refused and "z_scaled" in results[-1].df.columns and results[-1].df.where("z IS NULL").count() == 0
    assert searches == [1, 1]


def test_modes_keep_the_order_of_their_type(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a"), (None, None)], "n int, s string")
    made = Recipe().then("fill_missing", name="n", strategy="mode").then("fill_missing", name="s", strategy="mode")
    assert sorted(map(tuple, made.run(df).collect())) == [(9, "a"), (9, "b"), (10, "a")]


def test_decimals_stay_decimal(spark):
    df = spark.sql("SELECT CAST(v AS DECIMAL(20, 2)) AS d FROM VALUES ('1.10'), ('2.25'), ('90071992547409931.11'), (NULL) AS t(v)")
    for strategy in ("median", "mean", "mode"):
        got = cleaning.fill_missing(df, "d", strategy).df
        assert got.dtypes == [("d", "decimal(20,2)")]
        assert decimal.Decimal("90071992547409931.11") in [r.d for r in got.collect()] and got.where("d IS NULL").count() == 0
    assert sorted(r.d for r in cleaning.fill_missing(df, "d", "median").df.collect())[1] == decimal.Decimal("2.25")


def test_nested_columns_are_refused(spark):
    df = spark.sql("SELECT array(1) AS l, map('a', 1) AS m, named_struct('x', 1) AS s UNION ALL SELECT NULL, NULL, NULL")
    for name in df.columns:
        step = cleaning.fill_missing(df, name, "mode")
        assert step.refused and "nested" in step.message


@pytest.mark.parametrize("shape", ["spread", "hot", "two"])
def test_approximate_median_keeps_its_bound(spark, shape):
    rng = random.Random(2)
    values = [{"spread": rng.random(), "hot": 5.0 if rng.random() < 0.6 else rng.random(), "two": float(rng.random() < 0.5)}[shape] for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    for bound in (0.01, 1e-9):
        found = approximate_quantile(df, F.col("x"), 0.5, bound)
        ranks = [k for k, v in enumerate(sorted(values)) if v == found.value] or [sorted(values).index(min(values, key=lambda v: abs(v - found.value)))]
        assert min(abs(k - (len(values) - 1) / 2) for k in ranks) <= bound * len(values) + 1 and found.rank_error <= bound
    assert approximate_quantile(df.where("false"), F.col("x"), 0.5, 0.1).value is None
    filled = cleaning.fill_missing(df, "x", "median", rank_error=0.01).df
    assert filled.where("x IS NULL").count() == 0


AUDITED = [STEPS[0], STEPS[1], STEPS[3], ("remove_duplicates", {}), ("fill_missing", {"name": "n", "strategy": "constant", "value": 0}), ("drop_column", {"name": "pay"})]


def test_audit_beside_a_write(spark, untidy, tmp_path):
    made, path = built(AUDITED), str(tmp_path / "clean")
    results = made.bind(untidy)
    want = made.audit(untidy).collect()
    assert want[3].rows_before > want[3].rows_after and want[0].cells_changed > 50

    frames = []
    spark.sparkContext.setJobGroup("write alone", "")
    results[-1].df.write.parquet(str(tmp_path / "alone"))
    alone = len(spark.sparkContext.statusTracker().getJobIdsForGroup("write alone"))

    def write(df):
        frames.append(df.columns)
        spark.sparkContext.setJobGroup("beside", "")
        df.write.parquet(path)

    got = made.audit_beside(untidy, write)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("beside"))
    spark.sparkContext.setJobGroup("", "")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    assert jobs == alone and frames == [results[-1].df.columns]
    assert rows_of(spark.read.parquet(path)) == rows_of(results[-1].df)


def test_audit_beside_a_write_of_no_rows_and_of_no_steps(spark, untidy, tmp_path):
    got = built(AUDITED).audit_beside(untidy.where("false"), lambda df: df.write.parquet(str(tmp_path / "none"))).collect()
    assert [(r.rows_before, r.rows_after, r.cells_changed) for r in got] == [(0, 0, 0)] * len(AUDITED)
    assert Recipe().audit_beside(untidy, lambda df: df.write.format("noop").mode("overwrite").save()).collect() == []
