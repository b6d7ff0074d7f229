import pytest

from tablescope.plans import quality
from tablescope.plans.duplicates import count_copies, preview_copies, row_groups
from tablescope.plans.profile import missing_profile, profile
from tablescope.plans.semantic import Table, detect


def test_nan_null_and_signed_zero_are_one_value(one):
    from tablescope.functions.columns import nan_to_null

    assert count_copies(nan_to_null(one([None, float("nan"), 0.0, -0.0], "double"))) == 2


def test_copies(spark):
    df = spark.createDataFrame([(i % 7, "a" if i % 2 else None) for i in range(30)] + [(99, "z")], "i int, s string")
    assert count_copies(df) == 31 - 15


def test_equal_digests_alone_are_not_copies(spark):
    # NULLs do not enter a hash of values alone.
    df = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert count_copies(df) == 0
    assert count_copies(spark.sql("SELECT array(1, null) l UNION ALL SELECT array(null, 1) UNION ALL SELECT array(1, null)")) == 1


def test_removing_duplicates_starts_no_job(spark):
    from tablescope.operators.cleaning import remove_duplicates

    df = spark.createDataFrame([(1, 0.0), (1, -0.0), (2, -0.0)], "a int, x double")
    spark.sparkContext.setJobGroup("lazy", "")
    step = remove_duplicates(df).df
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("lazy") == []
    spark.sparkContext.setJobGroup("", "")
    assert step.count() == 2


def test_copies_of_nested_rows(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m, array(1, 2) l UNION ALL SELECT map('b', 2, 'a', 1), array(1, 2)")
    assert count_copies(df) == 1
    assert row_groups(df, df.columns).count() == 1


def test_copies_of_maps_inside_structs(spark):
    df = spark.sql("SELECT named_struct('m', map('a', 1)) s, 1 i UNION ALL SELECT named_struct('m', map('a', 1)), 1 UNION ALL SELECT NULL, 1")
    assert count_copies(df) == 1


def test_preview_orders_copies_and_needs_no_group_whole(spark):
    rows = [(i, "hot", 1) for i in range(500)] + [(1000 + i, f"v{i // 2}", 0) for i in range(10)] + [(2000, "single", 0)]
    df = spark.createDataFrame(rows, "row_id long, s string, n int")
    found = [tuple(r) for r in preview_copies(df, "row_id", 50).collect()]
    assert found == [(i, "hot", 1) for i in range(50)]


def test_empty_missing_and_single_row_tables(spark):
    empty = spark.createDataFrame([], "x double, s string")
    row = quality.score_dataset(Table(empty, {"x": "metric", "s": "categorical"})).collect()[0]
    assert (row.n_rows, row.score, row.grade) == (0, 100.0, "Excellent")
    nothing = spark.createDataFrame([(None, None)] * 4, "x double, s string")
    row = quality.score_dataset(Table(nothing, {})).collect()[0]
    assert (row.missing_penalty, row.duplicate_penalty, row.score) == (30.0, 20.0, 50.0)
    single = spark.createDataFrame([(1.0, "a")], "x double, s string")
    assert quality.score_dataset(Table(single, {})).collect()[0].score == 100.0
    # Too few values for a skew: shown as very uneven, yet healthy.
    health = quality.column_health(Table(single, {"x": "metric", "s": "categorical"})).collect()[0]
    assert (health.value_spread, health.status) == ("Very Uneven", "Healthy")


def test_extreme_maximum_is_flagged(spark):
    df = spark.createDataFrame([(float(i % 1000),) for i in range(2000)] + [(125_000_000.0,)], "amount double")
    row = quality.numeric_health(profile(df)).collect()[0]
    assert row.is_extreme and row.is_highly_skewed and row.outlier_count == 1
    texts = [r.message for r in quality.findings(Table(df, {})).collect()]
    assert any("'amount' contains extreme values — the largest value (125,000,000)" in t for t in texts)


def test_missing_ties_go_to_the_first_column(spark):
    df = spark.createDataFrame([(None, None, 1), (1, 1, 1)], "a int, b int, c int")
    row = quality.missing_summary(missing_profile(df)).collect()[0]
    assert (row.total_missing, row.cols_affected, row.worst_col, row.worst_col_pct, row.penalty) == (2, 2, "a", 50.0, 30.0)


def test_score_stays_in_range(spark):
    rows = [(None, 1.0)] * 50 + [(None, 1e9)]
    df = spark.createDataFrame(rows, "a double, b double")
    score = quality.score_dataset(detect(df)).collect()[0].score
    assert 0.0 <= score <= 100.0
