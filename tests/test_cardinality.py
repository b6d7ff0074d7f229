"""Distinct counts in long form."""

import datetime

from tablescope.operators import transforms
from tablescope.plans import cardinality


def test_many_kinds_of_columns_in_one_job(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i % 7, None if i % 5 == 0 else f"t{i % 11}", float("nan") if i % 3 else -0.0 if i % 2 else 0.0, i % 2 == 0, day + datetime.timedelta(days=i % 4), [1], i, None) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, x double, f boolean, d timestamp, l array<int>, u long, n string")
    spark.sparkContext.setJobGroup("distinct", "")
    got = cardinality.exact_distinct(df, df.columns)
    spark.sparkContext.setJobGroup("", "")
    assert got == {"a": 7, "b.c": 11, "x": 1, "f": 2, "d": 4, "l": None, "u": 300, "n": 0}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("distinct")) <= 3  # stages of one adaptive plan
    assert cardinality.exact_distinct(df.where("false"), ["a", "u"]) == {"a": 0, "u": 0} and cardinality.exact_distinct(df, []) == {}


def test_cells_of_one_value_do_not_collide_across_columns(spark):
    df = spark.createDataFrame([(i, i, str(i)) for i in range(50)], "a long, b long, c string")
    assert cardinality.exact_distinct(df, df.columns) == dict.fromkeys(df.columns, 50)


def test_a_unique_column_is_not_doubtful(spark):
    """Estimates of a unique column stay within four standard errors of its rows, far from the threshold."""
    for estimate in (0.974, 1.0, 1.026):
        assert not cardinality.uniqueness_doubtful(estimate * 10**9, 10**9, 0.94)
    assert cardinality.uniqueness_doubtful(0.95 * 10**6, 10**6, 0.95)


def test_many_values_are_refused_without_grouping(spark):
    df = spark.range(5000).selectExpr("id AS k", "id % 3 AS few")
    assert cardinality.at_most(df, "k", 30) is None and sorted(cardinality.at_most(df, "few", 3)) == [0, 1, 2] and cardinality.at_most(df, "few", 2) is None
    spark.sparkContext.setJobGroup("refused", "")
    assert transforms.one_hot_encode(df, "k").refused
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("refused")) <= 2
