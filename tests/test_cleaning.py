import datetime

import pytest
from pyspark.sql import functions as F

from tablescope.operators import cleaning, transforms
from tablescope.plans.recipe import Recipe, auto_clean, suggested_recipe, suggestions
from tablescope.plans.semantic import detect


def values(df):
    return [r[0] for r in df.collect()]


def test_duplicates_keep_the_lowest_row(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "row_id int, s string")
    step = cleaning.remove_duplicates(df, "row_id")
    assert sorted(map(tuple, step.df.collect())) == [(1, "a"), (2, "b")]
    assert step.message == "Removed 1 duplicate row(s). Dataset now has 2 rows."
    again = cleaning.remove_duplicates(step.df, "row_id")
    assert not again.changed and again.message == "No duplicate rows found — nothing to remove."


def test_duplicates_with_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('c', 1)")
    assert cleaning.remove_duplicates(df).df.count() == 2


@pytest.mark.parametrize("strategy, filled", [("mean", 4.0), ("median", 2.0), ("mode", 1.0)])
def test_fills(one, strategy, filled):
    df = one([1.0, 1.0, 2.0, 3.0, 13.0, float("nan"), None], "double")
    step = cleaning.fill_missing(df, "x", strategy)
    assert values(step.df) == [1.0, 1.0, 2.0, 3.0, 13.0, filled, filled]
    assert step.message.startswith("Filled 2 missing value(s) in 'x' with")


def test_mode_tie_takes_the_smallest(one):
    assert values(cleaning.fill_missing(one(["b", "a", "b", "a", None], "string"), "x", "mode").df)[-1] == "a"


def test_mode_of_dates_keeps_the_type(one):
    day = datetime.datetime(2020, 5, 1, 7, 30)
    step = cleaning.fill_missing(one([day, day, None], "timestamp_ntz"), "x", "mode", semantic_type="date_column")
    assert values(step.df) == [day] * 3 and step.df.dtypes == [("x", "timestamp_ntz")]


@pytest.mark.parametrize(
    "make, text",
    [
        (lambda d: cleaning.fill_missing(d, "nope", "mean"), "Column 'nope' not found"),
        (lambda d: cleaning.fill_missing(d, "s", "mean"), "not a numeric column"),
        (lambda d: cleaning.fill_missing(d, "n", "average"), "Unknown strategy"),
        (lambda d: cleaning.fill_missing(d, "n", "constant"), "No fill value"),
        (lambda d: cleaning.fill_missing(d, "n", "constant", "zero"), "does not fit"),
        (lambda d: cleaning.fill_missing(d, "t", "median"), "date column"),
        (lambda d: cleaning.fill_missing(d, "void", "median"), "has no values"),
        (lambda d: cleaning.fill_missing(d, "void", "mode"), "Could not determine a mode"),
        (lambda d: cleaning.rename_column(d, "n", "s"), "already exists"),
        (lambda d: cleaning.rename_column(d, "nope", "s"), "not found"),
        (lambda d: cleaning.drop_column(d, "nope"), "not found"),
        (lambda d: cleaning.drop_missing_rows(d, "nope"), "not found"),
        (lambda d: cleaning.standardize_case(d, "s", "camel"), "Unknown case"),
        (lambda d: cleaning.trim_whitespace(d, "n"), "not a text column"),
        (lambda d: transforms.log_transform(d, "s"), "not a numeric column"),
        (lambda d: transforms.log_transform(d, "n"), "contains negative values"),
        (lambda d: transforms.standard_scale(d, "s"), "not a numeric column"),
        (lambda d: transforms.extract_date_part(d, "s", "year"), "not a date column"),
        (lambda d: transforms.extract_date_part(d, "t", "hour"), "Unknown part"),
        (lambda d: transforms.one_hot_encode(d, "nope"), "not found"),
    ],
)
def test_refusals_leave_the_table_alone(spark, make, text):
    df = spark.createDataFrame([(1, "a", datetime.datetime(2020, 1, 1), None), (-2, None, None, None)], "n int, s string, t timestamp_ntz, void double")
    step = make(df)
    assert text in step.message and not step.changed and step.df is df


def test_nothing_to_fill(one):
    step = cleaning.fill_missing(one([1.0], "double"), "x", "constant", 0)
    assert step.message == "'x' has no missing values — nothing to fill." and not step.changed


def test_typed_constants():
    assert [cleaning.typed_constant(t) for t in ("0", "1.5", "2.0", "abc")] == [0, 1.5, 2, "abc"]


def test_text_steps_keep_missing(one):
    df = one([" a ", None], "string")
    assert values(cleaning.trim_whitespace(df, "x").df) == ["a", None]
    assert values(cleaning.standardize_case(df, "x", "upper").df) == [" A ", None]


def test_currency_step(one):
    step = cleaning.currency_to_number(one(["$1,000", "unknown", None], "string"), "x")
    assert values(step.df) == [1000.0, None, None]
    assert step.changed and step.message == "Converted 'x' from currency/text to numeric."
    audit = Recipe().then("currency_to_number", name="x").audit(step.source).collect()[0]
    assert (audit.rows_before, audit.rows_after, audit.cells_changed) == (3, 3, 2)


def test_every_step_tells_what_it_did(spark):
    df = spark.createDataFrame([(1, 2.5, "a b", datetime.datetime(2020, 5, 1)), (None, None, None, None)], "n int, x double, s string, t timestamp_ntz")
    steps = (
        Recipe().then("standard_scale", name="x").then("minmax_scale", name="n").then("log_transform", name="x").then("one_hot_encode", name="s")
        .then("extract_date_part", name="t", part="year").then("rename_column", old="n", new="m").then("fill_missing", name="m", strategy="mean")
        .then("fill_missing", name="x", strategy="median").then("drop_column", name="t").then("drop_missing_rows")
    )
    audit = steps.audit(df).orderBy("step").collect()
    assert len(audit) == 10 and all(r.message for r in audit) and [r.cells_changed for r in audit][6:8] == [1, 1]
    assert audit[-1].rows_after == 1 and audit[-1].message.startswith("Removed 1 row(s)")
    assert steps.run(df).columns == ["m", "x", "x_scaled", "n_minmax", "x_log", "s_a b", "t_year"]
    assert all(r.message for r in steps.bind(df))


def test_log_and_scaling(one):
    df = one([0.0, 500.0, 1000.0], "double")
    assert values(transforms.minmax_scale(df, "x").df.select("x_minmax")) == [0.0, 0.5, 1.0]
    assert values(transforms.log_transform(one([1.0], "double"), "x").df.select("x_log")) == [pytest.approx(0.6931471805599453)]
    scaled = values(transforms.standard_scale(one([1.0, 3.0, None], "double"), "x").df.select("x_scaled"))
    assert scaled == [pytest.approx(v) for v in (-0.2672612419, 1.3363062095, -1.0690449676)]
    assert values(transforms.standard_scale(one([2.0, 2.0], "double"), "x").df.select("x_scaled")) == [0.0, 0.0]
    assert "improved from" in transforms.log_transform(df, "x").message


def test_one_hot(spark, one):
    df = one(["Property Damage", "Passenger Theft", "Property Damage", None], "string", "Claim Type")
    found = transforms.one_hot_encode(df, "Claim Type").df
    assert found.columns == ["Claim Type_Passenger Theft", "Claim Type_Property Damage"]
    assert [tuple(r) for r in found.collect()] == [(0, 1), (1, 0), (0, 1), (0, 0)]
    assert "too many" in transforms.one_hot_encode(one(list(range(31)), "int"), "x").message
    clash = spark.createDataFrame([("a", 1)], "k string, k_a int")
    assert "repeat a column name" in transforms.one_hot_encode(clash, "k").message


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1.0, " a"), (None, "b")], "`unit price.x` double, `the name` string")
    step = cleaning.fill_missing(df, "unit price.x", "mean")
    assert values(step.df.select(F.col("`unit price.x`"))) == [1.0, 1.0]
    assert values(cleaning.trim_whitespace(df, "the name").df.select("the name")) == ["a", "b"]
    assert detect(df).types == {"unit price.x": "financial", "the name": "categorical"}


def recipe():
    return (
        Recipe().then("trim_whitespace", name="s").then("fill_missing", name="s", strategy="mode").then("drop_missing_rows", name="n")
        .then("remove_duplicates").then("fill_missing", name="m", strategy="constant", value=0)
    )


def test_audit_adds_up_and_undo_goes_back(spark):
    df = spark.createDataFrame([(1, " a", None), (1, "a", None), (2, None, 5), (None, "b", 6)], "n int, s string, m int")
    audit = recipe().audit(df).orderBy("step").collect()
    assert [(r.rows_before, r.rows_after, r.cells_changed) for r in audit] == [(4, 4, 1), (4, 4, 1), (4, 3, 0), (3, 2, 0), (2, 2, 1)]
    assert audit[2].message == "Removed 1 row(s) with missing values in 'n'. Dataset now has 3 rows."
    assert audit[0].rows_before - audit[-1].rows_after == sum(r.rows_before - r.rows_after for r in audit)
    longer = recipe()
    assert longer.undo().steps == longer.steps[:-1]
    assert sorted(map(str, longer.then("drop_column", name="m").undo().run(df).collect())) == sorted(map(str, longer.run(df).collect()))
    with pytest.raises(ValueError):
        Recipe().then("no such step")


def test_suggestions_and_auto_clean(spark):
    rows = [(i, float(2 ** (i % 20)), None if i % 10 == 0 else "a") for i in range(200)] + [(0, 1.0, None)]
    table = detect(spark.createDataFrame(rows, "n int, size double, kind string"))
    found = suggestions(table).collect()
    assert [(r.priority, r.operation, r.column) for r in found] == [
        (1, "remove_duplicates", None), (1, "fill_missing_mode", "kind"), (3, "log_transform", "size"),
    ]
    cleaned = auto_clean(table)
    assert cleaned.columns == ["n", "size", "kind", "size_log"]
    assert cleaned.count() == 200 and cleaned.where("kind IS NULL").count() == 0
    assert [r.operation for r in suggestions(detect(cleaned)).collect()] == ["log_transform"]
    assert len(suggested_recipe(table).steps) == 3
