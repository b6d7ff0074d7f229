import datetime

import pytest

from tablescope.operators import charts, tallies, timeline
from tablescope.plans import insights as I
from tablescope.plans import report
from tablescope.plans.semantic import Table, detect

NOW = datetime.datetime(2024, 12, 31)


def day(y, m=1, d=1):
    return datetime.datetime(y, m, d)


def test_plausible_dates_keep_both_ends(one):
    df = one([day(1999, 12, 31), day(2000), day(2024, 12, 31), day(2055), None], "timestamp_ntz")
    assert [r.x for r in timeline.plausible_dates(df, "x", NOW).collect()] == [day(2000), day(2024, 12, 31)]
    plan = timeline.plausible_dates(df, "x")
    assert plan.count() == 2


@pytest.mark.parametrize("last, word", [(day(2021, 12, 31), "monthly"), (day(2022, 1, 1), "yearly"), (day(2020, 3, 1), "daily"), (day(2020, 3, 2), "monthly")])
def test_granularity(one, last, word):
    assert timeline.time_granularity(one([day(2020), last], "timestamp_ntz"), "x").collect()[0].granularity == word


def test_elapsed_days_are_whole(one):
    df = one([datetime.datetime(2020, 1, 1, 23, 30), datetime.datetime(2020, 1, 2, 23, 0)], "timestamp_ntz")
    assert timeline.time_granularity(df, "x").collect()[0].span_days == 0


def test_trend_headline(spark):
    rows = [(day(2020), 1.0)] * 4 + [(day(2021), 3.0)] * 6 + [(day(2022), 5.0)] * 6 + [(day(2023), None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, price double")
    row = timeline.trend_headline(timeline.aggregate_by_time(df, "t", "price", "yearly"), "price", "yearly").collect()[0]
    assert (row.peak_label, row.peak_count, row.pct_change, row.average) == ("2021", 6, 50.0, 3.0)
    assert row.row_average == pytest.approx((4 + 18 + 30) / 16)
    assert row.headline == "Activity peaked in 2021 with 6 records and has grown significantly (50%) since then."
    assert row.detail == "The average price across the full period was $3.00."


def test_raw_timestamps_can_be_kept(spark):
    df = spark.createDataFrame([(datetime.datetime(2020, 1, 1, h), 1.0) for h in range(3)], "t timestamp_ntz, v double")
    assert timeline.aggregate_by_time(df, "t", "v", "daily").count() == 1
    assert timeline.aggregate_by_time(df, "t", "v", "daily", truncate=False).count() == 3


def test_too_few_rows_give_no_trend(spark):
    df = spark.createDataFrame([(day(2020, 1, i + 1), 1.0) for i in range(9)], "t timestamp_ntz, v double")
    assert I.trend_insight(detect(df), NOW) is None


def outcome(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "outcome string")
    return I.outcome_insight(Table(df, {"outcome": "categorical"}), "outcome").collect()[0]


def test_outcome_sentences(spark):
    row = outcome(spark, ["Denied"] * 7 + ["Approved"] * 2 + ["Open"])
    assert row.headline == "70% of records result in 'Denied' — the most common outcome by far."
    assert row.detail == "Only 20% of records result in 'Approved'. The remaining 10% have other outcomes."
    row = outcome(spark, ["Denied"] * 7 + ["Open"] * 3)
    assert row.detail == "The full breakdown: 'Denied' 70.0%, 'Open' 30.0%"
    row = outcome(spark, ["Open"] * 2 + ["Won", None])
    assert row.headline == "The most common outcome is 'Open' (50% of records)."
    assert row.detail == "Full breakdown: 'Open' 50.0%, 'Won' 25.0%"


def test_segments_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacd"] + [(None,)], "kind string")
    row = I.segments(detect(df)).collect()[0]
    assert (row.top_category, row.top_count, row.bottom_category, row.bottom_count, row.categories) == ("a", 2, "d", 1, 4)
    assert (row.top_pct, row.bottom_pct) == (28.6, 14.3)


def test_segment_ratio_needs_known_means(spark):
    rows = [("a", 10.0), ("b", 2.0), ("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "kind string, price double")
    assert I.segment_value_ratio(detect(df)).count() == 0
    row = I.segment_value_ratio(detect(df.where("kind <> 'c'"))).collect()[0]
    assert (row.top_category, row.bottom_category, row.ratio) == ("a", "b", 4.0)


def test_mostly_zero_money(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(-5.0,), (4.0,), (8.0,), (12.0,)], "fee double")
    table = detect(df)
    row = I.financial_summary(table).collect()[0]
    assert (row.n_zero, row.zero_pct, row.median_positive, row.total) == (6, 60.0, 8.0, 19.0)
    assert I.financial_insights(table).collect()[0].headline.startswith("60% of fee values are $0")
    none = detect(spark.createDataFrame([(0.0,)] * 3, "fee double"))
    assert I.financial_insights(none).collect()[0].detail.startswith("No record has a positive amount")


def test_leaders(spark):
    rows = [(f"v{i % 60}", float(i)) for i in range(600)] + [("v7", 0.0)] * 5
    table = detect(spark.createDataFrame(rows, "kind string, price double"))
    row = I.topn_segments(table, "kind").collect()[0]
    assert (row.top_value, row.top_count) == ("v7", 15)
    assert row.best_value == "v16"  # the ten leaders are v7, then by name v0 v1 v10 v11 v12 v13 v14 v15 v16


def test_insights_keep_the_first_per_column(spark):
    df = spark.createDataFrame([("Open", 1.0), ("Closed", 2.0)] * 10, "status string, price double")
    found = I.insights(detect(df), NOW).collect()
    assert [(r.kind, r.column) for r in found] == [("outcome", "status"), ("financial", "price")]
    assert I.insights(detect(df.select("status").where("false")), NOW).count() == 0


def test_histogram_puts_the_maximum_in_the_last_bin(one):
    found = {r.bin: r["count"] for r in charts.histogram(one([0.0, 1.0, 5.0, 10.0], "double"), "x", 10).collect()}
    assert found == {0: 1, 1: 1, 5: 1, 9: 1}
    assert [tuple(r)[::3] for r in charts.histogram(one([3.0, 3.0], "double"), "x", 10).collect()] == [(0, 2)]
    assert charts.histogram(one([None], "double"), "x", 10).count() == 0
    assert charts.histogram(one([0.0, -1.0, 10.0, 100.0], "double"), "x", 5, log=True).count() == 2


def test_bars(spark, one):
    df = one(list("aabbbc"), "string")
    found = charts.bar_shares(charts.bar_count(df, "x", 2)).collect()
    assert sorted((r.value, r["count"], r.pct_of_shown, r.label) for r in found) == [("a", 2, 40.0, "2 (40.0%)"), ("b", 3, 60.0, "3 (60.0%)")]
    assert [tuple(r) for r in tallies.most_common(one([None, "b", "a"], "string"), "x").collect()] == [("a",)]
    means = charts.bar_mean(spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 4.0), (None, 9.0)], "k string, v double"), "k", "v")
    assert [tuple(r) for r in means.collect()] == [("a", 3.0), ("b", 1.0)]


def test_scatter_has_the_exact_size(spark):
    df = spark.range(20000).selectExpr("id x", "id y")
    assert charts.scatter_sample(df, "x", "y", keys=["x"], rows=500).count() == 500
    assert charts.scatter_sample(df.limit(30), "x", "y", keys=["x"], rows=500).count() == 30
    cut = charts.scatter_sample(df.repartition(7), "x", "y", keys=["x"], rows=500)
    assert sorted(cut.collect()) == sorted(charts.scatter_sample(df, "x", "y", keys=["x"], rows=500).collect())


def test_tables_without_the_wanted_columns_give_empty_frames(spark):
    from tablescope.plans import insights, report
    from tablescope.plans.semantic import detect

    table = detect(spark.range(100).selectExpr("id x"))
    for found in (insights.segments(table), insights.segment_value_ratio(table), report.report_categories(table), report.report_top(table)):
        assert found.collect() == []


def test_p99_cap(one):
    df = one([1.0] * 500 + [1000.0], "double")
    shown, limits = charts.cap_at_p99(df, "x")
    assert limits["is_extreme"] and shown.count() == 500
    shown, limits = charts.cap_at_p99(one([1.0, 2.0, None], "double"), "x")
    assert not limits["is_extreme"] and shown.count() == 2


def test_context_is_metadata_only(spark):
    df = spark.createDataFrame([(day(2020), "secret", 10.0), (day(2021), "secret", 30.0), (day(2022), None, None)], "created timestamp_ntz, status string, price double")
    lines = [r.line for r in report.table_context(detect(df), "sample").orderBy("line_no").collect()]
    assert "Rows           : 3" in lines and "  - price: min=10.00, max=30.00, mean=20.00, median=20.00" in lines
    assert "Missing values : status (33.3% missing), price (33.3% missing)" in lines
    assert not any("secret" in line for line in lines)


def test_report_reads_in_order(spark):
    df = spark.createDataFrame([(day(2020), "Open", 10.0), (day(2021), "Shut", 30.0), (day(2022), "Open", None)], "created timestamp_ntz, status string, price double")
    lines = [r.line for r in report.report(detect(df), ["Did one thing."], "sample", NOW).orderBy("line_no").collect()]
    assert lines[3] == "  Dataset   : sample" and lines[4] == "  Generated : December 31, 2024 at 12:00 AM"
    assert "  Date Range     : January 01, 2020 to January 01, 2022" in lines
    assert "    - price (Financial Amount)" in lines and "      Median  : $          20.00" in lines
    assert "    status (2 categories):" in lines and "   1. Did one thing." in lines
