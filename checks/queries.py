"""One query per operator.  Each takes ``(spark, sf_dir)`` and runs over whole tables.

Floats are rounded last, so that the order of additions does not show.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col
from tablescope.operators import charts, cleaning, tallies, timeline, transforms
from tablescope.plans import insights as I
from tablescope.plans import correlation, quality, recipe, report, semantic
from tablescope.plans.measures import together
from tablescope.plans.profile import QUALITY_QUANTILES, missing_profile, profile
from tablescope.session import scratch_path
from tablescope.sources import loading, saving

from .fixtures import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = datetime.datetime(2024, 12, 31)
TYPED_TABLES = ("dirty_orders", "dirty_profile", "lineitem", "part", "events", "documents", "embeddings")


def query(name: str) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return keep


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def prepared(spark: SparkSession, sf_dir: str, name: str) -> semantic.Table:
    return loading.prepare(read(spark, sf_dir, name))


# --- Loading and saving ----------------------------------------------------------


@query("header_trim")
def header_trim(spark, sf_dir):
    padded = read(spark, sf_dir, "customer")
    return loading.trim_header(padded.toDF(*[f"  {c} " for c in padded.columns]))


@query("null_tokens")
def null_tokens(spark, sf_dir):
    return loading.null_tokens(read(spark, sf_dir, "dirty_orders")).select("o_orderkey", "order_date_text", "order_status")


@query("infer_types")
def infer_types(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders")
    as_text = df.select(*[col(c).cast("string").alias(c) for c in df.columns])
    return loading.infer_types(loading.null_tokens(as_text))


@query("infer_wide_ids")
def infer_wide_ids(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    ids = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("1"), F.lpad(key, 18, "0")).alias("id_19"), F.concat(F.lit("1"), F.lpad(key, 21, "0")).alias("id_22"),
        F.concat(F.lit("+"), key).alias("signed"), F.concat(key, F.lit(".5")).alias("number"),
        F.when(F.col("o_orderkey") % 2 == 0, "True").otherwise("false").alias("flag"), F.lit(None).cast("string").alias("nothing"), F.concat(key, F.lit("x")).alias("word"),
    )
    return loading.infer_types(ids)


DATE_COLUMNS = {
    "iso_zone": "yyyy-MM-dd'T'HH:mm:ss'Z'", "iso_offset": "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "day_first": "dd/MM/yyyy", "month_first": "MM/dd/yyyy",
    "half_day": "MM/dd/yyyy hh:mm a", "full_month": "MMMM d, yyyy", "short_month": "d MMM yyyy", "dotted": "yyyy.MM.dd", "german": "dd.MM.yyyy",
    "day_dash": "dd-MM-yyyy", "two_digits": "MM/dd/yy", "compact": "yyyyMMdd",
}


@query("date_formats")
def date_formats(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", *[F.date_format("o_orderdate", f).alias(n) for n, f in DATE_COLUMNS.items()])
    for name in DATE_COLUMNS:
        df = semantic.convert_date(df, name)
    return df


@query("load_csv")
def load_csv(spark, sf_dir):
    path = saving.write_csv(read(spark, sf_dir, "dirty_orders"), scratch_path(spark, "csv"), "orders")
    return loading.load_csv(spark, path).df


@query("export_csv")
def export_csv(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders")
    path = saving.write_csv(df, scratch_path(spark, "csv"), "orders", datetime.date(2024, 7, 15))
    back = loading.scan_csv(spark, path)
    return back.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])


@query("display_projection")
def display_projection(spark, sf_dir):
    return saving.display_projection(read(spark, sf_dir, "orders"))


@query("preview")
def preview(spark, sf_dir):
    return saving.preview(read(spark, sf_dir, "orders"), "o_orderkey")


@query("table_delta")
def table_delta(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders")
    return report.table_delta(df, cleaning.drop_missing_rows(df, "total_amount").df)


# --- Filters and predicates -----------------------------------------------------------


@query("missing_by_column")
def missing_by_column(spark, sf_dir):
    return report.missing_by_column(read(spark, sf_dir, "dirty_orders"))


@query("plausible_dates")
def plausible_dates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return timeline.plausible_dates(orders, "o_orderdate", datetime.datetime(2001, 6, 30))


@query("dup_preview")
def dup_preview(spark, sf_dir):
    return cleaning.duplicate_preview(read(spark, sf_dir, "numbered_customer"), "row_id")


def _health(spark, sf_dir, table="dirty_lineitem"):
    df = read(spark, sf_dir, table)
    return quality.numeric_health(profile(df, quantiles=QUALITY_QUANTILES))


@query("iqr_outliers")
def iqr_outliers(spark, sf_dir):
    return _health(spark, sf_dir).select("column", "outlier_count", "outlier_pct", "has_many_outliers", "lower_fence", "upper_fence", "outlier_penalty")


@query("p99_cap")
def p99_cap(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_lineitem")
    shown, limits = charts.cap_at_p99(df, "l_extendedprice")
    kept = shown.agg(F.count(F.lit(1)).alias("kept"))
    total = df.agg(F.count("l_extendedprice").alias("present"))
    return kept.crossJoin(total).select(
        F.round(F.lit(limits["p99"]), 4).alias("p99"),
        F.round(F.lit(limits["max"]), 2).alias("max_value"),
        F.lit(limits["is_extreme"]).alias("is_extreme"),
        "kept",
        (F.col("present") - F.col("kept")).alias("excluded"),
    )


@query("drop_column")
def drop_column(spark, sf_dir):
    return cleaning.drop_column(read(spark, sf_dir, "orders"), "o_totalprice").df


@query("rename_column")
def rename_column(spark, sf_dir):
    return cleaning.rename_column(read(spark, sf_dir, "orders"), "o_totalprice", "total price").df


# --- Column classification ------------------------------------------------------------------


@query("column_types")
def column_types(spark, sf_dir):
    tables = together(*[lambda t=t: prepared(spark, sf_dir, t) for t in TYPED_TABLES])
    parts = [
        semantic.types_frame(table).select(F.lit(t).alias("table_name"), "ordinal", "column", "semantic_type")
        for t, table in zip(TYPED_TABLES, tables)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("date_convert")
def date_convert(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "order_date_text")
    return semantic.convert_date(df, "order_date_text")


@query("expected_types")
def expected_types(spark, sf_dir):
    return semantic.expected_types(read(spark, sf_dir, "dirty_profile")).select("ordinal", "column", "expected")


@query("recommendations")
def recommendations(spark, sf_dir):
    return semantic.recommendations(prepared(spark, sf_dir, "dirty_profile"))


@query("type_summary")
def type_summary(spark, sf_dir):
    return semantic.type_summary(prepared(spark, sf_dir, "dirty_orders"))


@query("column_inventory")
def column_inventory(spark, sf_dir):
    return semantic.column_inventory(prepared(spark, sf_dir, "dirty_orders"))


# --- Quality -----------------------------------------------------------------------------------


@query("quality_missing")
def quality_missing(spark, sf_dir):
    return quality.missing_summary(missing_profile(read(spark, sf_dir, "dirty_orders")))


@query("quality_duplicates")
def quality_duplicates(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_customer")
    return quality.duplicate_summary(df, df.count())


@query("column_skew")
def column_skew(spark, sf_dir):
    found = profile(read(spark, sf_dir, "dirty_lineitem"), quantiles=()).frame.where("numeric")
    return rounded(found.select("column", "skewness", (F.abs("skewness") >= 1).alias("is_highly_skewed")), 6, "skewness")


@query("numeric_health")
def numeric_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query("quality_score")
def quality_score(spark, sf_dir):
    return quality.score_dataset(semantic.Table(read(spark, sf_dir, "dirty_lineitem"), {}))


@query("quality_findings")
def quality_findings(spark, sf_dir):
    return quality.findings(semantic.Table(read(spark, sf_dir, "dirty_lineitem"), {}))


@query("column_health")
def column_health(spark, sf_dir):
    return quality.column_health(prepared(spark, sf_dir, "dirty_lineitem"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]


@query("correlation_vif")
def correlation_vif(spark, sf_dir):
    """Variance inflation of three columns of an untidy table, beside their correlations with each other."""
    df = read(spark, sf_dir, "dirty_lineitem").select(*MEASURES)
    pairs, vif = together(lambda: correlation.correlations(df), lambda: correlation.variance_inflation(df, MEASURES[:3]))
    parts = [
        pairs.select(F.lit("pair").alias("part"), "column_a", "column_b", "n_rows", F.col("correlation").alias("value")),
        vif.select(F.lit("vif").alias("part"), F.col("column").alias("column_a"), F.lit(None).cast("string").alias("column_b"), "n_rows", F.col("vif").alias("value")),
    ]
    return rounded(parts[0].unionByName(parts[1]), 8, "value")


# --- Cleaning ------------------------------------------------------------------------------------


@query("remove_duplicates")
def remove_duplicates(spark, sf_dir):
    return cleaning.remove_duplicates(read(spark, sf_dir, "dirty_customer")).df


def _filled(spark, sf_dir, column, strategy, value=None):
    df = loading.null_tokens(read(spark, sf_dir, "dirty_orders")).select("o_orderkey", column)
    return cleaning.fill_missing(df, column, strategy, value).df


@query("fill_mean")
def fill_mean(spark, sf_dir):
    return rounded(_filled(spark, sf_dir, "total_amount", "mean"), 4, "total_amount")


@query("fill_median")
def fill_median(spark, sf_dir):
    return rounded(_filled(spark, sf_dir, "total_amount", "median"), 4, "total_amount")


@query("fill_median_approx")
def fill_median_approx(spark, sf_dir):
    """Rows, cells left missing, and whether the filled value's rank is within the bound."""
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "total_amount")
    filled = cleaning.fill_missing(df, "total_amount", "median", rank_error=0.005).df.withColumnRenamed("total_amount", "filled")
    value = filled.join(df.where("total_amount IS NULL"), "o_orderkey", "left_semi").agg(F.max("filled").alias("value"))
    x, v = F.col("total_amount"), F.col("value")
    ranks = df.crossJoin(F.broadcast(value)).agg(F.count(x).alias("n"), F.count_if(x < v).alias("below"), F.count_if(x <= v).alias("up_to"))
    within = (F.col("below") - 1 <= 0.505 * F.col("n")) & (F.col("up_to") + 1 >= 0.495 * F.col("n"))
    sizes = filled.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("filled").isNull()).alias("left_missing"))
    return sizes.crossJoin(ranks.select(within.alias("within_bound")))


@query("fill_mode")
def fill_mode(spark, sf_dir):
    return _filled(spark, sf_dir, "priority_label", "mode")


@query("fill_mode_date")
def fill_mode_date(spark, sf_dir):
    return _filled(spark, sf_dir, "posted_at", "mode")


@query("fill_constant")
def fill_constant(spark, sf_dir):
    return _filled(spark, sf_dir, "total_amount", "constant", cleaning.typed_constant("0"))


@query("drop_missing_col")
def drop_missing_col(spark, sf_dir):
    return cleaning.drop_missing_rows(read(spark, sf_dir, "dirty_orders"), "total_amount").df


@query("drop_missing_any")
def drop_missing_any(spark, sf_dir):
    return cleaning.drop_missing_rows(read(spark, sf_dir, "dirty_orders")).df


def _text(spark, sf_dir, step, *args):
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "priority_label")
    return step(df, "priority_label", *args).df


@query("trim_text")
def trim_text(spark, sf_dir):
    return _text(spark, sf_dir, cleaning.trim_whitespace)


@query("case_title")
def case_title(spark, sf_dir):
    return _text(spark, sf_dir, cleaning.standardize_case, "title")


@query("case_lower")
def case_lower(spark, sf_dir):
    return _text(spark, sf_dir, cleaning.standardize_case, "lower")


@query("case_upper")
def case_upper(spark, sf_dir):
    return _text(spark, sf_dir, cleaning.standardize_case, "upper")


@query("currency_to_number")
def currency_to_number(spark, sf_dir):
    return cleaning.currency_to_number(read(spark, sf_dir, "dirty_money"), "amount_text").df


# --- Transforms --------------------------------------------------------------------------------------


@query("log_transform")
def log_transform(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "payout_value")
    return rounded(transforms.log_transform(df, "payout_value").df, 6, "payout_value_log")


@query("log_skew")
def log_skew(spark, sf_dir):
    df = transforms.log_transform(read(spark, sf_dir, "dirty_orders").select("payout_value"), "payout_value").df
    found = profile(df, quantiles=()).frame.select("column", "skewness")
    return rounded(found, 6, "skewness")


@query("standard_scale")
def standard_scale(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "total_amount")
    return rounded(transforms.standard_scale(df, "total_amount").df, 6, "total_amount_scaled")


@query("minmax_scale")
def minmax_scale(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "total_amount")
    return rounded(transforms.minmax_scale(df, "total_amount").df, 6, "total_amount_minmax")


@query("one_hot")
def one_hot(spark, sf_dir):
    df = loading.null_tokens(read(spark, sf_dir, "dirty_orders")).select("o_orderkey", "order_status")
    return transforms.one_hot_encode(df, "order_status").df


@query("date_parts")
def date_parts(spark, sf_dir):
    df = read(spark, sf_dir, "dirty_orders").select("o_orderkey", "posted_at")
    for part in ("year", "month", "day"):
        df = transforms.extract_date_part(df, "posted_at", part).df
    return df


# --- Aggregates and insights ------------------------------------------------------------------------------


@query("value_counts")
def value_counts(spark, sf_dir):
    return tallies.value_counts(read(spark, sf_dir, "dirty_orders"), "priority_label")


@query("time_granularity")
def time_granularity(spark, sf_dir):
    orders, events = read(spark, sf_dir, "orders"), read(spark, sf_dir, "events")
    a = timeline.time_granularity(orders, "o_orderdate").withColumn("source", F.lit("orders"))
    b = timeline.time_granularity(events, "ts").withColumn("source", F.lit("events"))
    return a.unionByName(b)


def _trend(df, date, value, granularity):
    return rounded(timeline.aggregate_by_time(df, date, value, granularity), 4, "mean")


@query("trend_yearly")
def trend_yearly(spark, sf_dir):
    return _trend(read(spark, sf_dir, "dirty_orders"), "posted_at", "total_amount", "yearly")


@query("trend_monthly")
def trend_monthly(spark, sf_dir):
    return _trend(read(spark, sf_dir, "dirty_orders"), "posted_at", "total_amount", "monthly")


@query("trend_daily")
def trend_daily(spark, sf_dir):
    return _trend(read(spark, sf_dir, "events"), "ts", "value", "daily")


@query("trend_headline")
def trend_headline(spark, sf_dir):
    parts = []
    for table, date, value, granularity in (
        ("dirty_orders", "posted_at", "total_amount", "yearly"),
        ("dirty_orders", "posted_at", "payout_value", "monthly"),
        ("events", "ts", "value", "daily"),
    ):
        periods = timeline.aggregate_by_time(read(spark, sf_dir, table), date, value, granularity)
        parts.append(timeline.trend_headline(periods, value, granularity).withColumn("granularity", F.lit(granularity)))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(whole, 4, "pct_change", "average", "row_average")


@query("insight_trend")
def insight_trend(spark, sf_dir):
    found = I.trend_insight(prepared(spark, sf_dir, "dirty_orders"), AS_OF)
    return rounded(found, 4, "pct_change", "average", "row_average")


@query("segments")
def segments(spark, sf_dir):
    return I.segments(prepared(spark, sf_dir, "dirty_orders"))


@query("segment_value_ratio")
def segment_value_ratio(spark, sf_dir):
    table = loading.prepare(read(spark, sf_dir, "dirty_profile").select("claim_outcome", "constant_flag", "band_label", "settlement_fee"))
    found = I.segment_value_ratio(table)
    return rounded(found, 4, "top_avg", "bottom_avg", "ratio")


@query("financial_summary")
def financial_summary(spark, sf_dir):
    names = ("dirty_orders", "dirty_profile", "dirty_lineitem")
    parts = together(
        *[lambda n=n: I.financial_summary(prepared(spark, sf_dir, n)).withColumn("table_name", F.lit(n)) for n in names]
    )
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(rounded(whole, 2, "total"), 4, "median", "mean", "p99", "max_value", "median_positive")


@query("outcome_breakdown")
def outcome_breakdown(spark, sf_dir):
    table = prepared(spark, sf_dir, "dirty_profile")
    return I.outcome_breakdown(table, I.outcome_column(table))


@query("topn_segments")
def topn_segments(spark, sf_dir):
    table = prepared(spark, sf_dir, "events")
    return rounded(I.topn_segments(table, table.of_type("high_cardinality")[0]), 4, "best_avg")


@query("insights")
def insights(spark, sf_dir):
    names = ("dirty_orders", "dirty_profile", "events")
    parts = together(*[lambda n=n: I.insights(prepared(spark, sf_dir, n), AS_OF).withColumn("table_name", F.lit(n)) for n in names])
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- Charts --------------------------------------------------------------------------------------------------


@query("bar_shares")
def bar_shares(spark, sf_dir):
    return charts.bar_shares(charts.bar_count(read(spark, sf_dir, "part"), "p_name"))


@query("histogram_40")
def histogram_40(spark, sf_dir):
    return rounded(charts.histogram(read(spark, sf_dir, "dirty_orders"), "total_amount", 40), 6, "lower", "upper")


@query("histogram_log")
def histogram_log(spark, sf_dir):
    return rounded(charts.histogram(read(spark, sf_dir, "dirty_lineitem"), "l_extendedprice", 50, log=True), 6, "lower", "upper")


@query("explore_bar_count")
def explore_bar_count(spark, sf_dir):
    return charts.bar_count(read(spark, sf_dir, "events"), "props")


@query("explore_bar_mean")
def explore_bar_mean(spark, sf_dir):
    return rounded(charts.bar_mean(read(spark, sf_dir, "part"), "p_name", "p_retailprice"), 4, "mean")


@query("explore_scatter")
def explore_scatter(spark, sf_dir):
    return charts.scatter_sample(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", keys=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("explore_line")
def explore_line(spark, sf_dir):
    return rounded(charts.monthly_line(read(spark, sf_dir, "dirty_orders"), "posted_at", "total_amount", AS_OF), 4, "mean")


# --- Suggestions and recipes -------------------------------------------------------------------------------------


@query("suggestions")
def suggestions(spark, sf_dir):
    names = ("dirty_orders", "dirty_customer")
    a, b = together(*[lambda n=n: recipe.suggestions(prepared(spark, sf_dir, n)).withColumn("table_name", F.lit(n)) for n in names])
    return a.unionByName(b)


@query("auto_clean")
def auto_clean(spark, sf_dir):
    cleaned = recipe.auto_clean(prepared(spark, sf_dir, "dirty_orders"))
    return rounded(cleaned, 4, *[c for c in ("total_amount", "payout_value", "payout_value_log") if c in cleaned.columns])


def _steps() -> recipe.Recipe:
    return (
        recipe.Recipe()
        .then("trim_whitespace", name="priority_label")
        .then("standardize_case", name="priority_label", case="upper")
        .then("fill_missing", name="priority_label", strategy="mode")
        .then("drop_missing_rows", name="posted_at")
        .then("fill_missing", name="total_amount", strategy="constant", value=0)
        .then("remove_duplicates")
        .then("drop_column", name="no_such_column")
    )


@query("recipe_audit")
def recipe_audit(spark, sf_dir):
    return _steps().audit(read(spark, sf_dir, "dirty_orders"))


@query("recipe_audit_written")
def recipe_audit_written(spark, sf_dir):
    """The audit that is counted while the cleaned table is written; its duplicates are real ones."""
    path = scratch_path(spark, "audited")
    steps = recipe.Recipe().then("standardize_case", name="c_mktsegment", case="lower").then("remove_duplicates")
    steps = steps.then("trim_whitespace", name="c_name").then("drop_column", name="c_nationkey")
    return steps.audit_beside(read(spark, sf_dir, "dirty_customer"), lambda df: df.write.parquet(path))


@query("recipe_undo")
def recipe_undo(spark, sf_dir):
    return _steps().undo().undo().undo().undo().run(read(spark, sf_dir, "dirty_orders"))


# --- Report ------------------------------------------------------------------------------------------------------------


@query("date_range")
def date_range(spark, sf_dir):
    table = prepared(spark, sf_dir, "dirty_orders")
    return timeline.date_range(table.df, table.of_type("date_column")[0], AS_OF)


@query("report_financial")
def report_financial(spark, sf_dir):
    found = I.financial_summary(prepared(spark, sf_dir, "dirty_profile")).select("column", "total", "median", "mean", "n_zero", "zero_pct")
    return rounded(rounded(found, 2, "total"), 4, "median", "mean")


@query("report_categories")
def report_categories(spark, sf_dir):
    return report.report_categories(prepared(spark, sf_dir, "dirty_orders"))


@query("report_top5")
def report_top5(spark, sf_dir):
    table = prepared(spark, sf_dir, "events")
    return report.report_top(table)


@query("report")
def full_report(spark, sf_dir):
    return report.report(prepared(spark, sf_dir, "dirty_orders"), ["Trimmed text."], "orders", AS_OF)


@query("report_sink")
def report_sink(spark, sf_dir):
    lines = report.report(prepared(spark, sf_dir, "dirty_orders"), ["Trimmed text."], "orders", AS_OF)
    path = saving.write_report(lines, scratch_path(spark, "report"), "orders", datetime.date(2024, 7, 15))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("table_context")
def table_context(spark, sf_dir):
    return report.table_context(prepared(spark, sf_dir, "dirty_orders"), "orders")


@query("table_profile")
def table_profile(spark, sf_dir):
    found = report.table_profile(prepared(spark, sf_dir, "dirty_orders"))
    return rounded(found, 4, "minimum", "maximum", "mean", "median")


@query("glance")
def glance(spark, sf_dir):
    return quality.glance(semantic.Table(read(spark, sf_dir, "dirty_customer"), {}))


