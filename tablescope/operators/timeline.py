"""Values over time: plausible dates, granularity, period aggregates and their sentence."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import col, count_text, fixed_text, value_text

GRANULARITIES = ("yearly", "monthly", "daily")


def is_plausible(df: DataFrame, name: str, as_of: datetime.datetime | None = None) -> Column:
    """From 2000-01-01 up to ``as_of`` (now if not given); missing dates are not plausible."""
    dtype = df.schema[name].dataType
    until = F.current_timestamp() if as_of is None else F.lit(as_of)
    return col(name).between(F.lit(V.PLAUSIBLE_FROM).cast("timestamp_ntz").cast(dtype), until.cast(dtype))


def plausible_dates(df: DataFrame, name: str, as_of: datetime.datetime | None = None) -> DataFrame:
    """A range filter on the bare column, so it reaches the scan."""
    return df.where(is_plausible(df, name, as_of))


def granularity_for(first: Column, last: Column) -> Column:
    """Yearly, monthly or daily, from the whole days that elapsed."""
    days = F.timestamp_diff("DAY", first, last)
    return (
        F.when(days > V.YEARLY_ABOVE_DAYS, "yearly").when(days > V.MONTHLY_ABOVE_DAYS, "monthly").otherwise("daily")
    )


def time_granularity(df: DataFrame, name: str) -> DataFrame:
    ends = df.agg(F.min(col(name)).alias("first_date"), F.max(col(name)).alias("last_date"))
    return ends.select(
        "first_date",
        "last_date",
        F.timestamp_diff("DAY", F.col("first_date"), F.col("last_date")).alias("span_days"),
        granularity_for(F.col("first_date"), F.col("last_date")).alias("granularity"),
    )


def aggregate_by_time(df: DataFrame, date: str, value: str, granularity: str, truncate: bool = True) -> DataFrame:
    """``(period, mean, count)`` per year, month or day; ``truncate=False`` groups raw timestamps."""
    if granularity == "yearly":
        period = F.year(col(date))
    elif granularity == "monthly":
        period = F.trunc(col(date), "month")
    else:
        period = col(date).cast("date") if truncate else col(date)
    if granularity != "yearly":
        period = period.cast("timestamp_ntz")
    return (
        df.where(col(date).isNotNull() & col(value).isNotNull())
        .groupBy(period.alias("period"))
        .agg(F.avg(col(value)).alias("mean"), F.count(F.lit(1)).alias("count"))
    )


def trend_headline(periods: DataFrame, value: str, granularity: str) -> DataFrame:
    """One row: the peak, the change from the first to the last period, and two sentences."""
    found = periods.agg(
        F.count(F.lit(1)).alias("periods"),
        F.min(F.struct((-F.col("count")).alias("rank"), F.col("period"))).alias("peak"),
        F.min_by("count", "period").alias("first_count"),
        F.max_by("count", "period").alias("last_count"),
        F.avg("mean").alias("average"),
        (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("row_average"),
    ).where(F.col("periods") >= V.TREND_MIN_PERIODS)
    change = (F.col("last_count") - F.col("first_count")) / F.col("first_count") * 100
    size = fixed_text(F.abs("pct_change"), 0)
    phrase = (
        F.when(F.col("pct_change") < -V.TREND_STRONG_PCT, F.concat(F.lit("declined significantly ("), size, F.lit("%) since then")))
        .when(F.col("pct_change") < -V.TREND_MILD_PCT, F.concat(F.lit("trended downward ("), size, F.lit("%) since then")))
        .when(F.col("pct_change") > V.TREND_STRONG_PCT, F.concat(F.lit("grown significantly ("), size, F.lit("%) since then")))
        .when(F.col("pct_change") > V.TREND_MILD_PCT, F.concat(F.lit("trended upward ("), size, F.lit("%) since then")))
        .otherwise("remained relatively stable")
    )
    peak = F.col("peak")["period"]
    label = peak.cast("string") if granularity == "yearly" else F.date_format(peak, "MMM yyyy")
    return (
        found.withColumn("pct_change", change)
        .withColumn("peak_label", label)
        .withColumn("peak_count", -F.col("peak")["rank"])
        .select(
            "periods", "peak_label", "peak_count", "first_count", "last_count", "pct_change", "average", "row_average",
            F.concat(
                F.lit("Activity peaked in "), F.col("peak_label"), F.lit(" with "), count_text(F.col("peak_count")),
                F.lit(" records and has "), phrase, F.lit("."),
            ).alias("headline"),
            F.concat(
                F.lit(f"The average {value} across the full period was "), value_text(F.col("average"), value), F.lit("."),
            ).alias("detail"),
        )
    )


def date_range(df: DataFrame, name: str, as_of: datetime.datetime | None = None) -> DataFrame:
    kept = plausible_dates(df, name, as_of)
    return kept.agg(F.min(col(name)).alias("first_date"), F.max(col(name)).alias("last_date"))
