"""Data behind charts: bar shares, histograms, explorer bars, scatter and line."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import col, count_text, half_even
from ..plans.quantiles import exact_quantiles
from .tallies import top_values
from .timeline import aggregate_by_time, plausible_dates


def bar_shares(bars: DataFrame) -> DataFrame:
    """Share of each shown ``(value, count)`` bar in the sum of the shown bars, with its label."""
    total = bars.agg(F.sum("count").alias("shown"))
    share = half_even(F.col("count") / F.col("shown") * 100, 1)
    return bars.crossJoin(F.broadcast(total)).select(
        "value",
        "count",
        share.alias("pct_of_shown"),
        F.concat(count_text(F.col("count")), F.lit(" ("), share.cast("string"), F.lit("%)")).alias("label"),
    )


def cap_at_p99(df: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Rows to plot: values up to the 99th percentile if the maximum is over ten times it."""
    p99 = exact_quantiles(df, col(name), [0.99])[0]
    top = df.agg(F.max(col(name).cast("double"))).collect()[0][0]
    extreme = p99 is not None and p99 > 0 and top > p99 * V.EXTREME_FACTOR
    shown = col(name) <= p99 if extreme else col(name).isNotNull()
    return df.where(shown), {"p99": p99, "max": top, "is_extreme": extreme}


def histogram(df: DataFrame, name: str, bins: int, log: bool = False) -> DataFrame:
    """``(bin, lower, upper, count)`` of the bins that hold values; the maximum is in the last bin.

    On a log axis only positive values have a place; the limits stay in log10 units.
    """
    x = col(name).cast("double")
    values = df.where(x > 0).select(F.log10(x).alias("x")) if log else df.where(x.isNotNull()).select(x.alias("x"))
    low, high = values.agg(F.min("x"), F.max("x")).collect()[0]
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    lower = F.lit(low) + F.col("bin") * F.lit(width)
    return counted.select("bin", lower.alias("lower"), (lower + F.lit(width)).alias("upper"), "count")


def bar_count(df: DataFrame, category: str, limit: int = V.BAR_LIMIT) -> DataFrame:
    return top_values(df, category, limit)


def bar_mean(df: DataFrame, category: str, value: str, limit: int = V.BAR_LIMIT) -> DataFrame:
    """Mean per category, the first ``limit`` categories in key order."""
    means = df.where(col(category).isNotNull()).groupBy(col(category).alias("value")).agg(F.avg(col(value)).alias("mean"))
    return means.orderBy("value").limit(limit)


def scatter_sample(df: DataFrame, x: str, y: str, colour: str | None = None, *, keys: Sequence[str], rows: int = V.SCATTER_ROWS) -> DataFrame:
    """``rows`` rows, spread evenly (all if there are fewer): those with the smallest hashes of their ``keys``.

    The choice does not depend on how the table is cut.  Only rows below a hash that a few more than ``rows`` should stay
    under meet in the final top-n; should too few stay under it, all do.
    """
    shown = [x, y, colour] if colour else [x, y]
    marked = df.select(*[col(c) for c in dict.fromkeys([*shown, *keys])], F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys])).alias("__mark"))
    total = df.count()
    if total > rows:
        edge = int(2**32 * (rows + 10 * math.sqrt(rows)) / total)
        few = marked.where(F.substring("__mark", 1, 8) < f"{edge:08x}") if edge < 2**32 else marked
        marked = few if edge >= 2**32 or few.count() >= rows else marked
        marked = marked.orderBy("__mark", *[col(k) for k in keys]).limit(rows)
    return marked.select(*[col(c) for c in shown])


def monthly_line(df: DataFrame, date: str, value: str, as_of: datetime.datetime | None = None) -> DataFrame:
    kept = plausible_dates(df, date, as_of)
    return aggregate_by_time(kept, date, value, "monthly").select("period", "mean")

