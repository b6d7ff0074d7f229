"""Automatic insights: outcome, trend, money, segments and leaders, each with its sentences."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import (
    col, contains_any, count_text, fixed_text, is_number, nan_to_null, percent, value_text,
)
from ..operators.tallies import counts_by_column
from ..operators.timeline import aggregate_by_time, granularity_for, is_plausible, plausible_dates, trend_headline
from .leaders import leaders
from .measures import local_frame, together
from .profile import POSITIVE_MEDIAN, Profile, profile
from .quality import is_extreme
from .semantic import Table

MONEY_QUANTILES = (0.5, 0.99, POSITIVE_MEDIAN)
INSIGHT_DDL = "section int, ordinal int, kind string, column string, headline string, detail string, note string"


def money_columns(table: Table) -> list[str]:
    return [c for c in table.of_type("financial") if is_number(table.df.schema[c].dataType)]


def _quoted(column: Column) -> Column:
    return F.concat(F.lit("'"), column, F.lit("'"))


# --- Outcome -----------------------------------------------------------------------


def outcome_column(table: Table) -> str | None:
    return next((c for c in table.of_type("categorical") if V.has_keyword(c, V.OUTCOME_KEYWORDS)), None)


def outcome_breakdown(table: Table, name: str) -> DataFrame:
    """``(value, count, pct_of_rows)`` of an outcome column; shares are of all rows."""
    counts = table.df.groupBy(col(name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("n_rows"))
    return (
        counts.where("value IS NOT NULL")
        .crossJoin(F.broadcast(total))
        .select("value", "count", percent(F.col("count"), F.col("n_rows"), 1).alias("pct_of_rows"))
    )


def outcome_insight(table: Table, name: str) -> DataFrame:
    """The most common outcome; if it is a negative majority, how rare the positive ones are.

    A categorical column has at most fifty values, so the ordered list is short.
    """
    if table.types[name] != "categorical":
        raise ValueError(f"'{name}' is not a categorical column")
    order = F.struct((-F.col("count")).alias("rank"), "value", F.col("pct_of_rows").alias("pct"))
    ranked = outcome_breakdown(table, name).agg(F.array_sort(F.collect_list(order)).alias("all")).where(F.size("all") > 0)
    top, positives = F.col("all")[0], F.filter("all", lambda o: contains_any(o["value"], V.POSITIVE_OUTCOME_WORDS))
    parts = lambda n: F.array_join(
        F.transform(F.slice("all", 1, n), lambda o: F.concat(_quoted(o["value"]), F.lit(" "), o["pct"].cast("string"), F.lit("%"))), ", "
    )
    rejected = contains_any(top["value"], V.NEGATIVE_OUTCOME_WORDS) & (top["pct"] > V.OUTCOME_MAJORITY_PCT)
    positive = F.get(F.col("positives"), F.lit(0))
    return ranked.withColumn("positives", positives).select(
        F.lit(name).alias("column"),
        F.when(
            rejected,
            F.concat(fixed_text(top["pct"], 0), F.lit("% of records result in "), _quoted(top["value"]), F.lit(" — the most common outcome by far.")),
        )
        .otherwise(F.concat(F.lit(f"The most common {name} is "), _quoted(top["value"]), F.lit(" ("), fixed_text(top["pct"], 0), F.lit("% of records).")))
        .alias("headline"),
        F.when(
            rejected & (F.size("positives") > 0),
            F.concat(
                F.lit("Only "), fixed_text(positive["pct"], 0), F.lit("% of records result in "), _quoted(positive["value"]),
                F.lit(". The remaining "), fixed_text(100 - top["pct"] - positive["pct"], 0), F.lit("% have other outcomes."),
            ),
        )
        .when(rejected, F.concat(F.lit("The full breakdown: "), parts(4)))
        .otherwise(F.concat(F.lit("Full breakdown: "), parts(5)))
        .alias("detail"),
        F.lit(None).cast("string").alias("note"),
    )


# --- Trend ----------------------------------------------------------------------------


def trend_columns(table: Table) -> tuple[str, str] | None:
    """The first date column with the first money column, or else the first other number."""
    dates = table.of_type("date_column")
    values = money_columns(table) or [c for c in table.of_type("metric") if is_number(table.df.schema[c].dataType)]
    return (dates[0], values[0]) if dates and values else None


def trend_insight(table: Table, as_of: datetime.datetime | None = None) -> DataFrame | None:
    """One row with the trend's numbers and sentences; None if there is too little to tell."""
    chosen = trend_columns(table)
    if chosen is None:
        return None
    date, value = chosen
    df = table.df
    plausible = is_plausible(df, date, as_of)
    usable = plausible & col(value).isNotNull()
    seen = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(plausible).alias("kept"),
        F.count_if(usable).alias("usable"),
        F.min(F.when(usable, col(date))).alias("first"),
        F.max(F.when(usable, col(date))).alias("last"),
    )
    row = seen.select("*", granularity_for(F.col("first"), F.col("last")).alias("granularity")).collect()[0]
    if row.usable < V.TREND_MIN_ROWS:
        return None
    periods = aggregate_by_time(plausible_dates(df, date, as_of), date, value, row.granularity)
    excluded = row.total - row.kept
    note = f"Note: {excluded:,} rows with dates outside {V.PLAUSIBLE_FROM[:4]}–present were excluded." if excluded else None
    return trend_headline(periods, value, row.granularity).select(
        F.lit(date).alias("column"),
        F.lit(value).alias("value_column"),
        F.lit(row.granularity).alias("granularity"),
        F.lit(excluded).cast("bigint").alias("excluded_rows"),
        "*",
        F.lit(note).cast("string").alias("note"),
    )


# --- Money ----------------------------------------------------------------------------------


def financial_summary(table: Table, found: Profile | None = None) -> DataFrame:
    """Total, median, mean, p99, maximum and zero share of every money column that holds values, and the median of its
    positive values where most are zero: one more rank of the same search."""
    names = money_columns(table)
    found = found or profile(table.df.select(*[col(n) for n in names]), table.types, MONEY_QUANTILES)
    rows = found.frame.where(F.col("column").isin(*names) & (F.col("present") > 0))
    zero_pct = percent(F.col("zeros"), F.col("present"), 1)
    place = F.array_position(F.lit(names) if names else F.array().cast("array<string>"), F.col("column")).cast("int") - 1
    return rows.select(
        place.alias("ordinal"), "column", "total", "median", "mean", "p99", F.col("maximum").alias("max_value"),
        F.col("zeros").alias("n_zero"), zero_pct.alias("zero_pct"), is_extreme().alias("is_extreme"),
        F.when(zero_pct > V.MOSTLY_ZERO_PCT, F.col("median_positive")).alias("median_positive"),
    )


def financial_insights(table: Table, summary: DataFrame | None = None) -> DataFrame | None:
    """Sentences per money column: mostly zero, extreme, or ordinary."""
    names = money_columns(table)
    if not names:
        return None
    summary = summary or financial_summary(table)
    rows = []
    for name in names:
        one = summary.where(F.col("column") == name)
        money = lambda c: value_text(F.col(c), name)  # noqa: B023, E731
        zero = F.col("zero_pct") > V.MOSTLY_ZERO_PCT
        headline = (
            F.when(
                zero,
                F.concat(fixed_text(F.col("zero_pct"), 0), F.lit(f"% of {name} values are $0 — meaning most records resulted in no payout.")),
            )
            .when(
                F.col("is_extreme"),
                F.concat(F.lit(f"The total {name} across all records is "), money("total"), F.lit(". Most values are modest — the typical record is "), money("median"), F.lit(".")),
            )
            .otherwise(F.concat(F.lit(f"The total {name} is "), money("total"), F.lit(", with a typical record value of "), money("median"), F.lit(".")))
        )
        no_positive = F.concat(F.lit("No record has a positive amount. The total across all records is "), money("total"), F.lit("."))
        detail = (
            F.when(
                zero,
                F.coalesce(
                    F.concat(F.lit("Among records with a positive amount, the median is "), money("median_positive"), F.lit(". The total across all records is "), money("total"), F.lit(".")),
                    no_positive,
                ),
            )
            .when(
                F.col("is_extreme"),
                F.concat(
                    F.lit("However, a small number of extreme values (above "), money("p99"), F.lit(" at the 99th percentile) are pulling the average up to "),
                    money("mean"), F.lit(". The single largest value is "), money("max_value"), F.lit("."),
                ),
            )
            .otherwise(F.concat(F.lit("The average is "), money("mean"), F.lit(", and 99% of values fall below "), money("p99"), F.lit(".")))
        )
        rows.append(one.select("ordinal", "column", headline.alias("headline"), detail.alias("detail"), F.lit(None).cast("string").alias("note")))
    return _union(rows)


# --- Segments ------------------------------------------------------------------------------------


def segment_cells(table: Table, names: list[str] | None = None, limit: int | None = V.SEGMENT_COLUMNS) -> DataFrame:
    """Rows and mean money of each value of the first ``limit`` categorical columns (None: all), in one scan and one shuffle."""
    names = names or table.of_type("categorical")[:limit]
    money = money_columns(table)
    return counts_by_column(table.df, names, keep_missing=True, measure=money[0] if money else None)


def segments(table: Table, names: list[str] | None = None, limit: int | None = V.SEGMENT_COLUMNS, cells: DataFrame | None = None) -> DataFrame:
    """Most and least common value of categorical columns."""
    counts = (segment_cells(table, names, limit) if cells is None else cells).select("ordinal", "column", "value", "count")
    place = F.when(F.col("value").isNotNull(), F.struct((-F.col("count")).alias("rank"), "value"))
    found = counts.groupBy("ordinal", "column").agg(
        F.sum("count").alias("n_rows"), F.count("value").alias("categories"), F.min(place).alias("top"), F.max(place).alias("bottom")
    )
    return found.where("categories >= 2").select(
        "ordinal",
        "column",
        "categories",
        F.col("top")["value"].alias("top_category"),
        (-F.col("top")["rank"]).alias("top_count"),
        percent(-F.col("top")["rank"], F.col("n_rows"), 1).alias("top_pct"),
        F.col("bottom")["value"].alias("bottom_category"),
        (-F.col("bottom")["rank"]).alias("bottom_count"),
        percent(-F.col("bottom")["rank"], F.col("n_rows"), 1).alias("bottom_pct"),
    )


def segment_value_ratio(table: Table, names: list[str] | None = None, limit: int | None = V.SEGMENT_COLUMNS, cells: DataFrame | None = None) -> DataFrame:
    """Categories whose mean money is at least twice that of the lowest category."""
    if not (names or table.of_type("categorical")[:limit]) or not money_columns(table):
        return table.df.sparkSession.createDataFrame([], "ordinal int, column string, top_category string, top_avg double, bottom_category string, bottom_avg double, ratio double")
    means = (segment_cells(table, names, limit) if cells is None else cells).where("value IS NOT NULL")
    place = F.when(F.col("mean").isNotNull(), F.struct((-F.col("mean")).alias("rank"), "value"))
    found = means.groupBy("ordinal", "column").agg(
        F.count("value").alias("categories"), F.count("mean").alias("known"), F.min(place).alias("top"), F.max(place).alias("bottom")
    )
    ratio = F.col("top_avg") / F.col("bottom_avg")
    return (
        found.where("categories >= 2 AND known = categories")
        .select(
            "ordinal",
            "column",
            F.col("top")["value"].alias("top_category"),
            (-F.col("top")["rank"]).alias("top_avg"),
            F.col("bottom")["value"].alias("bottom_category"),
            (-F.col("bottom")["rank"]).alias("bottom_avg"),
        )
        .where(F.col("bottom_avg") > 0)
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= V.MONEY_RATIO)
    )


def segment_insights(table: Table, limit: int | None = V.SEGMENT_COLUMNS) -> DataFrame | None:
    names = table.of_type("categorical")[:limit]
    if not names:
        return None
    cells = segment_cells(table, names)  # both frames below group it again; its shuffle is made once
    found = segments(table, names, cells=cells)
    money = money_columns(table)
    note = F.lit(None).cast("string")
    if money:
        ratios = segment_value_ratio(table, names, cells=cells).select("ordinal", *[F.col(c).alias(f"r_{c}") for c in ("top_category", "top_avg", "bottom_category", "bottom_avg", "ratio")])
        found = found.join(F.broadcast(ratios), "ordinal", "left")
        note = F.concat(
            _quoted(F.col("r_top_category")), F.lit(" records have "), fixed_text(F.col("r_ratio"), 1), F.lit(f"x higher average {money[0]} ("),
            value_text(F.col("r_top_avg"), money[0]), F.lit(") than "), _quoted(F.col("r_bottom_category")), F.lit(" ("),
            value_text(F.col("r_bottom_avg"), money[0]), F.lit(")."),
        )
    top, pct = _quoted(F.col("top_category")), fixed_text(F.col("top_pct"), 0)
    least, least_pct = _quoted(F.col("bottom_category")), fixed_text(F.col("bottom_pct"), 1)
    ratio = F.col("top_count") / F.col("bottom_count")
    return found.select(
        "ordinal",
        "column",
        F.when(F.col("top_pct") >= V.DOMINANT_PCT, F.concat(top, F.lit(" dominates — it accounts for "), pct, F.lit("% of all "), F.col("column"), F.lit(" records.")))
        .when(F.col("top_pct") >= V.MAJORITY_PCT, F.concat(top, F.lit(" is the most common "), F.col("column"), F.lit(", making up "), pct, F.lit("% of all records.")))
        .otherwise(F.concat(top, F.lit(" is the leading "), F.col("column"), F.lit(" ("), pct, F.lit("%), but no single category dominates.")))
        .alias("headline"),
        F.when(ratio >= V.COUNT_RATIO, F.concat(top, F.lit(" has "), fixed_text(ratio, 0), F.lit("x more records than the least common category "), least, F.lit(" ("), least_pct, F.lit("%).")))
        .otherwise(F.concat(F.lit("The least common category is "), least, F.lit(" with "), count_text(F.col("bottom_count")), F.lit(" records ("), least_pct, F.lit("%).")))
        .alias("detail"),
        note.alias("note"),
    )


# --- Leaders of columns with many values -------------------------------------------------------------


def topn_segments(table: Table, name: str, ordinal: int = 0) -> DataFrame:
    """The leading value, its share, and the top-ten value with the highest mean money: a sketch proposes, one scan counts."""
    money = money_columns(table)
    found = leaders(table.df, name, V.TOP_VALUES, money[0] if money else None)
    rows = [(ordinal, k, r.value, r["count"], r.mean, found.n_rows) for k, r in enumerate(found.rows)]
    dtype = table.df.schema[name].dataType.simpleString()
    top = table.df.sparkSession.createDataFrame([(*r[:4], None if r[4] is None else float(r[4]), r[5]) for r in rows], f"ordinal int, k int, value {dtype}, count bigint, mean double, n_rows bigint")
    place = F.min(F.struct("k", "value", "count", "n_rows"))
    best = F.min(F.when(F.col("mean").isNotNull(), F.struct((-F.col("mean")).alias("rank"), "value")))
    leader = top.groupBy("ordinal").agg(F.count(F.lit(1)).alias("shown"), place.alias("leader"), best.alias("best")).where("shown >= 2")
    return leader.select(
        "ordinal", F.lit(name).alias("column"), F.col("leader")["value"].cast("string").alias("top_value"), F.col("leader")["count"].alias("top_count"),
        percent(F.col("leader")["count"], F.col("leader")["n_rows"], 1).alias("top_pct"),
        F.col("best")["value"].cast("string").alias("best_value"), (-F.col("best")["rank"]).alias("best_avg"),
    )


def topn_insights(table: Table, limit: int | None = V.TOP_COLUMNS) -> DataFrame | None:
    names = table.of_type("high_cardinality")[:limit]
    money = money_columns(table)
    parts = []
    for i, name in enumerate(names):
        headline = F.concat(
            _quoted(F.col("top_value")), F.lit(f" leads in {name} with "), count_text(F.col("top_count")), F.lit(" records ("),
            fixed_text(F.col("top_pct"), 0), F.lit("% of the total)."),
        )
        detail = F.lit(f"Showing the top {V.TOP_VALUES} {name} values by record count.")
        if money:
            best = F.concat(
                F.lit(f"Among the top {V.TOP_VALUES}, "), _quoted(F.col("best_value")), F.lit(f" has the highest average {money[0]} at "),
                value_text(F.col("best_avg"), money[0]), F.lit("."),
            )
            detail = F.coalesce(best, detail)
        parts.append(topn_segments(table, name, i).select("ordinal", "column", headline.alias("headline"), detail.alias("detail"), F.lit(None).cast("string").alias("note")))
    return _union(parts)


# --- All together --------------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame | None:
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def insights(
    table: Table, as_of: datetime.datetime | None = None, segment_columns: int | None = V.SEGMENT_COLUMNS, top_columns: int | None = V.TOP_COLUMNS
) -> DataFrame:
    """All insight sentences in reading order; a column that has one does not get another.

    The first ``segment_columns`` categorical columns and ``top_columns`` columns with many values are told about; None is all.
    """
    outcome = outcome_column(table)
    trend, money, tops = together(lambda: trend_insight(table, as_of), lambda: financial_insights(table), lambda: topn_insights(table, top_columns))
    produced = [
        (1, "outcome", None if outcome is None else outcome_insight(table, outcome)),
        (2, "time_trend", trend),
        (3, "financial", money),
        (4, "segment", segment_insights(table, segment_columns)),
        (5, "high_cardinality_segment", tops),
    ]
    parts = []
    for section, kind, found in produced:
        if found is not None:
            ordinal = F.col("ordinal") if "ordinal" in found.columns else F.lit(0)
            parts.append(found.select(F.lit(section).alias("section"), ordinal.alias("ordinal"), F.lit(kind).alias("kind"), "column", "headline", "detail", "note"))
    whole = _union(parts)
    if whole is None:
        return local_frame(table.df.sparkSession, [], INSIGHT_DDL)
    first = F.row_number().over(W.partitionBy("column").orderBy("section", "ordinal"))
    return whole.withColumn("place", first).where("place = 1").drop("place").orderBy("section", "ordinal")

