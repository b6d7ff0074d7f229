"""The summary report, the table profile and the raw-against-current comparison."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import missing, number_columns, percent
from ..operators.tallies import counts_by_column
from ..operators.timeline import date_range
from .duplicates import count_copies
from .insights import MONEY_QUANTILES, financial_summary, money_columns
from .leaders import leaders
from .measures import aggregate, local_frame, together
from .profile import QUALITY_QUANTILES, QUANTILES, Profile, profile
from .quality import findings, score_parts
from .semantic import Table

LEVEL_MARKS = {"good": "  [OK]     ", "warning": "  [NOTE]   ", "problem": "  [ISSUE]  "}
RULE, LINE = "=" * 65, "-" * 40


def report_categories(table: Table, limit: int | None = V.SEGMENT_COLUMNS) -> DataFrame:
    """Top three values of the first ``limit`` categorical columns (None: all), and how many more there are."""
    names = table.of_type("categorical")[:limit]
    counts = counts_by_column(table.df, names, keep_missing=True)
    # A categorical column has at most fifty values, so these windows are short.
    whole = W.partitionBy("ordinal")
    place = F.row_number().over(whole.orderBy(F.col("value").isNull(), F.desc("count"), "value"))
    ranked = counts.select(
        "*", place.alias("place"), F.sum("count").over(whole).alias("n_rows"), F.count("value").over(whole).alias("categories")
    )
    return ranked.where((F.col("place") <= V.REPORT_TOP_CATEGORIES) & F.col("value").isNotNull()).select(
        "ordinal", "column", "place", "value", "count", percent(F.col("count"), F.col("n_rows"), 1).alias("pct_of_rows"), "categories",
        F.greatest(F.col("categories") - V.REPORT_TOP_CATEGORIES, F.lit(0)).alias("more"),
    )


def report_top(table: Table, names: list[str] | None = None, limit: int | None = V.TOP_COLUMNS) -> DataFrame:
    """Top five values of the first ``limit`` columns with many values (None: all): a sketch proposes, one scan counts."""
    names = names or table.of_type("high_cardinality")[:limit]
    found = together(*[lambda n=n: leaders(table.df, n, V.REPORT_TOP_SEGMENTS) for n in names])
    spark, parts = table.df.sparkSession, []
    for i, (name, top) in enumerate(zip(names, found)):
        dtype = table.df.schema[name].dataType.simpleString()
        rows = [(i, name, k, r.value, r["count"], top.n_rows) for k, r in enumerate(top.rows, 1)]
        part = spark.createDataFrame(rows, f"ordinal int, column string, place int, value {dtype}, count bigint, n_rows bigint")
        parts.append(part.withColumn("value", F.col("value").cast("string")))
    whole = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "ordinal int, column string, place int, value string, count bigint, n_rows bigint"))
    return whole.select("ordinal", "column", "place", "value", "count", percent(F.col("count"), F.col("n_rows"), 1).alias("pct_of_rows"))


def table_profile(table: Table, found: Profile | None = None, limit: int | None = V.PROFILE_NUMERIC_COLUMNS) -> DataFrame:
    """Metadata only: missing share per column, and the spread of the first ``limit`` numbers (None: all)."""
    found = found or profile(table.df, table.types, (0.5,))
    numbers = table.of_type("metric", "financial")[:limit]
    shown = F.col("column").isin(*numbers)
    return found.frame.select(
        "ordinal", "column", "semantic_type",
        percent(F.col("missing"), F.lit(found.n_rows), 1).alias("missing_pct"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("minimum", "maximum", "mean", "median")],
    )


def table_context(
    table: Table, name: str = "Dataset", numbers: int | None = V.PROFILE_NUMERIC_COLUMNS, messages: int | None = V.CONTEXT_FINDINGS
) -> DataFrame:
    """The table in a few lines of metadata, without any row of it: ``(line_no, line)``.

    ``numbers`` numeric columns and ``messages`` findings are told; None is all.
    """
    spread = profile(table.df, table.types, QUANTILES)
    found, score = score_parts(table, spread)
    row = score.collect()[0]
    lines = [f"Dataset name   : {name}", f"Rows           : {row.n_rows:,}", f"Columns        : {row.n_cols}"]
    lines += [f"Quality score  : {row.score} / 100 ({row.grade})", "Column inventory:"]
    groups = {
        "Date columns": ("date_column",), "Numeric columns": ("metric", "financial"), "Category columns": ("categorical",),
        "Identifier columns": ("id_column",), "Text/high-card cols": ("text", "high_cardinality"),
    }
    lines += [f"  - {label:19}: {', '.join(table.of_type(*types)) or 'None'}" for label, types in groups.items()]
    columns = table_profile(table, found, numbers).orderBy("ordinal").collect()
    gaps = {r.column for r in found.frame.where("missing > 0").select("column").collect()}
    absent = [f"{c.column} ({c.missing_pct}% missing)" for c in columns if c.column in gaps]
    lines += [f"Missing values : {', '.join(absent) or 'No missing values.'}", "Numeric column statistics:"]
    lines += [
        f"  - {c.column}: min={c.minimum:.2f}, max={c.maximum:.2f}, mean={c.mean:.2f}, median={c.median:.2f}" for c in columns if c.median is not None
    ]
    lines += ["Quality findings:", *[f"  - {f.message}" for f in findings(table, (found, score)).collect()[:messages]]]
    return local_frame(table.df.sparkSession, list(enumerate(lines, 1)), "line_no int, line string")


def table_delta(original: DataFrame, current: DataFrame) -> DataFrame:
    """Rows removed, columns and missing cells of the current table against the original."""
    cells = sum((F.when(missing(current, n), 1).otherwise(0) for n in current.columns), F.lit(0))
    now = current.agg(F.count(F.lit(1)).alias("rows_now"), F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("missing_cells"))
    then = original.agg(F.count(F.lit(1)).alias("rows_original"))
    return then.crossJoin(now).select(
        "rows_original", "rows_now", (F.col("rows_original") - F.col("rows_now")).alias("rows_removed"),
        F.lit(len(current.columns)).cast("bigint").alias("columns_now"), "missing_cells",
    )


def report(
    table: Table, actions: Sequence[str] = (), name: str = "Dataset", as_of: datetime.datetime | None = None,
    category_columns: int | None = V.SEGMENT_COLUMNS, top_columns: int | None = V.TOP_COLUMNS,
) -> DataFrame:
    """The whole report as ``(line_no, line)``: a few lines per column, made from small frames."""
    as_of = as_of or datetime.datetime.now()
    dates = table.of_type("date_column")
    money = dict.fromkeys(money_columns(table), {*QUALITY_QUANTILES, *MONEY_QUANTILES})
    wanted = dict.fromkeys(number_columns(table.df), QUALITY_QUANTILES) | {n: tuple(ps) for n, ps in money.items()}
    spread, n_copies, ends, *sections = together(
        lambda: profile(table.df, table.types, wanted),
        lambda: count_copies(table.df),
        lambda: date_range(table.df, dates[0], as_of).collect()[0] if dates else (None, None),
        lambda: _category_lines(table, category_columns),
        lambda: _segment_lines(table, top_columns),
    )
    found, score = score_parts(table, spread, n_copies)
    sections.insert(0, _money_lines(table, spread))
    totals = score.collect()[0]
    lines = [RULE, "  DATA ANALYSIS REPORT", RULE, f"  Dataset   : {name}", f"  Generated : {as_of:%B %d, %Y at %I:%M %p}"]
    lines += [f"  Records   : {totals.n_rows:,}", f"  Columns   : {totals.n_cols}", RULE, ""]
    lines += ["SECTION 1 — DATASET OVERVIEW", LINE, ""]
    if ends[0] is not None:
        lines.append(f"  Date Range     : {ends[0]:%B %d, %Y} to {ends[1]:%B %d, %Y}")
    lines += [f"  Total Records  : {totals.n_rows:,}", f"  Total Columns  : {totals.n_cols}", "", "  Column Inventory:"]
    lines += [f"    - {c} ({V.type_label(table.types[c])})" for c in table.df.columns]
    lines += ["", "SECTION 2 — DATA QUALITY", LINE, "", f"  Quality Score  : {totals.score} / 100", f"  Grade          : {totals.grade}", "", "  Findings:"]
    lines += [LEVEL_MARKS[f.level] + f.message for f in findings(table, (found, score)).collect()]
    lines += ["", "SECTION 3 — KEY FINDINGS", LINE, "", *[line for section in sections for line in section]]
    lines += ["SECTION 4 — CLEANING ACTIONS PERFORMED", LINE, ""]
    lines += [f"  {i:2}. {text}" for i, text in enumerate(actions, 1)] or ["  No cleaning actions were performed on this dataset."]
    lines += ["", RULE, "  For questions about this data, consult your data analyst.", RULE]
    return local_frame(table.df.sparkSession, list(enumerate(lines, 1)), "line_no int, line string")


def _money_lines(table: Table, found: Profile) -> list[str]:
    if not money_columns(table):
        return []
    lines = ["  Financial Columns:"]
    for row in financial_summary(table, found).orderBy("ordinal").collect():
        lines += [f"    {row.column}:", f"      Total   : ${row.total:>15,.2f}", f"      Median  : ${row.median:>15,.2f}"]
        lines += [f"      Average : ${row.mean:>15,.2f}", f"      Zero $  : {row.n_zero:,} records ({row.zero_pct}%)", ""]
    return lines


def _category_lines(table: Table, limit: int | None) -> list[str]:
    if not table.of_type("categorical"):
        return []
    lines, rows = ["  Category Breakdowns:"], report_categories(table, limit).orderBy("ordinal", "place").collect()
    for ordinal in sorted({r.ordinal for r in rows}):
        group = [r for r in rows if r.ordinal == ordinal]
        lines.append(f"    {group[0].column} ({group[0].categories} categories):")
        lines += [f"      {r.value:35} {r['count']:>7,}  ({r.pct_of_rows}%)" for r in group]
        lines += [f"      ... and {group[0].more} more categories"] if group[0].more else []
        lines.append("")
    return lines


def _segment_lines(table: Table, limit: int | None) -> list[str]:
    if not table.of_type("high_cardinality"):
        return []
    lines, rows = ["  High-Volume Segments (Top 5 each):"], report_top(table, limit=limit).orderBy("ordinal", "place").collect()
    for ordinal in sorted({r.ordinal for r in rows}):
        group = [r for r in rows if r.ordinal == ordinal]
        lines += [f"    {group[0].column}:", *[f"      {r.value:35} {r['count']:>7,}  ({r.pct_of_rows}%)" for r in group], ""]
    return lines


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing cells and share of every column, in one scan."""
    found = aggregate(df, {"rows": F.count(F.lit(1)), **{(n,): F.count_if(missing(df, n)) for n in df.columns}})
    lines = [(i, n, found[(n,)], found["rows"]) for i, n in enumerate(df.columns)]
    frame = local_frame(df.sparkSession, lines, "ordinal int, column string, missing bigint, n_rows bigint")
    return frame.select("ordinal", "column", "missing", percent(F.col("missing"), F.col("n_rows"), 1).alias("missing_pct"))


