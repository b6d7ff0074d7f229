"""Counting values: frequency tables, the most common value, the first few per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """``(value, count)`` without missing values; counted in the map tasks before the shuffle."""
    return df.where(col(name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties in value order (no full sort)."""
    return value_counts(df, name).orderBy(F.desc("count"), F.asc("value")).limit(n)


def most_common(df: DataFrame, name: str) -> DataFrame:
    """One row with the most frequent value, the smallest on a tie; NULL if there is none."""
    best = F.min(F.struct((-F.col("count")).alias("rank"), F.col("value")))
    return value_counts(df, name).agg(best["value"].alias("value"))


def counts_by_column(df: DataFrame, names: Sequence[str], keep_missing: bool = False, measure: str | None = None) -> DataFrame:
    """``(ordinal, column, value, count)`` of several columns in one scan and one shuffle, with the ``mean`` of a measure
    over each value's rows if one is named; no rows without columns."""
    if not names:
        more = ", mean double" if measure else ""
        return df.sparkSession.createDataFrame([], f"ordinal int, column string, value string, count bigint{more}")
    cells = F.inline(
        F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"), col(n).cast("string").alias("value")) for i, n in enumerate(names)])
    )
    long = df.select(*([col(measure).alias("measure")] if measure else []), cells)
    long = long if keep_missing else long.where("value IS NOT NULL")
    parts = [F.count(F.lit(1)).alias("count"), *([F.avg("measure").alias("mean")] if measure else [])]
    return long.groupBy("ordinal", "column", "value").agg(*parts)
