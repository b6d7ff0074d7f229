"""Statistics of every column, computed once and shared by score, findings, health and suggestions.

Scans: one to sketch the numbers, two for each step that settles their quantiles, one for counts, moments and fences.
None of them shuffles rows.  All run in long form, grouped by column number, so the number of jobs does not depend on
the number of columns (beyond ``COLUMNS_AT_ONCE`` of them, the quantiles take turns).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import col, is_number, nan_to_null, unbiased_skew
from .measures import local_frame
from .quantiles import Positive, Quantiles, constants, long_values

POSITIVE_MEDIAN = Positive(0.5)
QUANTILES = (0.25, 0.5, 0.75, 0.99)
QUALITY_QUANTILES = (0.25, 0.75, 0.99)

PROFILE_DDL = """ordinal int, column string, spark_type string, semantic_type string, numeric boolean,
 present bigint, missing bigint, minimum double, maximum double, mean double, total double, median double,
 q1 double, q3 double, p99 double, skewness double, lower_fence double, upper_fence double, outliers bigint,
 zeros bigint, median_positive double"""


@dataclass(frozen=True)
class Profile:
    n_rows: int
    frame: DataFrame


def profile(
    df: DataFrame,
    types: dict[str, str] | None = None,
    quantiles: Sequence[float | Positive] | dict[str, Sequence[float | Positive]] = QUANTILES,
) -> Profile:
    """One row of statistics per column of ``df``; NULL where a column is not numeric or a quantile not asked for.

    ``quantiles`` are those of every numeric column, or by column name.
    """
    types = types or {}
    df = nan_to_null(df)
    numbers = [f.name for f in df.schema.fields if is_number(f.dataType)]
    asked = quantiles if isinstance(quantiles, dict) else dict.fromkeys(numbers, quantiles)
    search = Quantiles({n: (col(n).cast("double"), asked.get(n, ())) for n in numbers})
    spread = {n: dict(zip(asked.get(n, ()), values)) for n, values in search.solve(df).items()}
    n_rows, present, moments = _moments(df, numbers, spread)
    lines = []
    for ordinal, field in enumerate(df.schema.fields):
        name = field.name
        line = [ordinal, name, field.dataType.simpleString(), types.get(name), name in numbers]
        line += [present[name], n_rows - present[name], *moments.get(name, [None] * 14)]
        lines.append(tuple(line))
    return Profile(n_rows, local_frame(df.sparkSession, lines, PROFILE_DDL))


def missing_profile(df: DataFrame) -> Profile:
    """Only the present and missing counts of every column: one scan, no numbers."""
    df = nan_to_null(df)
    n_rows, present, _ = _moments(df, [], {})
    lines = [
        (i, f.name, f.dataType.simpleString(), None, is_number(f.dataType), present[f.name], n_rows - present[f.name], *[None] * 14)
        for i, f in enumerate(df.schema.fields)
    ]
    return Profile(n_rows, local_frame(df.sparkSession, lines, PROFILE_DDL))


def fences(q1: float, q3: float) -> tuple[float, float]:
    reach = V.FENCE_FACTOR * (q3 - q1)
    return q1 - reach, q3 + reach


def _moments(
    df: DataFrame, numbers: list[str], spread: dict[str, dict[float | Positive, float]]
) -> tuple[int, dict[str, int], dict[str, list]]:
    """Row count, present cells, moments and fence counts: one scan, grouped by column number, with small states.

    Columns that are no numbers take part with a 0 for each present cell.
    """
    names = df.columns
    if not names:
        return df.count(), {}, {}
    cells = long_values(df, [col(n) if n in numbers else F.when(col(n).isNotNull(), F.lit(0.0)) for n in names])
    ends = {n: fences(spread[n][0.25], spread[n][0.75]) for n in numbers if spread[n].get(0.25) is not None}
    lower, upper = (F.get(F.expr(constants([ends[n][k] if n in ends else None for n in names])), F.col("c")) for k in (0, 1))
    x = F.col("x")
    found = cells.groupBy("c").agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("present"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"),
        F.sum(x).alias("total"), unbiased_skew(F.count(x), F.skewness(x)).alias("skew"), F.count_if(x == 0).alias("zeros"),
        F.count_if((x < lower) | (x > upper)).alias("outliers"),
    )
    rows = {names[r.c]: r for r in found.collect()}
    if not rows:  # a table without rows
        return 0, dict.fromkeys(names, 0), {n: [None] * 12 + [0, None] for n in numbers}
    moments = {}
    for name in numbers:
        r, at = rows[name], spread[name]
        q1, median, q3, p99 = (at.get(p) for p in QUANTILES)
        outliers = r.outliers if name in ends else None
        moments[name] = [r.low, r.high, r.mean, r.total, median, q1, q3, p99, r.skew, *ends.get(name, (None, None)), outliers, r.zeros, at.get(POSITIVE_MEDIAN)]
    return max(r.rows for r in rows.values()), {n: rows[n].present for n in names}, moments
