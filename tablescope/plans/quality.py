"""Quality score, findings and column health: small expressions over the column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import count_text, fixed_text, grade, half_even, percent
from .duplicates import count_copies
from .measures import local_frame, together
from .profile import QUALITY_QUANTILES, Profile, missing_profile, profile
from .semantic import Table


def _capped(pct: Column, rate: float, cap: float) -> Column:
    return half_even(F.least(F.lit(cap), pct * rate), 2)


def missing_summary(found: Profile) -> DataFrame:
    """Missing cells of the whole table, the worst column and the points they cost."""
    cells = F.count(F.lit(1)) * F.lit(found.n_rows)
    worst = F.max_by("column", F.struct("missing", -F.col("ordinal")))
    summary = found.frame.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing"),
        percent(F.sum("missing"), cells, 4).alias("missing_pct"),
        F.count_if(F.col("missing") > 0).alias("cols_affected"),
        F.when(F.max("missing") > 0, worst).alias("worst_col"),
        percent(F.max("missing"), F.lit(found.n_rows), 1).alias("worst_col_pct"),
    )
    return summary.withColumn("penalty", _capped(F.col("missing_pct"), V.MISSING_PENALTY_RATE, V.MISSING_PENALTY_CAP))


def duplicate_summary(df: DataFrame, n_rows: int, n_copies: int | None = None) -> DataFrame:
    n_copies = count_copies(df) if n_copies is None else n_copies
    copies = local_frame(df.sparkSession, [(n_copies,)], "n_duplicates bigint")
    shared = copies.withColumn("duplicate_pct", percent(F.col("n_duplicates"), F.lit(n_rows), 2))
    return shared.withColumn("penalty", _capped(F.col("duplicate_pct"), V.DUPLICATE_PENALTY_RATE, V.DUPLICATE_PENALTY_CAP))


def numeric_health(found: Profile) -> DataFrame:
    """Skew, outliers, fences and extremes of every numeric column that holds values."""
    rows = found.frame.where("numeric AND present > 0")
    outlier_pct = percent(F.col("outliers"), F.col("present"), 1)
    highly_skewed = F.coalesce(F.abs("skewness") >= V.SKEW_LIMIT, F.lit(False))
    return rows.select(
        "ordinal",
        "column",
        half_even(F.col("skewness"), 2).alias("skewness"),
        highly_skewed.alias("is_highly_skewed"),
        F.col("outliers").alias("outlier_count"),
        outlier_pct.alias("outlier_pct"),
        (outlier_pct > V.MANY_OUTLIERS_PCT).alias("has_many_outliers"),
        half_even(F.col("lower_fence"), 2).alias("lower_fence"),
        half_even(F.col("upper_fence"), 2).alias("upper_fence"),
        half_even(F.col("p99"), 2).alias("p99"),
        half_even(F.col("maximum"), 2).alias("max_value"),
        is_extreme().alias("is_extreme"),
        F.least(F.lit(V.OUTLIER_PENALTY_CAP), outlier_pct * V.OUTLIER_PENALTY_RATE).alias("outlier_penalty"),
    )


def is_extreme() -> Column:
    return (F.col("p99") > 0) & (F.col("maximum") > F.col("p99") * V.EXTREME_FACTOR)


def score_parts(table: Table, given: Profile | None = None, n_copies: int | None = None) -> tuple[Profile, DataFrame]:
    """The profile used, and one row with every penalty, the score and the grade; what is given is not computed."""
    found, n_copies = together(
        lambda: given or profile(table.df, table.types, QUALITY_QUANTILES),
        lambda: count_copies(table.df) if n_copies is None else n_copies,
    )
    numeric = numeric_health(found).agg(
        F.coalesce(F.count_if("is_highly_skewed") * V.SKEW_PENALTY, F.lit(0.0)).alias("skew_penalty"),
        half_even(F.least(F.lit(V.OUTLIER_PENALTY_CAP), F.coalesce(F.sum("outlier_penalty"), F.lit(0.0))), 2).alias("outlier_penalty"),
    )
    missing = missing_summary(found).withColumnRenamed("penalty", "missing_penalty")
    copies = duplicate_summary(table.df, found.n_rows, n_copies).withColumnRenamed("penalty", "duplicate_penalty")
    penalties = F.col("missing_penalty") + F.col("duplicate_penalty") + F.col("skew_penalty") + F.col("outlier_penalty")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_even(100.0 - penalties, 1)))
    joined = missing.crossJoin(copies).crossJoin(numeric)
    return found, joined.select(
        F.lit(found.n_rows).cast("bigint").alias("n_rows"),
        F.lit(len(table.df.columns)).cast("bigint").alias("n_cols"),
        *joined.columns,
        score.alias("score"),
        grade(score).alias("grade"),
    )


def score_dataset(table: Table) -> DataFrame:
    return score_parts(table)[1].select(
        "n_rows", "n_cols", "missing_penalty", "duplicate_penalty", "skew_penalty", "outlier_penalty", "score", "grade"
    )


def glance(table: Table) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows."""
    found, n_copies = together(lambda: missing_profile(table.df), lambda: count_copies(table.df))
    copies = duplicate_summary(table.df, found.n_rows, n_copies).select("n_duplicates")
    return missing_summary(found).select("total_missing").crossJoin(copies).select(
        F.lit(found.n_rows).cast("bigint").alias("n_rows"),
        F.lit(len(table.df.columns)).cast("bigint").alias("n_cols"),
        "total_missing",
        "n_duplicates",
    )


def findings(table: Table, scored: tuple[Profile, DataFrame] | None = None) -> DataFrame:
    """Plain sentences: missing, duplicates, uneven columns, extremes, columns with many outliers."""
    found, score = scored or score_parts(table)
    health = numeric_health(found)
    level = lambda pct: F.when(pct < V.WARNING_BELOW_PCT, "warning").otherwise("problem")
    missing = score.select(
        F.lit(1).alias("section"),
        F.lit(0).alias("ordinal"),
        F.when(F.col("total_missing") == 0, "good").otherwise(level(F.col("missing_pct"))).alias("level"),
        F.when(F.col("total_missing") == 0, "No missing values — your data is complete.")
        .otherwise(
            F.concat(
                count_text(F.col("total_missing")), F.lit(" missing values found across "),
                F.col("cols_affected").cast("string"), F.lit(" column(s). The most affected column is '"),
                F.col("worst_col"), F.lit("' ("), F.col("worst_col_pct").cast("string"),
                F.lit("% empty). Fill or remove them before analysis."),
            )
        )
        .alias("message"),
    )
    copies = score.select(
        F.lit(2).alias("section"),
        F.lit(0).alias("ordinal"),
        F.when(F.col("n_duplicates") == 0, "good").otherwise(level(F.col("duplicate_pct"))).alias("level"),
        F.when(F.col("n_duplicates") == 0, "No duplicate rows found.")
        .otherwise(
            F.concat(
                count_text(F.col("n_duplicates")), F.lit(" duplicate rows detected ("), F.col("duplicate_pct").cast("string"),
                F.lit("% of your data). These are identical copies that can skew your results."),
            )
        )
        .alias("message"),
    )
    names = F.array_sort(F.collect_list(F.struct("ordinal", "column")))
    uneven = (
        health.where("is_highly_skewed")
        .agg(F.array_join(F.transform(names, lambda s: F.concat(F.lit("'"), s["column"], F.lit("'"))), ", ").alias("names"))
        .where("names <> ''")
        .select(
            F.lit(3).alias("section"),
            F.lit(0).alias("ordinal"),
            F.lit("warning").alias("level"),
            F.concat(
                F.lit("Some numeric columns have very uneven value distributions: "), F.col("names"),
                F.lit(". Most values are clustered at one end while a few are extreme."),
            ).alias("message"),
        )
    )
    extremes = health.where("is_extreme").select(
        F.lit(4).alias("section"),
        "ordinal",
        F.lit("warning").alias("level"),
        F.concat(
            F.lit("'"), F.col("column"), F.lit("' contains extreme values — the largest value ("),
            fixed_text(F.col("max_value"), 0), F.lit(") is far above the typical range."),
        ).alias("message"),
    )
    heavy = health.where("has_many_outliers AND NOT is_extreme").select(
        F.lit(5).alias("section"),
        "ordinal",
        F.lit("warning").alias("level"),
        F.concat(
            F.lit("'"), F.col("column"), F.lit("' has "), F.col("outlier_pct").cast("string"),
            F.lit("% of values outside the normal range ("), count_text(F.col("outlier_count")),
            F.lit(" values). These may be legitimate but are worth reviewing."),
        ).alias("message"),
    )
    parts = missing.unionByName(copies).unionByName(uneven).unionByName(extremes).unionByName(heavy)
    return parts.orderBy("section", "ordinal")


def column_health(table: Table, found: Profile | None = None) -> DataFrame:
    """Missing share, outlier share, spread and status of every numeric column that holds values."""
    found = found or profile(table.df, table.types, QUALITY_QUANTILES)
    missing_pct = percent(F.col("missing"), F.lit(found.n_rows), 1)
    outlier_pct = percent(F.col("outliers"), F.col("present"), 1)
    skew = F.abs("skewness")
    labels = F
    for semantic_type, label in V.TYPE_LABELS.items():
        labels = labels.when(F.col("semantic_type") == semantic_type, label)
    return (
        found.frame.where("numeric AND present > 0")
        .select(
            "ordinal",
            "column",
            labels.otherwise(V.OTHER_LABEL).alias("type"),
            "missing",
            missing_pct.alias("missing_pct"),
            "outliers",
            outlier_pct.alias("outlier_pct"),
            F.when(skew < V.EVEN_SKEW, "Even").when(skew < V.SKEW_LIMIT, "Slightly Uneven").otherwise("Very Uneven").alias("value_spread"),
            F.when((missing_pct > V.HEALTH_MISSING_PCT) | (outlier_pct > V.HEALTH_OUTLIER_PCT), "Needs Attention")
            .when(skew >= V.SKEW_LIMIT, "Acceptable")
            .otherwise("Healthy")
            .alias("status"),
        )
        .orderBy("ordinal")
    )
