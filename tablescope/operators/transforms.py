"""Feature transforms: log, scaling, one-hot, date parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import col, is_date, is_number, nan_to_null, unbiased_skew
from .statistics import Ask, Request, answer_now, present
from .steps import StepResult, not_found, unchanged


def skew_of(df: DataFrame, *columns) -> list[float | None]:
    row = df.agg(*[unbiased_skew(F.count(c), F.skewness(c)) for c in columns]).collect()[0]
    return list(row)


def log_transform(df: DataFrame, name: str, ask: Ask = answer_now) -> StepResult:
    """``log1p`` into ``{name}_log``; refuses text and negative values."""
    if name not in df.columns:
        return not_found(df, name)
    if not is_number(df.schema[name].dataType):
        return unchanged(df, f"'{name}' is not a numeric column — log transform only works on numbers.")
    clean = nan_to_null(df)
    lowest = ask(df, Request("aggregate", present(df, name), make=lambda x: [F.min(x)]))[0]
    if lowest is not None and lowest < 0:
        return unchanged(df, f"'{name}' contains negative values. Log transform requires all values to be 0 or greater.")
    new = f"{name}_log"

    def sentence(_):
        before, after = (f"{s:.1f}" if s is not None else "nan" for s in skew_of(clean, col(name), F.log1p(col(name))))
        return f"Applied log scale to '{name}' → new column '{new}'. Value spread improved from {before} to {after} (closer to 0 is better)."

    return StepResult(df, lambda d: d.withColumn(new, F.log1p(col(name))), sentence)


def _scaled(df: DataFrame, name: str, suffix: str, sentence: str, shift, spread, ask: Ask) -> StepResult:
    """``(x - shift) / spread`` with missing cells taken as 0 first and no spread taken as 1.

    Both statistics come from one aggregate and enter the plan as literals.
    """
    if name not in df.columns:
        return not_found(df, name)
    if not is_number(df.schema[name].dataType):
        return unchanged(df, f"'{name}' is not a numeric column — scaling only works on numbers.")
    new = f"{name}_{suffix}"
    filled = F.coalesce(F.nanvl(col(name).cast("double"), F.lit(None)), F.lit(0.0))
    start, width = ask(df, Request("aggregate", filled, make=lambda x: [shift(x), spread(x)]))
    scaled = (filled - F.lit(start or 0.0)) / F.lit(width or 1.0)
    return StepResult(df, lambda d: d.withColumn(new, scaled), lambda _: sentence.format(name=name, new=new))


def standard_scale(df: DataFrame, name: str, ask: Ask = answer_now) -> StepResult:
    text = "Scaled '{name}' → new column '{new}'. Values now have mean ≈ 0 and standard deviation ≈ 1. Original column preserved."
    return _scaled(df, name, "scaled", text, F.avg, F.stddev_pop, ask)


def minmax_scale(df: DataFrame, name: str, ask: Ask = answer_now) -> StepResult:
    text = "Scaled '{name}' to 0–1 range → new column '{new}'. Original column preserved."
    return _scaled(df, name, "minmax", text, F.min, lambda x: F.max(x) - F.min(x), ask)


def one_hot_encode(df: DataFrame, name: str, ask: Ask = answer_now) -> StepResult:
    """Replace a column by sorted 0/1 columns, one per value; missing cells are 0 everywhere.

    At most one value more than the limit reaches the driver; a column with many values is refused by its sketch.
    """
    if name not in df.columns:
        return not_found(df, name)
    values = ask(df, Request("values", present(df, name), limit=V.ONE_HOT_LIMIT))
    if values is None:
        return unchanged(df, f"'{name}' has more than {V.ONE_HOT_LIMIT} unique values — too many for one-hot encoding.")
    values.sort()
    added = [f"{name}_{v}" for v in values]
    if len(set(added)) < len(added) or set(added) & (set(df.columns) - {name}):
        return unchanged(df, f"Encoding '{name}' would repeat a column name.")

    def transform(d: DataFrame) -> DataFrame:
        kept = [col(c) for c in d.columns if c != name]
        return d.select(*kept, *[F.coalesce((col(name) == F.lit(v)).cast("int"), F.lit(0)).alias(a) for v, a in zip(values, added)])

    text = f"Encoded '{name}' into {len(values)} yes/no columns for modeling. Original column removed."
    return StepResult(df, transform, lambda _: text)


def extract_date_part(df: DataFrame, name: str, part: str) -> StepResult:
    if name not in df.columns:
        return not_found(df, name)
    if not is_date(df.schema[name].dataType):
        return unchanged(df, f"'{name}' is not a date column. Make sure the column has been converted to a date format first.")
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth}
    if part not in parts:
        return unchanged(df, f"Unknown part '{part}'. Choose 'year', 'month', or 'day'.")
    new = f"{name}_{part}"
    return StepResult(df, lambda d: d.withColumn(new, parts[part](col(name))), lambda _: f"Extracted {part} from '{name}' → new column '{new}'.")
