"""Cleaning steps: rows, missing values, text, currency and columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    col, currency_number, is_date, is_float, is_nested, is_number, is_text, missing, nan_to_null, strip_text,
    title_text,
)
from ..plans.duplicates import distinct_rows, preview_copies
from .statistics import Ask, Request, answer_now, present
from .steps import StepResult, not_found, unchanged

FILL_STRATEGIES = ("mean", "median", "mode", "constant")


def remove_duplicates(df: DataFrame, row_id: str | None = None) -> StepResult:
    """Keep one row of each set of equal rows; with ``row_id``, the one with the lowest id."""

    def sentence(c):
        if not c.rows_removed:
            return "No duplicate rows found — nothing to remove."
        return f"Removed {c.rows_removed:,} duplicate row(s). Dataset now has {c.rows_after:,} rows."

    return StepResult(df, lambda d: distinct_rows(nan_to_null(d), row_id), sentence, drops_rows=True)


def duplicate_preview(df: DataFrame, row_id: str, limit: int = 50) -> DataFrame:
    """All copies side by side, first ``limit`` rows, with their row number."""
    return preview_copies(nan_to_null(df), row_id, limit)


def drop_column(df: DataFrame, name: str) -> StepResult:
    if name not in df.columns:
        return not_found(df, name)
    text = f"Removed column '{name}'. Dataset now has {len(df.columns) - 1} columns."
    return StepResult(df, lambda d: d.drop(name), lambda _: text)


def rename_column(df: DataFrame, old: str, new: str) -> StepResult:
    if old not in df.columns:
        return not_found(df, old)
    if new in df.columns and new != old:
        return unchanged(df, f"A column named '{new}' already exists. Please choose a different name.")
    return StepResult(df, lambda d: d.withColumnRenamed(old, new), lambda _: f"Renamed column '{old}' to '{new}'.")


def fill_missing(
    df: DataFrame, name: str, strategy: str, value: Any = None, semantic_type: str | None = None, rank_error: float | None = None, ask: Ask = answer_now
) -> StepResult:
    """Fill missing cells with the mean, median, most common or a given value.

    The value is found first and enters the plan as a literal: plans of long recipes stay small, and
    the count of filled cells is still left to whoever asks for it.  With ``rank_error`` the median may be a value whose
    rank is off by that share of the present cells; the share is checked, not trusted.  Decimal columns stay decimal
    (the filled value is rounded to their scale), whole numbers become doubles, nested columns have no most common value.
    """
    if name not in df.columns:
        return not_found(df, name)
    dtype = df.schema[name].dataType
    if strategy not in FILL_STRATEGIES:
        return unchanged(df, f"Unknown strategy '{strategy}'. Nothing was changed.")
    if (semantic_type == "date_column" or is_date(dtype)) and strategy != "mode":
        return unchanged(df, f"'{name}' is a date column: fill it with the most common date or remove the rows.")
    if strategy in ("mean", "median") and not is_number(dtype):
        return unchanged(df, f"'{name}' is not a numeric column — it has no {strategy}.")
    if strategy == "mode" and is_nested(dtype):
        return unchanged(df, f"'{name}' holds nested values — it has no most common value.")
    if strategy == "constant" and value is None:
        return unchanged(df, "No fill value provided for constant strategy.")
    cells, exact = present(df, name), isinstance(dtype, T.DecimalType)
    if strategy in ("mean", "median"):
        if strategy == "mean":
            found = ask(df, Request("aggregate", cells, make=lambda x: [F.avg(x)]))[0]
        else:
            found = ask(df, Request("quantile", cells, p=0.5, rank_error=rank_error))
        if found is None:
            return unchanged(df, f"'{name}' has no values — it has no {strategy}.")
        fill = F.lit(found).cast(dtype) if exact else F.lit(float(found))
        words = f"the {'column average' if strategy == 'mean' else 'median value'} ({found:,.2f})"
    elif strategy == "mode":
        found = ask(df, Request("mode", cells, dtype))
        if found is None:
            return unchanged(df, f"Could not determine a mode for '{name}'.")
        fill, words = F.lit(found).cast(dtype), f"the most common value ('{found}')"
    else:
        fill = constant_for(dtype, value)
        if fill is None:
            return unchanged(df, f"The value '{value}' does not fit the type of '{name}'.")
        words = f"the value '{value}'"
    whole = is_number(dtype) and not is_float(dtype) and not exact and strategy in ("mean", "median")
    kept = F.when(~missing(df, name), col(name).cast("double") if whole else col(name))

    def sentence(c):
        if not c.cells_changed:
            return f"'{name}' has no missing values — nothing to fill."
        return f"Filled {c.cells_changed:,} missing value(s) in '{name}' with {words}."

    return StepResult(df, lambda d: d.withColumn(name, F.coalesce(kept, fill)), sentence, touched=missing(df, name))


def typed_constant(text: str) -> Any:
    """Numeric text becomes a whole number or a float, other text stays text."""
    try:
        number = float(text)
    except ValueError:
        return text
    return int(number) if number.is_integer() else number


def constant_for(dtype: T.DataType, value: Any) -> Column | None:
    """The constant as a literal of the column's own type, or None if it does not fit."""
    if is_text(dtype):
        return F.lit(str(value))
    if isinstance(dtype, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if is_number(dtype) and isinstance(value, (int, float)) and not isinstance(value, bool):
        whole = not is_float(dtype) and not isinstance(dtype, T.DecimalType)
        if whole and not float(value).is_integer():
            return None
        return F.lit(int(value) if whole else value).cast(dtype)
    return None


def drop_missing_rows(df: DataFrame, name: str | None = None) -> StepResult:
    """Remove rows where one column, or any column, is missing."""
    if name is not None and name not in df.columns:
        return not_found(df, name)
    scope = "in any column" if name is None else f"in '{name}'"

    def sentence(c):
        if not c.rows_removed:
            return f"No rows with missing values found {scope}."
        return f"Removed {c.rows_removed:,} row(s) with missing values {scope}. Dataset now has {c.rows_after:,} rows."

    def transform(d: DataFrame) -> DataFrame:
        return d.na.drop("any") if name is None else d.where(~missing(d, name))

    return StepResult(df, transform, sentence, drops_rows=True)


def _text_step(df: DataFrame, name: str, make, sentence: str) -> StepResult:
    if name not in df.columns:
        return not_found(df, name)
    if not is_text(df.schema[name].dataType):
        return unchanged(df, f"'{name}' is not a text column — nothing was changed.")
    new = make(col(name))
    return StepResult(df, lambda d: d.withColumn(name, new), lambda _: sentence, touched=~new.cast("string").eqNullSafe(col(name)))


def trim_whitespace(df: DataFrame, name: str) -> StepResult:
    return _text_step(df, name, strip_text, f"Trimmed extra whitespace from all values in '{name}'.")


def standardize_case(df: DataFrame, name: str, case: str = "title") -> StepResult:
    makers = {"title": (title_text, "Title Case"), "lower": (F.lower, "lowercase"), "upper": (F.upper, "UPPERCASE")}
    if case not in makers:
        return unchanged(df, f"Unknown case '{case}'. Choose 'title', 'lower', or 'upper'.")
    make, words = makers[case]
    return _text_step(df, name, make, f"Standardized '{name}' text to {words}.")


def currency_to_number(df: DataFrame, name: str) -> StepResult:
    return _text_step(df, name, currency_number, f"Converted '{name}' from currency/text to numeric.")
