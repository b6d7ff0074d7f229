"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V

_FLOATS = (T.FloatType, T.DoubleType)
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# Fixed patterns.
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"
INTEGER_TEXT = r"^[+-]?\d+$"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"
CURRENCY_MARKS = r"(?U)[\$,€£¥\s()]"


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATS)


def is_number(dtype: T.DataType) -> bool:
    """Numeric for statistics; booleans are not."""
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATES)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def missing(df: DataFrame, name: str) -> Column:
    """NULL or NaN; ``isnan`` is only applied to float columns."""
    column = col(name)
    if is_float(df.schema[name].dataType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """One meaning of missing: every float NaN becomes NULL (a projection, no job)."""
    if not any(is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name) if is_float(f.dataType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def strip_text(column: Column) -> Column:
    """Strip every Unicode blank from both ends, not only spaces."""
    return F.regexp_replace(column, EDGE_WHITESPACE, "")


def title_text(column: Column) -> Column:
    """Capital after anything that is not a letter: ``it's a-b`` -> ``It'S A-B``."""
    letters = F.split(column, "")
    before = F.concat(F.array(F.lit("")), letters)
    return F.array_join(
        F.zip_with(
            letters,
            F.slice(before, F.lit(1), F.size(letters)),
            lambda here, prior: F.when(prior.rlike(r"\p{L}"), F.lower(here)).otherwise(F.upper(here)),
        ),
        "",
    )


def plain_number(column: Column) -> Column:
    """Text to double; text that is not a plain decimal number gives NULL (also ``1d``, ``inf``)."""
    return F.when(column.rlike(NUMBER_TEXT), column.try_cast("double"))


def currency_number(column: Column) -> Column:
    """``$1,234.50`` -> 1234.5 and ``($2,350.00)`` -> -2350; anything unreadable gives NULL."""
    text = strip_text(column)
    digits = F.regexp_replace(text, CURRENCY_MARKS, "")
    signed = F.when(text.startswith("(") & text.endswith(")"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return plain_number(signed)


def unbiased_skew(n: Column, population_skew: Column) -> Column:
    """Bias-corrected skewness; NULL under three values, 0 for a constant column."""
    size = n.cast("double")
    factor = F.sqrt(size * (size - 1)) / (size - 2)
    return F.when(n >= 3, F.coalesce(factor * population_skew, F.lit(0.0)))


def half_even(column: Column, digits: int) -> Column:
    return F.bround(column, digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage; 0 when there is nothing to divide by."""
    return F.when(whole > 0, half_even(part / whole * 100, digits)).otherwise(F.lit(0.0))


def _formatted(pattern: str, value: Column) -> Column:
    """NULL stays NULL (``format_string`` would print it)."""
    return F.when(value.isNotNull(), F.format_string(pattern, value))


def count_text(column: Column) -> Column:
    return _formatted("%,d", column.cast("bigint"))


def fixed_text(column: Column, digits: int) -> Column:
    return _formatted(f"%,.{digits}f", half_even(column.cast("double"), digits))


def value_text(column: Column, name: str) -> Column:
    """Money, percentage or plain number, chosen from the column name."""
    if V.has_keyword(name, V.MONEY_NAME_HINTS):
        return F.concat(F.lit("$"), fixed_text(column, 2))
    if V.has_keyword(name, V.PERCENT_NAME_HINTS):
        return F.concat(_formatted("%.1f", half_even(column.cast("double"), 1)), F.lit("%"))
    return fixed_text(column, 1)


def contains_any(column: Column, words: Iterable[str]) -> Column:
    return F.lower(column).rlike("|".join(words))


def grade(score: Column) -> Column:
    ladder = F
    for floor, word in V.GRADES:
        ladder = ladder.when(score >= floor, word)
    return ladder.otherwise(V.LOWEST_GRADE)


def holds_map(dtype: T.DataType) -> bool:
    """Whether values of the type cannot be grouped because a map or variant is in them."""
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def comparable(df: DataFrame, name: str) -> Column:
    """A form of the column that can be grouped and hashed the way values compare equal."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.MapType) and not holds_map(dtype.valueType):
        return F.to_json(F.array_sort(F.map_entries(col(name))))
    if holds_map(dtype):
        return F.to_json(col(name))
    if is_float(dtype):
        return F.when(F.isnan(col(name)), None).otherwise(F.when(col(name) == 0, F.lit(0.0)).otherwise(col(name))).cast(dtype)
    return col(name)
