"""What each column means: detected from its name and values, and expected from its values alone."""

from __future__ import annotations

import operator
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.columns import col, half_even, is_date, is_nested, is_number, is_text, nan_to_null
from .cardinality import doubtful, exact_distinct, uniqueness_doubtful
from .measures import Measure, distinct_estimate, gather, local_frame, rows, rows_where, together


@dataclass(frozen=True)
class Table:
    """A DataFrame with its semantic column types (text date columns already converted)."""

    df: DataFrame
    types: dict[str, str]

    def of_type(self, *wanted: str) -> list[str]:
        """Columns of the given types, in schema order."""
        return [c for c in self.df.columns if self.types[c] in wanted]


# --- Date text -------------------------------------------------------------------


def parse_date(column: Column, pattern: str) -> Column:
    """Timestamps without zone; text with an offset becomes the time in the session's zone."""
    read = F.when(column.rlike(V.DATE_FORMATS[pattern]), F.try_to_timestamp(column, F.lit(pattern))).cast("timestamp_ntz")
    if "yyyy" in pattern:
        return read
    return F.when(F.year(read) > V.LAST_TWO_DIGIT_YEAR, read - F.expr("INTERVAL 100 YEARS")).otherwise(read)


def outline(value: Column) -> Column:
    """A text without digits, small letters and line ends, its capitals as A."""
    capitals = string.ascii_uppercase
    return F.translate(value, capitals + string.ascii_lowercase + string.digits + V.LINE_ENDS, "A" * len(capitals))


def fitting_formats(value: Column, outlined: Column) -> Column:
    """Bit set of the formats that a text reads in, numbered in their order; only formats of its outline are tried."""
    number = {p: i for i, p in enumerate(V.DATE_FORMATS)}
    fits = F.lit(0)
    for marks in dict.fromkeys(m for every in V.DATE_OUTLINES.values() for m in every):
        tried = [F.when(parse_date(value, p).isNotNull(), 1 << number[p]).otherwise(0) for p, every in V.DATE_OUTLINES.items() if marks in every]
        fits = F.when(outlined == marks, reduce(operator.add, tried)).otherwise(fits)
    return fits


def format_votes(df: DataFrame, names: list[str]) -> dict[tuple, int]:
    """How many values of each column read in each format, as ``("date", column, format)``.

    Columns are in long form and every value casts one vote, its bit set; votes are counted per column, and the few sets that
    occur are added up here.  So the compiled code and the states do not grow with formats times columns.
    """
    counts = dict.fromkeys([("date", n, p) for n in names for p in V.DATE_FORMATS], 0)
    if not names:
        return counts
    cells = df.select(F.posexplode(F.array(*[col(n) for n in names])).alias("c", "v")).where("v IS NOT NULL")
    outlined = cells.select("c", "v", outline(F.col("v")).alias("o"))
    # sets without a format are counted too: a filter on the set would be pushed down and work out every set twice
    votes = outlined.select("c", fitting_formats(F.col("v"), F.col("o")).alias("set")).groupBy("c", "set").agg(F.count(F.lit(1)).alias("n"))
    for r in votes.collect():
        for i, p in enumerate(V.DATE_FORMATS):
            if r.set >> i & 1:
                counts["date", names[r.c], p] += r.n
    return counts


def _best_format(seen: dict, name: str, n_rows: int) -> tuple[str, int]:
    """The strict format if half of the rows match it, else the format most rows match."""
    counts = {p: seen[("date", name, p)] for p in V.DATE_FORMATS}
    if counts[V.STRICT_DATE_FORMAT] >= V.STRICT_DATE_SHARE * n_rows:
        return V.STRICT_DATE_FORMAT, counts[V.STRICT_DATE_FORMAT]
    best = max((p for p in V.DATE_FORMATS if p != V.STRICT_DATE_FORMAT), key=lambda p: counts[p])
    return best, counts[best]


def convert_date(df: DataFrame, name: str) -> DataFrame:
    """Replace a text column by timestamps if enough of all rows read as dates, else leave it."""
    seen = {"rows": df.count()} | format_votes(df, [name])
    pattern = _accepted_format(seen, name)
    return df if pattern is None else df.withColumn(name, parse_date(col(name), pattern))


def _accepted_format(seen: dict, name: str) -> str | None:
    pattern, count = _best_format(seen, name, seen["rows"])
    return pattern if seen["rows"] and count >= V.ACCEPT_DATE_SHARE * seen["rows"] else None


# --- Detection ---------------------------------------------------------------------


def detect(df: DataFrame) -> Table:
    """Classify every column; one job, plus one exact count for columns close to a threshold."""
    df = nan_to_null(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    texts = [n for n, t in fields.items() if is_text(t)]
    dated = [n for n in texts if V.has_keyword(n, V.DATE_KEYWORDS)]
    named_id = [n for n, t in fields.items() if _countable(t) and V.has_keyword(n, V.ID_KEYWORDS)]
    counted = [n for n in fields if n in texts or n in named_id]
    measures: dict = {"rows": rows()}
    for name in counted:
        measures[("present", name)] = rows_where(col(name).isNotNull())
        measures[("distinct", name)] = distinct_estimate(col(name))
    seen, votes = together(lambda: gather(df, measures), lambda: format_votes(df, dated))
    seen |= votes
    unsure = [
        n
        for n in counted
        if (n in texts and doubtful(seen[("distinct", n)], V.CATEGORY_LIMIT))
        or (n in named_id and uniqueness_doubtful(seen[("distinct", n)], seen[("present", n)], V.ID_UNIQUENESS))
    ]
    distinct = {n: seen[("distinct", n)] for n in counted} | (exact_distinct(df, unsure) if unsure else {})
    formats = {n: _accepted_format(seen, n) for n in dated}
    types = {}
    for name, dtype in fields.items():
        unique = bool(seen.get(("present", name))) and distinct[name] / seen[("present", name)] >= V.ID_UNIQUENESS
        types[name] = "date_column" if formats.get(name) else _classify(name, dtype, distinct.get(name), unique)
    dates = {n: parse_date(col(n), p) for n, p in formats.items() if p}
    return Table(df.withColumns(dates) if dates else df, types)


def _countable(dtype: T.DataType) -> bool:
    return is_text(dtype) or is_number(dtype) or isinstance(dtype, T.BooleanType)


def _classify(name: str, dtype: T.DataType, distinct: int | None, unique: bool) -> str:
    """The first rule that fits; booleans count as numeric here."""
    if is_date(dtype):
        return "date_column"
    if is_nested(dtype):
        return "nested"
    text, number = is_text(dtype), is_number(dtype) or isinstance(dtype, T.BooleanType)
    if V.has_keyword(name, V.ID_KEYWORDS) and unique:
        return "id_column"
    if number:
        return "financial" if V.has_keyword(name, V.FINANCIAL_KEYWORDS) else "metric"
    if text and distinct > V.CATEGORY_LIMIT:
        return "text" if V.has_keyword(name, V.TEXT_KEYWORDS) else "high_cardinality"
    return "categorical"


def types_frame(table: Table) -> DataFrame:
    lines = [(i, n, table.types[n], V.type_label(table.types[n])) for i, n in enumerate(table.df.columns)]
    return local_frame(table.df.sparkSession, lines, "ordinal int, column string, semantic_type string, label string")


def type_summary(table: Table) -> DataFrame:
    return types_frame(table).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("columns"))


def column_inventory(table: Table) -> DataFrame:
    """Column, label, exact distinct values (missing excluded) and missing cells."""
    df = table.df
    distinct, seen = together(
        lambda: exact_distinct(df, df.columns), lambda: gather(df, {n: rows_where(col(n).isNull()) for n in df.columns})
    )
    lines = [(i, n, V.type_label(table.types[n]), distinct[n], seen[n]) for i, n in enumerate(df.columns)]
    ddl = "ordinal int, column string, detected_as string, unique_values bigint, missing bigint"
    return local_frame(df.sparkSession, lines, ddl)


# --- Expected types -------------------------------------------------------------------


def _numeric_looking(name: str, dtype: T.DataType) -> Column:
    """Whether the value prints as plain digits; floats print an exponent when very large or small."""
    if is_text(dtype):
        return col(name).rlike(V.NUMERIC_TEXT_PATTERN)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        size = F.abs(col(name))
        return (size == 0) | ((size >= 1e-4) & (size < 1e16))
    return col(name).isNotNull()


def _shape_measures(name: str, dtype: T.DataType) -> dict[tuple, Measure]:
    """How many values look like numbers or money."""
    measures: dict[tuple, Measure] = {("shaped", name): rows_where(col(name).isNotNull())}
    if is_text(dtype) or is_number(dtype):
        measures[("numeric", name)] = rows_where(_numeric_looking(name, dtype))
    if is_text(dtype):
        measures[("currency", name)] = rows_where(col(name).rlike(V.CURRENCY_TEXT_PATTERN))
    return measures


def expected_types(df: DataFrame, sample_rows: int | None = None, order_by: str | None = None) -> DataFrame:
    """The type the values themselves suggest.

    Shapes are judged on every non-missing value, or on the first ``sample_rows`` of each column in
    the order of a key; uniqueness always on all values.
    """
    df = nan_to_null(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    shapes = {name: _shape_measures(name, dtype) for name, dtype in fields.items()}
    measures: dict = {"rows": rows()}
    for name, dtype in fields.items():
        measures[("present", name)] = rows_where(col(name).isNotNull())
        if not is_nested(dtype):
            measures[("distinct", name)] = distinct_estimate(col(name))
    texts = [n for n, t in fields.items() if is_text(t)]
    if sample_rows is None:
        found = together(lambda: gather(df, measures | {k: m for shape in shapes.values() for k, m in shape.items()}), lambda: format_votes(df, texts))
        seen = found[0] | found[1]
    else:
        first = {n: df.where(col(n).isNotNull()).orderBy(col(order_by)).limit(sample_rows).select(col(n)) for n in fields}
        votes = [lambda n=n: format_votes(first[n], [n]) for n in texts]
        found = together(lambda: gather(df, measures), *votes, *[lambda n=n: gather(first[n], {"rows": rows()} | shapes[n]) for n in fields])
        seen = {k: v for part in found[1:] for k, v in part.items() if k != "rows"} | found[0]
    unsure = []
    for name, dtype in fields.items():
        if not is_nested(dtype):
            estimate, present = seen[("distinct", name)], seen[("present", name)]
            if estimate <= 2 or uniqueness_doubtful(estimate, present, V.EXPECTED_ID_UNIQUENESS):
                unsure.append(name)
    distinct = {n: seen.get(("distinct", n)) for n in fields} | exact_distinct(df, unsure)
    lines = []
    for ordinal, (name, dtype) in enumerate(fields.items()):
        present = seen[("present", name)]
        lines.append((ordinal, name, _expect(seen, name, dtype, distinct[name]), seen["rows"] - present, seen["rows"], distinct[name]))
    ddl = "ordinal int, column string, expected string, missing bigint, n_rows bigint, distinct_values bigint"
    return local_frame(df.sparkSession, lines, ddl)


def _expect(seen: dict, name: str, dtype: T.DataType, distinct: int | None) -> str:
    present, shaped = seen[("present", name)], seen[("shaped", name)]
    if not present:
        return "categorical"
    if seen.get(("numeric", name), 0) / shaped >= V.EXPECTED_NUMERIC_SHARE:
        return "metric"
    if seen.get(("currency", name), 0) / shaped >= V.EXPECTED_CURRENCY_SHARE:
        return "financial"
    dates = shaped if is_date(dtype) else _best_format(seen, name, shaped)[1] if is_text(dtype) else 0
    if dates / shaped >= V.EXPECTED_DATE_SHARE:
        return "date_column"
    if distinct is not None and distinct / present >= V.EXPECTED_ID_UNIQUENESS:
        return "id_column"
    return "categorical"


def recommendations(table: Table) -> DataFrame:
    """Columns whose values disagree with their detected type, are mostly missing or hold one value.

    The last rule that fits gives the text.
    """
    joined = types_frame(table).join(expected_types(table.df).drop("ordinal"), "column")
    detected, expected = F.col("semantic_type"), F.col("expected")
    missing_pct = F.when(F.col("n_rows") > 0, F.col("missing") / F.col("n_rows") * 100)
    text = (
        F.when(F.col("distinct_values") <= V.RECOMMEND_MIN_DISTINCT, "Column has only one unique value. Consider removing.")
        .when(
            missing_pct >= V.RECOMMEND_MISSING_PCT,
            F.concat(F.lit("Column is "), half_even(missing_pct, 1).cast("string"), F.lit("% missing. Consider filling or removing.")),
        )
        .when(
            (detected == "categorical") & expected.isin("metric", "financial"),
            "Values appear numeric but are stored as text. Consider converting to numeric.",
        )
        .when(
            (detected == "categorical") & (expected == "date_column"),
            "Values appear to be dates. Consider converting to datetime.",
        )
        .when(
            (detected == "metric") & (expected == "id_column"),
            "High uniqueness suggests this is an identifier. Consider excluding from analysis.",
        )
    )
    return (
        joined.select("ordinal", "column", detected.alias("detected"), "expected", text.alias("recommendation"))
        .where("recommendation IS NOT NULL")
        .orderBy("ordinal")
    )
