"""Writing tables and reports, and the text form of a table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_date, is_nested, is_text


def export_name(prefix: str, extension: str, day: datetime.date | None = None) -> str:
    """``prefix_2024-07-15.csv``"""
    return f"{prefix}_{(day or datetime.date.today()).isoformat()}.{extension}"


def write_csv(df: DataFrame, folder: str, prefix: str, day: datetime.date | None = None) -> str:
    """Write a header CSV (doubled quotes, blanks kept, missing left empty) and return its path."""
    path = f"{folder.rstrip('/')}/{export_name(prefix, 'csv', day)}"
    texts = {f.name: F.to_json(col(f.name)) for f in df.schema.fields if is_nested(f.dataType)}
    texts |= {f.name: col(f.name).cast("string") for f in df.schema.fields if is_date(f.dataType)}
    (df.withColumns(texts) if texts else df).write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return path


def write_report(report: DataFrame, folder: str, prefix: str, day: datetime.date | None = None) -> str:
    """Write report lines in order as one text file (a report has a few hundred lines)."""
    path = f"{folder.rstrip('/')}/{export_name(prefix, 'txt', day)}"
    report.orderBy("line_no").select("line").coalesce(1).write.text(path)
    return path


def display_projection(df: DataFrame) -> DataFrame:
    """Dates as ``yyyy-MM-dd`` text, nested values as JSON, the rest unchanged."""
    shown = []
    for field in df.schema.fields:
        column = col(field.name)
        if is_date(field.dataType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif is_nested(field.dataType):
            column = F.to_json(column)
        elif not is_text(field.dataType) and field.dataType.typeName() in ("interval", "daytimeinterval", "yearmonthinterval"):
            column = column.cast("string")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows by an explicit key (a table has no order of its own)."""
    return display_projection(df.orderBy(col(key)).limit(n))
