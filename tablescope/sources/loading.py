"""Reading tables: CSV scan, header trim, missing tokens and whole-column type inference."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import BOOLEAN_TEXT, INTEGER_TEXT, NUMBER_TEXT, col, is_text, nan_to_null, plain_number
from ..plans.measures import Measure, gather
from ..plans.semantic import Table, detect
from ..session import scratch_path


def trim_header(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; names that become equal are refused."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("trimming the header makes column names equal")
    return df if names == df.columns else df.toDF(*names)


def null_tokens(df: DataFrame, tokens: Sequence[str] = V.NULL_TOKENS) -> DataFrame:
    """Missing-value words in text columns become NULL (a projection; works on streams)."""
    texts = {f.name: f.dataType for f in df.schema.fields if is_text(f.dataType)}
    return df.withColumns({n: F.when(~col(n).isin(*tokens), col(n)) for n in texts}) if texts else df


def _unlike(value: Column) -> Column:
    """Bits of the kinds that a text is not of (fits 64 bits, all digits, number, true or false); null without text."""
    no = lambda test, bit: F.when(test, 0).otherwise(bit)
    fits = value.rlike(INTEGER_TEXT) & value.try_cast("bigint").isNotNull()
    bits = no(fits, 1) + no(value.rlike(INTEGER_TEXT), 2) + no(value.rlike(NUMBER_TEXT), 4) + no(value.rlike(BOOLEAN_TEXT), 8)
    return F.when(value.isNotNull(), bits)


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column the narrowest type that every non-missing value has.

    Whole numbers, numbers, true/false, else text; a column without values becomes numeric.  Whole numbers of which one
    does not fit 64 bits stay text: as doubles, different ids would become one.  One aggregate per column.
    """
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not texts:
        return df
    against = {"bigint": 1, "digits": 2, "double": 4, "boolean": 8}  # bits: some value is not of this kind
    seen = gather(df, {n: Measure(F.bit_or(_unlike(col(n))), "bit_or({})") for n in texts})
    typed: dict[str, Column] = {}
    for name in texts:
        kind = "double" if seen[name] is None else next((k for k, bit in against.items() if not seen[name] & bit), None)
        if kind == "double":
            typed[name] = plain_number(col(name))
        elif kind in ("bigint", "boolean"):
            typed[name] = col(name).try_cast(kind)
    return df.withColumns(typed) if typed else df


def odd_files(spark: SparkSession, path: str) -> list[str]:
    """Files of which some line has an odd number of quotes: only in these can a quoted field hold a line break.

    One scan; what reaches the driver is one path for each such file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return [_place(r.file) for r in lines.where(quotes % 2 == 1).select("file").distinct().collect()]


def _place(uri: str) -> str:
    """One spelling of a file's place: unescaped, and one slash where it names no host."""
    return re.sub(r"^([\w+.-]+):///+", r"\1:/", unquote(uri))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether any quoted field may hold a line break."""
    return bool(odd_files(spark, path))


def scan_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as text.  Files are read in splits; only those with an odd line of quotes are read as a whole, each by
    one task.  Columns are taken by position, named by the first header.  ``multi_line`` sets it for all files."""

    def read(paths, whole: bool, schema=None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.csv(paths, header=True, quote='"', escape='"', multiLine=whole, encoding="UTF-8")

    odd = odd_files(spark, path) if multi_line is None else []
    plain = read(path, bool(multi_line))
    if not odd:
        return plain
    whole = read(path, True)  # the header itself may hold a quoted line break
    even = sorted(set(map(_place, whole.inputFiles())) - set(odd))
    parts = ([read(even, False, whole.schema)] if even else []) + [read(sorted(odd), True, whole.schema)]
    return reduce(DataFrame.union, parts)


def prepare(df: DataFrame, tokens: Sequence[str] = V.NULL_TOKENS) -> Table:
    """Normalise a DataFrame (header, missing values) and classify its columns."""
    return detect(nan_to_null(null_tokens(trim_header(df), tokens)))


def load_csv(spark: SparkSession, path: str, staged: bool = True) -> Table:
    """Read, normalise, type and classify a CSV table.

    Later steps scan the table several times, so by default the typed rows are written once, in
    columns, to the shared scratch folder.
    """
    typed = infer_types(null_tokens(trim_header(scan_csv(spark, path))))
    if staged:
        stage = scratch_path(spark, "stage")
        typed.write.parquet(stage)
        typed = spark.read.parquet(stage)
    return detect(typed)
