"""The most frequent values of a column, exactly, without shuffling its other values.

A frequent-items sketch of ``TRACKED`` counters goes through the column once.  Sketches of tasks merge, and whatever
they let go of is bounded: a value's count is off by at most ``SLACK / TRACKED`` of all rows.  The values with the
largest estimates are candidates.  A second scan counts them, and sums up what else is asked of their rows; only these few values
are grouped.  The wanted leaders are proved if the last of them has more rows than any value that is no candidate can have.
Where that fails, as in a column without frequent values, all values are grouped once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_nested
from .measures import FAN_IN

TRACKED = 8192
SLACK = 3.5  # the sketch's bound: estimates are off by at most 3.5 / counters of the rows
CANDIDATES = 10  # times the wanted number


@dataclass(frozen=True)
class Leaders:
    """``rows`` has (value, count, mean) of the leaders, largest count first, then smallest value; ``proved`` by a sketch."""

    rows: list
    n_rows: int
    proved: bool


def leaders(df: DataFrame, name: str, n: int, measure: str | None = None) -> Leaders:
    """The ``n`` most frequent values, ties in value order, each with its rows and the mean of ``measure`` over them."""
    x = df.select(col(name).alias("value"), (F.lit(None).cast("double") if measure is None else col(measure)).alias("measure"))
    if not is_nested(df.schema[name].dataType):
        found = _by_sketch(x, n)
        if found is not None:
            return found
    whole = _counted(x.where("value IS NOT NULL"))
    total = df.count()
    return Leaders(_first(whole, n), total, False)


def _counted(x: DataFrame) -> DataFrame:
    return x.groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.avg("measure").alias("mean"))


def _first(counted: DataFrame, n: int) -> list:
    return counted.orderBy(F.desc("count"), F.asc("value")).limit(n).collect()


def _by_sketch(x: DataFrame, n: int) -> Leaders | None:
    wanted = CANDIDATES * n
    blank = x.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in x.schema.fields])  # merged states need one at least
    part = x.unionByName(blank).groupBy((F.spark_partition_id() % FAN_IN).alias("fan")).agg(
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("sketch"), F.count(F.lit(1)).alias("rows"), F.count("value").alias("present")
    )
    seen = part.agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {wanted + 1})").alias("top"), F.sum("rows").alias("rows"), F.sum("present").alias("present")
    ).collect()[0]
    n_rows = seen.rows - 1
    if not seen.present:
        return Leaders([], n_rows, True)
    candidates = [c for c in seen.top if c["item"] is not None][:wanted]  # missing cells are counted apart
    error = SLACK / TRACKED * seen.rows
    # no value outside the list is estimated above its end; a list that is not full leaves out only values within the error
    outside = (candidates[-1]["count"] if len(candidates) >= wanted else error) + error
    if seen.present <= TRACKED / 2 and len(candidates) < wanted:
        outside = 0  # the sketch has held every value
    if not candidates:
        return None
    counted = _counted(x.where(F.col("value").isin([c["item"] for c in candidates]))).orderBy(F.desc("count"), F.asc("value")).limit(n).collect()
    if len(counted) < n and outside >= 1:
        return None
    if counted[-1]["count"] <= outside:
        return None
    return Leaders(counted, n_rows, True)

