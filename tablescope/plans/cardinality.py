"""Distinct counts: a sketch where it decides, an exact count where it does not.

Exact counts of many columns are one grouping in long form: a row becomes (column number, 128-bit hash of the value) cells,
equal cells collapse in the map tasks, then once more where the hashes meet, and the second level counts what is left for
each column.  So a cell in the shuffle is 20 bytes whatever the number and the width of the columns, a common value is one
row per task, and a job counts all columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, comparable, is_nested
from .measures import DISTINCT_LOG_SIZE

# Relative width around a threshold inside which a sketch is not believed, above four of its standard errors (0.83 /
# sqrt(2^14) is 0.0065).  A unique column, whose estimate is around all of its values, is clear of a threshold of 0.95.
DOUBT = 0.03
HELD = 1024


def exact_distinct(df: DataFrame, names: Sequence[str]) -> dict[str, int | None]:
    """Exact distinct non-missing values; nested columns have none (their values do not compare)."""
    found: dict[str, int | None] = {n: None for n in names if is_nested(df.schema[n].dataType)}
    plain = [n for n in names if n not in found]
    if not plain:
        return found
    values = [comparable(df, n) for n in plain]
    hashes = [F.when(v.isNotNull(), F.struct(F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))) for v in values]
    cells = df.select(F.posexplode(F.array(*hashes)).alias("c", "h")).where("h IS NOT NULL").select("c", "h.h1", "h.h2")
    counts = cells.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return found | dict.fromkeys(plain, 0) | {plain[r.c]: r.n for r in counts.collect()}


def at_most(df: DataFrame, name: str, limit: int) -> list | None:
    """The distinct values of a column, or None where there are more than ``limit``.

    One scan with two small states: a sketch of how many values there are, exact for as few as a limit has, and a frequent-items
    sketch that holds every value until there are ``HELD`` of them.  So no value is shuffled.
    """
    value = F.when(col(name).isNotNull(), F.xxhash64(comparable(df, name)))
    present = df.select(col(name).alias("v"), value.alias("h")).where("v IS NOT NULL")
    if is_nested(df.schema[name].dataType) or limit >= HELD // 2:
        values = [r[0] for r in present.select("v").distinct().limit(limit + 1).collect()]
        return values if len(values) <= limit else None
    held = present.agg(F.hll_sketch_estimate(F.hll_sketch_agg("h", F.lit(DISTINCT_LOG_SIZE))).alias("n"), F.expr(f"approx_top_k(v, {limit + 1}, {HELD})").alias("top"))
    row = held.collect()[0]
    return None if (row.n or 0) > limit or len(row.top) > limit else [t["item"] for t in row.top if t["item"] is not None]


def doubtful(estimate: float, threshold: float) -> bool:
    return threshold * (1 - DOUBT) - 2 <= estimate <= threshold * (1 + DOUBT) + 2


def uniqueness_doubtful(estimate: float, size: int, threshold: float) -> bool:
    return size > 0 and abs(estimate / size - threshold) <= DOUBT
