"""Whole-table aggregates that stay cheap to merge on many executors.

Sketches weigh kilobytes, so sending one partial state per input task to a single reducer does not
scale.  ``gather`` first merges the states of the input tasks in ``FAN_IN`` groups (the group is the
task number, so no row moves), then merges the few group results.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FAN_IN = 256
DISTINCT_LOG_SIZE = 14
# More aggregates than this in one job outgrow the method size the JVM compiles.  A batch reads only
# its own columns, so a columnar source is still read once.
AGGREGATES_PER_JOB = 24
JOBS_AT_ONCE = 4


def together(*calls: Callable[[], Any]) -> list[Any]:
    """Run independent driver calls at the same time, so that their jobs share the cluster."""
    if len(calls) < 2:
        return [call() for call in calls]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return [future.result() for future in [pool.submit(inherit(call)) for call in calls]]


class Measure(NamedTuple):
    """An aggregate, and SQL templates to merge its partial results and to finish the merged one."""

    partial: Column
    merge: str
    finish: str = "{}"


def rows() -> Measure:
    return Measure(F.count(F.lit(1)), "sum({})", "coalesce({}, 0)")


def rows_where(condition: str | Column) -> Measure:
    """Rows that satisfy a condition, given as SQL text or as a column."""
    counted = F.expr(f"count(1) FILTER (WHERE {condition})") if isinstance(condition, str) else F.count_if(condition)
    return Measure(counted, "sum({})", "coalesce({}, 0)")


def sized_sketch(column: str, size: int, condition: str = "true") -> Measure:
    """A quantile sketch of a double column, with the number of values it has seen.

    The FILTER is compiled, so values outside cost no call into the sketch.
    """
    return Measure(
        F.expr(f"kll_sketch_agg_double({column}, {size}) FILTER (WHERE {condition})"),
        f"kll_merge_agg_double({{}}, {size})",
        "struct(coalesce(kll_sketch_get_n_double({0}), 0) AS n, {0} AS sketch)",
    )


def distinct_estimate(column: Column) -> Measure:
    hashed = F.when(column.isNotNull(), F.xxhash64(column))
    return Measure(
        F.hll_sketch_agg(hashed, F.lit(DISTINCT_LOG_SIZE)), "hll_union_agg({})", "coalesce(hll_sketch_estimate({}), 0)"
    )


def _batches(keys: list[Any]) -> list[list[Any]]:
    return [keys[i : i + AGGREGATES_PER_JOB] for i in range(0, len(keys), AGGREGATES_PER_JOB)]


def _gather_batch(df: DataFrame, measures: list[Measure]) -> tuple:
    names = [f"m{i}" for i in range(len(measures))]
    partial = df.groupBy((F.spark_partition_id() % FAN_IN).alias("fan")).agg(
        *[m.partial.alias(n) for m, n in zip(measures, names)]
    )
    merged = partial.selectExpr(*[f"{m.merge.format(n)} AS {n}" for m, n in zip(measures, names)])
    return merged.selectExpr(*[f"{m.finish.format(n)} AS {n}" for m, n in zip(measures, names)]).collect()[0]


def gather(df: DataFrame, measures: dict[Any, Measure]) -> dict[Any, Any]:
    """Evaluate named measures over the whole table; one job per batch of them, side by side."""
    batches = _batches(list(measures))
    found = together(*[lambda b=b: _gather_batch(df, [measures[k] for k in b]) for b in batches])
    return {key: value for batch, row in zip(batches, found) for key, value in zip(batch, row)}


def aggregate(df: DataFrame, parts: dict[Any, Column]) -> dict[Any, Any]:
    """Evaluate named aggregates with small states over the whole table, batch by batch."""
    batches = _batches(list(parts))
    found = together(*[lambda b=b: df.agg(*[parts[k].alias(f"a{i}") for i, k in enumerate(b)]).collect()[0] for b in batches])
    return {key: value for batch, row in zip(batches, found) for key, value in zip(batch, row)}


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small driver-made table (one row per column, finding or step) as a local relation."""
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_arrays(
        [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema)
