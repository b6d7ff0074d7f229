"""Equal rows.

Copies are counted by 128-bit row digests, sixteen bytes of a row are shuffled and hot rows collapse before that.  Where rows
themselves are returned, digests seen twice set the bits of a Bloom filter, and only rows that hit it are grouped whole;
all others have no twin and stay where they are.  Every digest seen twice is in the filter, so a row is passed by only if it
is alone, and hits that are no copies come out of the grouping unharmed.  The filter is an array of at most ``FILTER_BITS / 8``
bytes in one broadcast row, sized by the number of digests seen twice; with more digests than it can tell apart, more rows hit
it, at worst all of them, and the plan does what it did without a filter.

All is one lazy plan: no job before the result is asked for, nothing written.  The input is read three times (digests, rows
that hit, rows that do not), in exchange for not shuffling its rows.  That does not pay for a table of which Catalyst knows that
it is under ``FILTER_FROM`` bytes: such a table is grouped whole, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, comparable, holds_map, is_nested

FILTER_BITS = 1 << 26  # eight megabytes
FILTER_FROM = 32 << 20
BITS_PER_DIGEST = 16  # one lone row in 400 hits a filter of this density by chance


def row_digest(df: DataFrame, names: Sequence[str]) -> tuple[Column, Column]:
    """Two independent hashes of a row.  As hashes pass over nulls, they enter as flags, nested values as text."""
    values = []
    for n in names:
        dtype, value = df.schema[n].dataType, comparable(df, n)
        nested = is_nested(dtype) and not isinstance(dtype, T.BinaryType)
        values += [F.to_json(F.struct(value.alias("v"))) if nested else value, value.isNull()]
    return F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *values).alias("h2")


def row_groups(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per different row with its number of ``copies``; merged before the shuffle."""
    keys = [comparable(df, n).alias(f"g{i}") for i, n in enumerate(names)]
    return df.select(*keys).groupBy(*[f"g{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("copies"))


def count_copies(df: DataFrame) -> int:
    """Rows that repeat an earlier row."""
    if not df.columns:
        return 0
    groups = df.select(*row_digest(df, df.columns)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).collect()[0][0]


def seen_twice(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Digests that more than one row has."""
    return df.select(*row_digest(df, names)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h1", "h2")


def _shifted_one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def _positions(h1: str, h2: str, bits: Column) -> list[Column]:
    """Four positions of a digest in a filter of ``bits``, a power of two up to 2^32: the halves of its two hashes."""
    return [F.shiftright(F.col(h), n).bitwiseAND(bits - 1) for h in (h1, h2) for n in (0, 32)]


def copy_filter(digests: DataFrame) -> DataFrame:
    """One row: the number of ``bits`` and the ``words`` of 64 bits that hold them; bits of every digest are set."""
    wanted = F.ceil(F.log2(F.greatest(F.count(F.lit(1)), F.lit(4)) * BITS_PER_DIGEST))
    size = digests.agg(F.least(F.lit(FILTER_BITS).cast("bigint"), _shifted_one(wanted)).alias("bits"))
    spots = digests.crossJoin(F.broadcast(size)).select(F.explode(F.array(*_positions("h1", "h2", F.col("bits")))).alias("at"))
    marks = spots.select(F.shiftright("at", 6).alias("word"), _shifted_one(F.col("at").bitwiseAND(F.lit(63))).alias("mask"))
    blank = size.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("bits", 6) - 1)).alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = marks.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    # at most FILTER_BITS / 64 words, whatever the table
    dense = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("words"))
    return dense.withColumn("bits", F.size("words").cast("bigint") * 64)


def with_hits(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with ``__hit``: false only for rows without a twin."""
    found = copy_filter(seen_twice(df, names)).select(F.col("words").alias("__words"), F.col("bits").alias("__bits"))
    digests = [h.alias(f"__{n}") for h, n in zip(row_digest(df, names), ("h1", "h2"))]
    word = lambda p: F.get("__words", F.shiftright(p, 6).cast("int"))
    hit = [word(p).bitwiseAND(_shifted_one(p.bitwiseAND(F.lit(63)))) != 0 for p in _positions("__h1", "__h2", F.col("__bits"))]
    joined = df.select("*", *digests).crossJoin(F.broadcast(found))
    return joined.withColumn("__hit", hit[0] & hit[1] & hit[2] & hit[3]).drop("__words", "__bits", "__h1", "__h2")


def worth_a_filter(df: DataFrame) -> bool:
    """Whether the table is not known to be small (an upper estimate, from files and expressions; no job)."""
    plan = getattr(df, "_jdf", None)
    return plan is None or int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes())) >= FILTER_FROM


def distinct_rows(df: DataFrame, row_id: str | None = None, filtered: bool | None = None) -> DataFrame:
    """One row of each set of equal rows; with ``row_id``, the one with the lowest id.  ``filtered`` overrules the size check."""
    names = [n for n in df.columns if n != row_id]
    if not names or not (worth_a_filter(df) if filtered is None else filtered):
        return _grouped(df, names, row_id)
    marked = with_hits(df, names)
    alone = marked.where("NOT __hit").drop("__hit")
    return alone.unionByName(_grouped(marked.where("__hit").drop("__hit"), names, row_id))


def _grouped(df: DataFrame, names: Sequence[str], row_id: str | None) -> DataFrame:
    """Group by the comparable form of all columns; equal rows collapse before the shuffle."""
    kept = [F.first(col(n)).alias(n) for n in names]
    kept += [F.min(col(row_id)).alias(row_id)] if row_id else []
    if row_id is None and not any(holds_map(df.schema[n].dataType) for n in names):
        return df.dropDuplicates()
    keyed = df.withColumns({f"__g{i}": comparable(df, n) for i, n in enumerate(names)})
    return keyed.groupBy(*[f"__g{i}" for i in range(len(names))]).agg(*kept).select(*[col(n) for n in df.columns])


def preview_copies(df: DataFrame, row_id: str, limit: int, filtered: bool | None = None) -> DataFrame:
    """The first ``limit`` rows that have a twin, in row order, with their row number.

    Only rows that hit the filter of copies are grouped.  A group holds at least two rows, so the first ``limit`` groups in
    order are enough; they are joined back as a broadcast of at most ``limit`` rows, and no group is ever gathered whole.
    """
    names = [n for n in df.columns if n != row_id]
    hits = with_hits(df, names).where("__hit").drop("__hit") if (worth_a_filter(df) if filtered is None else filtered) else df
    order = [F.col(f"g{i}").asc_nulls_last() for i in range(len(names))]
    first = row_groups(hits, names).where("copies > 1").orderBy(*order).limit(limit).drop("copies")
    same = [comparable(df, n).eqNullSafe(F.col(f"g{i}")) for i, n in enumerate(names)]
    shown = [comparable(df, n).asc_nulls_last() for n in names]
    return df.join(F.broadcast(first), same, "left_semi").orderBy(*shown, col(row_id)).limit(limit)
