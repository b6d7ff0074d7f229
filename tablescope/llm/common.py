"""Shared helpers: word rules, byte views of Arrow columns, sizes, scratch tables, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: The characters of ``[\x20\x09-\x0D]``; ``bytes.split()`` and ``bytes.strip()`` use the same six.
BLANKS = " \t\n\x0b\x0c\r"


def texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))


def stored(df: DataFrame, name: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared scratch folder and read back: later readers do not repeat the work, lost executors neither."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def total_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and text bytes, by one scan; they set how many pieces the work is cut into, never what is kept."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()
    return row[0], row[1] or 0


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, the smallest node as the component's name.

    Alternating large-star and small-star rounds over tables in the shared folder; no node is gathered with all its
    neighbours (stars take a minimum, which is combined before the shuffle).  Nodes without an edge do not appear.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = stored(e.where("a <> b").distinct(), f"{name}-edges")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first())

    edges, mark = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        around = both(edges)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges, after = settled(small)
        if after == mark:  # stars only: each node has its component's smallest
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        mark = after
