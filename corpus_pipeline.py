"""Documents to a training mixture: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.  A document that stays in is kept whole, but for lines that others hold.

Empty tables give empty results.  Null text fails the quality rules.  Rows with one id share their fate: all of them go
if one fails the quality rules, is a near copy of a document with a smaller id, or holds a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import decontamination, jaccard_join, line_dedup, mixing, quality_rules
from tablescope.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far outside their language and source go."""
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three or more documents stay in the last of them only.

    Documents that lose all of their words by that go: their lines are in others.  Those without words before stay."""
    done = line_dedup.drop_repeated_lines(docs, min_docs=3, min_chars=20)
    done = done.where((F.col("n_dropped") == 0) | F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\x0B\f\r]"))
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more in five-word shingles stays, the smallest id."""
    return jaccard_join.one_of_each(docs, length=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document placed in blocks by source weight; small sources repeat up to four times."""
    return mixing.mixture(docs, max_repeats=4.0, block_tokens=1_000_000)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

#: Robust estimates, near-duplicate components and ranked retrieval are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
