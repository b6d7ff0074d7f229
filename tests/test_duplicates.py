"""Duplicates by a filter of digests that are seen twice."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tablescope.plans import duplicates


@pytest.fixture(autouse=True)
def any_size(monkeypatch):
    monkeypatch.setattr(duplicates, "FILTER_FROM", 0)


def wide(spark, n, copies):
    """``n`` different rows, the first ``copies`` of them twice, with an id."""
    base = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("row "), F.sha2(F.col("id").cast("string"), 512)).alias("t"), (F.col("id") / 3).alias("x"))
    twice = base.unionByName(base.where(F.col("k") < copies))
    return twice.withColumn("row_id", F.monotonically_increasing_id())


def written_bytes(spark):
    """Bytes that all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_few_rows_hit_the_filter(spark):
    n, copies = 40_000, 400
    df = wide(spark, n, copies)
    marked = duplicates.with_hits(df, ["k", "t", "x"])
    twins = marked.where(F.col("k") < copies)
    assert twins.where("NOT __hit").count() == 0 and twins.count() == 2 * copies
    assert marked.where("__hit").count() < 0.05 * (n + copies)
    assert df.columns == marked.drop("__hit").columns
    got = duplicates.distinct_rows(df, "row_id")
    assert got.count() == n and got.select("k").distinct().count() == n
    least = {r.k: r.row_id for r in df.groupBy("k").agg(F.min("row_id").alias("row_id")).collect()}
    assert all(least[r.k] == r.row_id for r in got.select("k", "row_id").collect())
    assert duplicates.distinct_rows(df.drop("row_id")).count() == n


def test_only_digests_and_hits_are_shuffled(spark):
    """With 1 % of copies and rows of 150 bytes that do not compress, grouping all rows writes many times as much."""
    df = wide(spark, 40_000, 400).drop("row_id")
    before = written_bytes(spark)
    df.dropDuplicates().write.format("noop").mode("overwrite").save()
    plain = written_bytes(spark) - before
    duplicates.distinct_rows(df).write.format("noop").mode("overwrite").save()
    filtered = written_bytes(spark) - before - plain
    digests = 40_400 * 16
    assert plain > 3_000_000 and filtered < 0.05 * plain + 1.6 * digests


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_any_filter_gives_the_same_rows(spark, monkeypatch, bits):
    """A filter that is too small for its digests lets more rows hit, and changes nothing else."""
    monkeypatch.setattr(duplicates, "FILTER_BITS", bits)
    rng = random.Random(1)
    rows = [(rng.choice([None, 0.0, -0.0, float("nan"), 1.5]), rng.choice(["a", "b", None]), {rng.choice("xy"): rng.randrange(30)}, i) for i in range(400)]
    rows += [(float(i), "lone", {"z": i}, 1000 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, t string, m map<string, int>, row_id int")
    key = lambda x, t, m: (None if x is None or math.isnan(x) else x + 0.0, t, tuple(m.items()))
    groups = collections.defaultdict(list)
    for x, t, m, i in rows:
        groups[key(x, t, m)].append(i)
    got = duplicates.distinct_rows(df, "row_id").collect()
    assert sorted(r.row_id for r in got) == sorted(min(g) for g in groups.values())
    assert duplicates.distinct_rows(df.drop("row_id")).count() == len(groups)
    shown = duplicates.preview_copies(df, "row_id", 40).collect()
    assert len(shown) == 40 and all(len(groups[key(r.x, r.t, r.m)]) > 1 for r in shown)


def test_no_rows_and_no_columns(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert duplicates.distinct_rows(empty).collect() == [] and duplicates.preview_copies(empty, "a", 5).collect() == []
    hot = spark.range(3000).select(F.lit("same").alias("t"))
    assert [r.t for r in duplicates.distinct_rows(hot).collect()] == ["same"]


def test_small_tables_are_grouped_whole(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "FILTER_FROM", 32 << 20)
    small, large = spark.range(100).selectExpr("id % 9 AS k"), spark.range(10**8).selectExpr("id AS k", "id % 5 AS v")
    assert not duplicates.worth_a_filter(small) and duplicates.worth_a_filter(large)
    assert "__hit" not in duplicates.distinct_rows(small)._jdf.queryExecution().analyzed().toString()
    assert "__hit" in duplicates.distinct_rows(large)._jdf.queryExecution().analyzed().toString()
    assert duplicates.distinct_rows(small).count() == duplicates.distinct_rows(small, filtered=True).count() == 9
