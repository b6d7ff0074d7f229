"""Mixing sources to target weights by temperature.

Method: a source's weight is its token share to the power ``a``, normalised.  ``a`` = 1 is the corpus as it is, 0 all
sources alike.  The smallest ``a`` is searched that repeats no source more than ``max_repeats`` times, or, with
``target_entropy`` (a share of the largest entropy), the largest that reaches it.  The interval is cut into 64 parts at
once, by one aggregate over the sources, five times; only the exponent reaches the driver.

Weights become budgets: the source that needs most of its tokens is passed once, every other one to the power ratio of
that; so no document is dropped and small sources repeat (whole passes, then the head of a last one).  Each source and
pass has its own permutation (a hash order); documents fill blocks, of each of which a source gets its weight.  Running
token sums are taken in two levels, sums of hash ranges first, so no source is ordered in one task.

Null text has no tokens; its document still appears.  Null source is a source of its own.  Rows that are alike in id are
placed one by one, in the order of a hash of their text.  A source without tokens is passed once.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RANGE_ROWS = 4_000  # rows of a source in one hash range, on average


def exponent(shares: DataFrame, *, max_repeats: float = 4.0, target_entropy: float | None = None) -> float:
    """``shares(source, tokens)`` to the exponent; 1 if there is nothing to search."""
    known = shares.where("tokens > 0")
    total = known.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    known = known.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(5):
        points = [low + (high - low) * i / 64 for i in range(65)]
        power = known.select("p", F.explode(F.array(*map(F.lit, points))).alias("a")).withColumn("q", F.pow("p", F.col("a")))
        tried = power.groupBy("a").agg(
            F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), (F.max(F.col("q") / F.col("p")) / F.min(F.col("q") / F.col("p"))).alias("repeats"), F.count(F.lit(1)).alias("n"))
        entropy = F.log("z") - F.col("s") / F.col("z")
        if target_entropy is None:  # repeats fall with a: the smallest a that holds the limit
            low_side = F.max(F.when(F.col("repeats") > max_repeats, F.col("a")))
        else:  # entropy falls with a: the largest a that reaches the target
            low_side = F.max(F.when(entropy >= target_entropy * F.log("n") - 1e-12, F.col("a")))
        edge = tried.agg(low_side).first()[0]
        if edge is None:
            return low
        if edge == points[-1]:
            return high
        low, high = edge, points[points.index(edge) + 1]
    return high if target_entropy is None else low


def mixture(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", *, max_repeats: float = 4.0,
    target_entropy: float | None = None, block_tokens: int = 1_000_000, seed: str = "1",
) -> DataFrame:
    """One row per placed copy: ``id, source, n_tokens, weight, epoch, block, position`` (epoch and block from 0)."""
    rows = docs.select(
        F.col(id), F.col(source), F.to_json(F.struct(F.col(source).cast("string").alias("v"))).alias("__s"),
        F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("bigint").alias("n_tokens"),
        F.xxhash64(F.lit(seed), F.col(id), F.col(text)).alias("__k"),
    )
    rows = stored(rows, "mix-rows")
    shares = stored(rows.groupBy("__s").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-shares")
    a = exponent(shares, max_repeats=max_repeats, target_entropy=target_entropy)
    total = shares.agg(F.sum("tokens").alias("total"))
    raw = shares.crossJoin(F.broadcast(total)).withColumn("q", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.lit(a))))
    norms = raw.agg(F.sum("q").alias("z"), F.min(F.col("q") / F.col("tokens")).alias("least"))
    plan = raw.crossJoin(F.broadcast(norms)).select(
        "__s", "tokens", (F.col("q") / F.col("z")).alias("weight"),
        F.coalesce(F.round(F.col("q") / F.col("tokens") / F.col("least"), 9), F.lit(1.0)).alias("passes"),
        F.ceil(F.col("rows") / RANGE_ROWS).alias("ranges"),
    )
    plan = stored(plan, "mix-plan")
    # every copy, with its place in the permutation of its pass
    copies = rows.join(plan, "__s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("passes").cast("int") - 1)))
    copies = copies.withColumn("__o", F.xxhash64(F.lit(seed), "epoch", "__k")).withColumn("__r", F.pmod(F.shiftrightunsigned("__o", 20), F.col("ranges")))
    sums = copies.groupBy("__s", "epoch", "__r").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("__s").orderBy("epoch", "__r").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4,000 copies
    sums = stored(sums.withColumn("__before", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t"), "mix-ranges")
    within = Window.partitionBy("__s", "epoch", "__r").orderBy("__o", id)
    placed = copies.join(sums, ["__s", "epoch", "__r"]).withColumn("__at", F.col("__before") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    placed = placed.where((F.col("epoch") == 0) | (F.col("__at") < F.round(F.col("passes") * F.col("tokens"))))
    block = F.coalesce(F.floor(F.col("__at") / F.greatest(F.col("weight") * block_tokens, F.lit(1.0))), F.lit(0))
    placed = placed.withColumn("block", block)
    spot = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "__o"), "__o", id)
    return placed.withColumn("position", F.row_number().over(spot) - 1).select(id, source, "n_tokens", "weight", "epoch", "block", "position")
