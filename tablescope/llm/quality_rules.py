"""Quality rules: robust multivariate outliers per language and source, in DataFrame functions only.

Method: each text gives a vector of transformed statistics (length, word length, symbols, capitals, repeated words and
lines); for every cell (language, source) the minimum-covariance-determinant estimate of location and scatter is found
by concentration steps, and documents beyond a Mahalanobis distance are rejected.  A base rule (too few words, too many
repeated words) rejects first, and its rejects do not enter the estimates.

Concentration starts from three robust estimates of a cell: quartile ranges alone, the correlations of its statistics pulled in by
tanh, and those of their directions from the medians.  After ``TRIAL_STEPS`` steps from each, the start with the least
determinant goes on, until the determinant of no cell falls any more or ``STEPS`` are done.

A concentration step is one grouped pass over all starts: distances are cut into logarithmic bins, each (cell, start, bin) keeps
count, sums and products, and the half-sample is the lowest bins that together hold the wanted share.  So a cell with a third of all rows
is combined before the shuffle, and no row moves.  Statistics are rounded to 1/64, which makes sums exact and the first
quartiles computable from value counts.  Small cells are pooled by language, then over all; a pool below ``min_rows`` has
no verdict and keeps its documents.

Null text has no words (and fails the base rule); null language or source is a value of its own.  Rows with one id share
the verdict in ``keep_documents``: rejected if one of them is.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused, words_of

MIN_ROWS = 100  # fewest rows of which scatter is estimated
SHARE = 0.75  # of a cell's rows that the estimate rests on
TRIAL_STEPS, STEPS = 2, 8  # concentration steps from every start, and at most in all
ENOUGH = 1e-3  # fall of the determinant's logarithm up to which a cell counts as settled
SMALL = 50_000  # cells whose numbers are broadcast; about 400 bytes each
CUTOFF = 40.0  # largest squared distance that is kept; the statistics have longer tails than the normal law
BINS_PER_DOUBLING = 16
#: Standard deviation added to each statistic, so that a statistic that is the same everywhere does not make small changes outliers.
FLOOR = {"length": 0.30, "word_length": 0.08, "symbols": 0.40, "capitals": 0.30, "marks": 0.25, "repeats": 0.60}
AXES = tuple(FLOOR)


def _let(value: Column, then) -> Column:
    """Evaluate ``value`` once and use it as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows (given as hashes, by position) that occur twice or more: sort, compare neighbours, sum the gaps."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = _let(
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.transform(F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x)), lambda x: x["i"]),
    )
    return _let(
        F.sort_array(repeated),
        lambda s: F.aggregate(F.transform(s, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - i, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with the base statistics (long), ``base_failed`` and the vector in ``__axis`` columns."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumns({"__text": body, "__words": words_of(body)}).drop(text)
    df = df.withColumns({
        "__windows": F.when(
            F.size("__words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")),
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.regexp_replace("__text", "[ \\t\\n\\x0B\\f\\r]+", "")).cast("bigint"),
        "n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("bigint"),
        "__n_capitals": F.length("__text") - F.length(F.regexp_replace("__text", "\\p{Lu}+", "")),
        "__n_marks": F.length("__text") - F.length(F.regexp_replace("__text", "[\\p{P}&&[^.,#*%&]]+", "")),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0).cast("bigint")).otherwise(_repeated_words(F.col("__windows"))),
    })
    share = lambda n, of: F.log1p(100 * F.col(n) / F.greatest(F.col(of), F.lit(1)))
    axes = {
        "length": F.log1p("n_words"),
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("__n_capitals", "word_chars"),
        "marks": share("__n_marks", "word_chars"),
        "repeats": F.log1p(100 * F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)) + 10 * F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1))),
    }
    df = df.withColumns({f"__{a}": F.round(axes[a] * 64) / 64 for a in AXES})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__text", "__words", "__windows", "__lines", "__n_capitals", "__n_marks")


def _dealt(cells: int):
    """How a table of so many rows is joined: by broadcast up to ``SMALL`` rows, dealt by cell beyond."""
    return F.broadcast if cells <= SMALL else lambda df: df


def _celled(df: DataFrame, lang: str, source: str, min_rows: int) -> DataFrame:
    """Adds ``__cell``: language and source, or the pool that the row falls in, or null for too small a pool."""
    value = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), F.lit("{}"))
    df = df.withColumns({"__lang": value(lang), "__source": value(source)})
    cells = df.where("not base_failed").groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("c", F.when(F.col("n") >= min_rows, F.concat_ws(" ", "__lang", "__source")))
    pools = cells.where("c is null").groupBy("__lang").agg(F.sum("n").alias("p"))
    rest = pools.where(F.col("p") < min_rows).agg(F.sum("p").alias("r"))
    cells = cells.join(pools, "__lang", "left").crossJoin(F.broadcast(rest))  # one row
    cells = cells.select("__lang", "__source", F.coalesce("c", F.when(F.col("p") >= min_rows, F.concat(F.lit("* "), "__lang")), F.when(F.col("r") >= min_rows, F.lit("*"))).alias("__cell"))
    cells = stored(cells, "per-cell")
    return df.join(_dealt(cells.count())(cells), ["__lang", "__source"], "left").drop("__lang", "__source")


def _keys(df: DataFrame) -> list[str]:
    """An estimate is of a cell, or of a cell from one of several starts."""
    return [c for c in ("__cell", "start") if c in df.columns]


def _factored(scatter: DataFrame) -> DataFrame:
    """From ``m_axis`` and ``s_i_j`` per cell: means and the lower Cholesky factor ``l_i_j``, with the floors added."""
    n = len(AXES)
    for j in range(n):
        pivot = F.col(f"s_{j}_{j}") + FLOOR[AXES[j]] ** 2
        for k in range(j):
            pivot = pivot - F.col(f"l_{j}_{k}") ** 2
        scatter = scatter.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(1e-6))))
        below = {}
        for i in range(j + 1, n):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = rest / F.col(f"l_{j}_{j}")
        scatter = scatter.withColumns(below) if below else scatter
    return scatter.select(*_keys(scatter), *[f"m_{a}" for a in AXES], *[f"l_{i}_{j}" for i in range(n) for j in range(i + 1)])


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``__d2``, the squared Mahalanobis distance, for each start of the estimate; null where the row's cell has none."""
    df = rows.join(estimate, "__cell", "left")
    for i, a in enumerate(AXES):
        y = F.col(f"__{a}") - F.col(f"m_{a}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        df = df.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") ** 2 for i in range(1, len(AXES))), F.col("y_0") ** 2)
    return df.withColumn("__d2", d2).select(*rows.columns, *_keys(estimate)[1:], "__d2")


def chi2_cdf(x: float, freedom: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def consistency(share: float, axes: int) -> float:
    """What the scatter of the nearest ``share`` of normal rows is multiplied by."""
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, axes) < share else (low, mid)
    return share / chi2_cdf(low, axes + 2)


def _first_estimate(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as a diagonal scatter."""
    quartiles = rows.groupBy("__cell").agg(*[F.percentile(f"__{a}", [0.25, 0.5, 0.75]).alias(a) for a in AXES])
    n = len(AXES)
    return _factored(quartiles.select(
        "__cell", *[F.col(a)[1].alias(f"m_{a}") for a in AXES],
        *[((F.col(AXES[i])[2] - F.col(AXES[i])[0]) / 1.349) ** 2 if i == j else F.lit(0.0) for i in range(n) for j in range(i + 1)],
    ).toDF("__cell", *[f"m_{a}" for a in AXES], *[f"s_{i}_{j}" for i in range(n) for j in range(i + 1)]))


def _starts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The first estimate and two more, of the statistics in units of their quartile ranges from the medians: correlations of
    their tanh, and mean products of their directions."""
    n = len(AXES)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    scaled = rows.join(first, "__cell").select("__cell", *[((F.col(f"__{a}") - F.col(f"m_{a}")) / F.col(f"l_{i}_{i}")).alias(f"z_{i}") for i, a in enumerate(AXES)])
    far = F.sqrt(sum((F.col(f"z_{i}") ** 2 for i in range(n)), F.lit(1e-12)))
    pulled = {i: F.tanh(f"z_{i}") for i in range(n)}
    sums = scaled.groupBy("__cell").agg(
        *[F.avg(pulled[i]).alias(f"t_{i}") for i in range(n)], *[F.avg(pulled[i] * pulled[j]).alias(f"t_{i}_{j}") for i, j in pairs],
        *[F.avg(F.col(f"z_{i}") / far * F.col(f"z_{j}") / far).alias(f"u_{i}_{j}") for i, j in pairs],
    )
    moment = {(i, j): F.col(f"t_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}") for i, j in pairs}
    spread = {i: F.sqrt(F.greatest(moment[i, i], F.lit(1e-9))) for i in range(n)}
    unit = {(i, j): F.col(f"l_{i}_{i}") * F.col(f"l_{j}_{j}") for i, j in pairs}
    known = sums.join(first, "__cell")

    def start(number: int, value) -> DataFrame:
        # rounded, so that the order of additions does not show in what follows
        scatter = [(F.round(value(i, j), 6) * unit[i, j]).alias(f"s_{i}_{j}") for i, j in pairs]
        return _factored(known.select("__cell", F.lit(number).alias("start"), *[f"m_{a}" for a in AXES], *scatter))

    more = start(1, lambda i, j: moment[i, j] / (spread[i] * spread[j])), start(2, lambda i, j: n * F.col(f"u_{i}_{j}"))
    return first.withColumn("start", F.lit(0)).unionByName(more[0]).unionByName(more[1])


def _log_determinant() -> Column:
    """Of a scatter given by its factor, rounded so that equal ones tie."""
    return F.round(2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(AXES))), F.log("l_0_0")), 9)


def _least(estimates: DataFrame, by: str) -> DataFrame:
    """The estimate of each cell with the least determinant, the first in the order of ``by`` on a tie."""
    whole = F.struct(*[F.col(c) for c in estimates.columns if c not in ("__cell", by)])
    best = estimates.groupBy("__cell").agg(F.min_by(whole, F.struct(_log_determinant().alias("d"), F.col(by))).alias("e"))
    return best.select("__cell", "e.*")


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: mean and scatter of the share of each cell's rows that lies nearest."""
    n = len(AXES)
    at = F.floor(F.log2(F.greatest(F.col("__d2"), F.lit(2.0**-10))) * BINS_PER_DOUBLING)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    keys = _keys(estimate)
    bins = _measured(rows, estimate).groupBy(*keys, F.least(at, F.lit(40 * BINS_PER_DOUBLING)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"__{a}").alias(f"t_{a}") for a in AXES],
        *[F.sum(F.col(f"__{AXES[i]}") * F.col(f"__{AXES[j]}")).alias(f"t_{i}_{j}") for i, j in pairs],
    )
    cell = Window.partitionBy(*keys)  # at most 50 * 16 bins
    before = F.sum("n").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    near = bins.withColumns({"before": F.coalesce(before, F.lit(0)), "all": F.sum("n").over(cell)}).where(F.col("before") < F.ceil(SHARE * F.col("all")))
    sums = near.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("all").alias("all"), *[F.sum(f"t_{a}").alias(f"t_{a}") for a in AXES], *[F.sum(f"t_{i}_{j}").alias(f"t_{i}_{j}") for i, j in pairs])
    mean = {a: F.col(f"t_{a}") / F.col("n") for a in AXES}
    return _factored(sums.select(
        *keys, *[mean[a].alias(f"m_{a}") for a in AXES],
        *[(consistency(SHARE, n) * (F.col(f"t_{i}_{j}") / F.col("n") - mean[AXES[i]] * mean[AXES[j]])).alias(f"s_{i}_{j}") for i, j in pairs],
    ))


def _estimated(sound: DataFrame) -> DataFrame:
    """The estimate of least determinant of each cell, as a table to be joined."""
    first = stored(_first_estimate(sound), "scatter")
    dealt = _dealt(3 * first.count())
    trial = stored(_starts(sound, dealt(first)), "scatter")
    for _ in range(TRIAL_STEPS - 1):
        trial = stored(_concentrated(sound, dealt(trial)), "scatter")
    best = stored(_least(_concentrated(sound, dealt(trial)), "start").withColumn("fell", F.lit(True)), "scatter")
    for _ in range(STEPS - TRIAL_STEPS):
        before = best.drop("fell")
        both = before.withColumn("age", F.lit(0)).unionByName(_concentrated(sound, dealt(before)).withColumn("age", F.lit(1)))
        least = _least(both, "age")
        then = before.select("__cell", _log_determinant().alias("then"))
        best = stored(least.join(dealt(then), "__cell").withColumn("fell", F.col("then") - _log_determinant() > ENOUGH).drop("then"), "scatter")
        if best.where("fell").isEmpty():
            break
    return dealt(best.drop("fell"))


def judged(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", *, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS
) -> DataFrame:
    """For each row of ``docs`` its id, base statistics, ``base_failed``, ``distance`` (null without estimate) and ``kept``."""
    narrow = docs.select(F.col(id).alias("__id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = stored(_celled(stored(statistics(narrow), "statistics"), "lang", "source", min_rows), "cells")
    sound = rows.where("not base_failed and __cell is not null").select("__cell", *[f"__{a}" for a in AXES])
    estimate = _estimated(sound)
    done = _measured(rows, estimate)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("__d2"), F.lit(0.0)) <= cutoff)
    return done.select(F.col("__id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.sqrt("__d2").alias("distance"), kept.alias("kept"))


def keep_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", *, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    (key,) = unused(docs, "rejected_id")
    rejected = judged(docs, id, text, lang, source, cutoff=cutoff).where("not kept").select(F.col(id).alias(key)).distinct()
    return docs.join(rejected, docs[id].eqNullSafe(rejected[key]), "left_anti")
