"""Exact interpolated quantiles without sorting, shuffling or collecting a column.

``percentile`` keeps every distinct value of a column in one task.  Here each scan only carries counts
and sketches: a sketch of the column proposes an interval around the wanted rank, the next scan counts the
values below and inside it (so the proposal is checked, never trusted) and sketches the values
inside.  A sketch that still holds all its values answers exactly; an interval that is too full is
narrowed again, several hundred times per scan.

All columns are searched together in long form: a row becomes (column number, value) pairs, and what is asked of a column is
looked up by its number in constant arrays.  So each step is one job with the same few aggregates whatever the number of
columns, and its compiled code does not grow with them.  States are one per column, merged first in groups of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .measures import FAN_IN, local_frame, together

Interval = tuple[float, float]  # both ends included
EVERYTHING: Interval = (-math.inf, math.inf)
MAX_SCANS = 64
# A task holds sketches of up to 128 groups in a hash table; with more it would sort its rows by group.
COLUMNS_AT_ONCE = 96


class Positive(NamedTuple):
    """A quantile among the values above zero: another rank of the same column, found in the same scans."""

    p: float


class SketchKind(NamedTuple):
    """A sketch size and the margin to leave for its rank error (the counts decide, not the margin)."""

    size: int
    margin: float

    @property
    def exact_below(self) -> int:
        """A sketch with at most this many values has dropped none of them."""
        return self.size // 2


# Rank errors are about 0.0013 and 0.00036 of the values.  The first sketch sees every value in every
# task, so it is the smaller one; later ones only see the values inside an interval.
OPENING = SketchKind(4096, 0.002)
NARROWING = SketchKind(16384, 0.0006)


@dataclass
class _Rank:
    """One order statistic being looked for: the ``index``-th smallest value of column ``key``."""

    key: Any
    index: int
    pair: tuple[int, int]
    inside: int
    caution: float = 1.0
    interval: Interval = EVERYTHING
    before: int = 0
    sure: Interval = EVERYTHING
    value: float | None = None

    def sketch_points(self, kind: SketchKind) -> tuple[float, ...]:
        """Positions to read from the interval's sketch: the value itself, or the next interval."""
        if self.inside <= kind.exact_below:
            return ((self.index - self.before + 0.5) / self.inside,)
        low, high = ((index - self.before + 0.5) / self.inside for index in self.pair)
        margin = kind.margin * self.caution
        return max(low - margin, 0.0), min(high + margin, 1.0)

    def take(self, read: tuple[float, ...]) -> None:
        """Use what the sketch of the interval said; its ends are known not to be the value."""
        if len(read) == 1:
            self.value = read[0]
            return
        low, high = self.interval
        self.interval = (
            math.nextafter(low, math.inf) if read[0] == low else read[0],
            math.nextafter(high, -math.inf) if read[1] == high else read[1],
        )

    def settle(self, below: int, inside: int, at_low: int, at_high: int) -> None:
        """Take in the counts below, inside and at the ends of the proposed interval."""
        low, high = self.interval
        end = self.before + self.inside
        if self.index < below:
            self.interval, self.inside = (self.sure[0], math.nextafter(low, -math.inf)), below - self.before
            self.caution *= 2
        elif self.index >= below + inside:
            self.interval = (math.nextafter(high, math.inf), self.sure[1])
            self.before, self.inside = below + inside, end - below - inside
            self.caution *= 2
        elif self.index < below + at_low:
            self.value = low
        elif self.index >= below + inside - at_high:
            self.value = high
        else:
            self.before, self.inside = below, inside
        self.sure = self.interval


@dataclass
class Quantiles:
    """Quantiles wanted from several columns (key, double column, probabilities or ``Positive`` ones), found together."""

    wanted: dict[Any, tuple[Column, Sequence[float | Positive]]]

    def solve(self, df: DataFrame) -> dict[Any, list[float | None]]:
        asked = [key for key, (_, ps) in self.wanted.items() if ps]
        found: dict[Any, list[float | None]] = {key: [] for key in self.wanted}
        for start in range(0, len(asked), COLUMNS_AT_ONCE):
            keys = asked[start : start + COLUMNS_AT_ONCE]
            found.update(_Search(df, {key: self.wanted[key] for key in keys}).solve())
        return found


class _Search:
    def __init__(self, df: DataFrame, wanted: dict[Any, tuple[Column, Sequence[float | Positive]]]):
        self.spark, self.wanted, self.keys = df.sparkSession, wanted, list(wanted)
        self.values = long_values(df, [column for column, _ in wanted.values()]).where("x IS NOT NULL")

    def open(self) -> dict[tuple, Any]:
        """Size, values up to zero and a sketch of each column."""
        part = self.values.groupBy(_fan(), "c").agg(
            F.expr(f"kll_sketch_agg_double(x, {OPENING.size})").alias("sketch"), F.expr("count(1) FILTER (WHERE x <= 0)").alias("low")
        )
        whole = part.groupBy("c").agg(F.expr(f"kll_merge_agg_double(sketch, {OPENING.size})").alias("sketch"), F.sum("low").alias("low"))
        rows = whole.select("c", "sketch", "low", F.expr("kll_sketch_get_n_double(sketch)").alias("n")).collect()
        self.sizes = dict.fromkeys(self.keys, (0, 0)) | {self.keys[r.c]: (r.n, r.low) for r in rows}
        return {(self.keys[r.c], EVERYTHING): bytes(r.sketch) for r in rows}

    def solve(self) -> dict[Any, list[float | None]]:
        sketches = self.open()
        ranks, kind = self._ranks(), OPENING
        for _ in range(MAX_SCANS):
            _read_sketches(self.spark, ranks, sketches, kind)
            pending = [r for r in ranks if r.value is None]
            if not pending:
                break
            sketches, kind = self.narrow(pending), NARROWING
        else:
            raise RuntimeError("quantile search did not settle")
        found = {(r.key, r.index): r.value for r in ranks}
        return {key: [_interpolate(found, key, self._places(key, p)) for p in ps] for key, (_, ps) in self.wanted.items()}

    def _places(self, key: Any, p: float | Positive) -> tuple[int, int, float] | None:
        """The two neighbouring ranks of a quantile and the share of the second; None without values."""
        size, low = self.sizes[key]
        first, n, p = (low, size - low, p.p) if isinstance(p, Positive) else (0, size, p)
        if not n:
            return None
        position = (n - 1) * p
        return first + math.floor(position), first + math.ceil(position), position - math.floor(position)

    def _ranks(self) -> list[_Rank]:
        ranks: dict[tuple, _Rank] = {}
        for key, (_, ps) in self.wanted.items():
            for place in filter(None, (self._places(key, p) for p in ps)):
                for index in place[:2]:
                    ranks.setdefault((key, index), _Rank(key, index, place[:2], self.sizes[key][0]))
        return list(ranks.values())

    def narrow(self, ranks: list[_Rank]) -> dict[tuple, bytes]:
        """Count below, in and at the ends of every distinct interval, and sketch its values: two scans side by side."""
        spots = list({(r.key, r.interval): None for r in ranks})
        ends = Ends({self.keys.index(key): sorted({e for k, i in spots if k == key for e in i}) for key, _ in spots}, len(self.keys))
        coded = self.values.select("c", "x", ends.code().alias("code"))
        pieces = [
            (self.keys.index(key), code, i)
            for i, (key, (low, high)) in enumerate(spots) if low < high
            for code in range(ends.at(self.keys.index(key), low), ends.at(self.keys.index(key), high) + 1)
        ]
        counted, sketched = together(
            lambda: coded.groupBy("c", "code").agg(F.count(F.lit(1)).alias("n")).collect(), lambda: self._sketches(coded, ends, pieces)
        )
        seen = {(r.c, r.code): r.n for r in counted}
        for rank in ranks:
            c = self.keys.index(rank.key)
            low, high = (ends.at(c, e) for e in rank.interval)
            below, inside = (sum(seen.get((c, code), 0) for code in codes) for codes in (range(low), range(low, high + 1)))
            rank.settle(below, inside, seen.get((c, low), 0), seen.get((c, high), 0))
        return {spots[i]: sketch for i, sketch in sketched.items()}

    def _sketches(self, coded: DataFrame, ends: Ends, pieces: list[tuple[int, int, int]]) -> dict[int, bytes]:
        """A sketch of each interval, merged from those of the pieces that its own and other intervals' ends cut it into."""
        if not pieces:
            return {}
        part = coded.where(ends.among({(c, code) for c, code, _ in pieces})).groupBy(_fan(), "c", "code")
        part = part.agg(F.expr(f"kll_sketch_agg_double(x, {NARROWING.size})").alias("sketch"))
        spots = local_frame(self.spark, pieces, "c int, code int, spot int")
        whole = part.join(F.broadcast(spots), ["c", "code"]).groupBy("spot").agg(F.expr(f"kll_merge_agg_double(sketch, {NARROWING.size})").alias("sketch"))
        return {r.spot: bytes(r.sketch) for r in whole.collect()}


def _fan() -> Column:
    return (F.spark_partition_id() % FAN_IN).alias("fan")


def long_values(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows ``(c, x)``: the number of a column and its value as a double, one for each cell."""
    return df.select(F.posexplode(F.array(*[column.cast("double") for column in columns])).alias("c", "x"))


def constants(values: Sequence[float | None]) -> str:
    """An array of doubles as SQL text."""
    return f"array({', '.join('CAST(NULL AS DOUBLE)' if v is None else _literal(v) for v in values)})"


@dataclass
class Ends:
    """Cut points of columns (by number): a value's code is 2 for each point below it, and 1 more if it is a point itself."""

    points: dict[int, list[float]]
    columns: int

    @property
    def width(self) -> int:
        return max(map(len, self.points.values()))

    def at(self, c: int, point: float) -> int:
        return 2 * self.points[c].index(point) + 1

    def code(self) -> Column:
        """Points of all columns are one array; no value is above or at the NaN that fills it up."""
        flat = [v for c in range(self.columns) for v in (self.points.get(c, []) + [math.nan] * self.width)[: self.width]]
        table = F.expr(constants(flat))
        total = F.lit(0)
        for k in range(self.width):
            point = F.get(table, F.col("c") * self.width + k)
            total = total + F.when(F.col("x") > point, 2).when(F.col("x") == point, 1).otherwise(0)
        return total

    def among(self, wanted: set[tuple[int, int]]) -> Column:
        codes = 2 * self.width + 1
        flags = ", ".join("true" if (c, code) in wanted else "false" for c in range(self.columns) for code in range(codes))
        return F.get(F.expr(f"array({flags})"), F.col("c") * codes + F.col("code"))


def _literal(value: float) -> str:
    return f"double('{value}')" if not math.isfinite(value) else f"{value!r}D"


def _read_sketches(spark: SparkSession, ranks: list[_Rank], sketches: dict[tuple, Any], kind: SketchKind) -> None:
    """Read values or narrower intervals out of the sketches (a projection over a local table)."""
    asked: dict[tuple, list[_Rank]] = {}
    for rank in ranks:
        if rank.value is None and (rank.key, rank.interval) in sketches:
            asked.setdefault((rank.key, rank.interval), []).append(rank)
    if not asked:
        return
    frame = local_frame(spark, [tuple(sketches[spot] for spot in asked)], ", ".join(f"s{i} binary" for i in range(len(asked))))
    points = [constants([p for rank in wants for p in rank.sketch_points(kind)]) for wants in asked.values()]
    answers = frame.selectExpr(*[f"kll_sketch_get_quantile_double(s{i}, {ps}) AS a{i}" for i, ps in enumerate(points)]).collect()[0]
    for wants, answer in zip(asked.values(), answers):
        read = iter(answer)
        for rank in wants:
            rank.take(tuple(next(read) for _ in rank.sketch_points(kind)))


def _interpolate(found: dict[tuple, float | None], key: Any, place: tuple[int, int, float] | None) -> float | None:
    if place is None:
        return None
    low, high, share = place
    return found[(key, low)] + (found[(key, high)] - found[(key, low)]) * share


def exact_quantiles(df: DataFrame, column: Column, ps: Sequence[float]) -> list[float | None]:
    return Quantiles({"x": (column, ps)}).solve(df)["x"]


class Approximate(NamedTuple):
    """A value, and how far its rank is from the wanted one, as a share of all values."""

    value: float | None
    rank_error: float


def approximate_quantile(df: DataFrame, column: Column, p: float, rank_error: float) -> Approximate:
    """A quantile from one sketch, with its rank error counted by a second scan; the exact search where it is too large.

    The counted error is the distance of the wanted rank to the nearest rank that the value has, so it holds for this table
    and is no estimate.
    """
    search = _Search(df, {"x": (column, (p,))})
    sketches = search.open()
    size = search.sizes["x"][0]
    if not size:
        return Approximate(None, 0.0)
    frame = local_frame(df.sparkSession, [(sketches[("x", EVERYTHING)],)], "s binary")
    value = frame.selectExpr(f"kll_sketch_get_quantile_double(s, {constants([p])}) AS v").collect()[0].v[0]
    below, equal = search.values.agg(F.expr(f"count(1) FILTER (WHERE x < {_literal(value)})"), F.expr(f"count(1) FILTER (WHERE x = {_literal(value)})")).collect()[0]
    wanted = (size - 1) * p
    error = max(0.0, below - wanted, wanted - (below + equal - 1)) / size if equal else 1.0
    if error > rank_error:
        return Approximate(exact_quantiles(df, column, [p])[0], 0.0)
    return Approximate(value, error)
