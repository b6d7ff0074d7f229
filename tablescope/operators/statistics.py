"""Statistics that steps need before they can be bound, asked for as data so that many can be found in one search.

A step asks for a ``Request`` and gets its answer.  Alone, it is answered at once; in a recipe, requests of many steps are
gathered first (``plans.recipe``) and answered together: one aggregate, one quantile search in long form and one count of values
in long form, side by side, whatever the number of requests.  A request may hold for some of the rows only (``alive``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, missing
from ..plans.cardinality import at_most
from ..plans.measures import aggregate, together
from ..plans.quantiles import Quantiles, approximate_quantile


@dataclass(frozen=True)
class Request:
    """``kind`` is aggregate (``make`` gives the aggregates of a value), quantile (``p``, exact or within ``rank_error``), mode or values (at most ``limit``).

    ``value`` is read from the step's input, missing cells as NULL.
    """

    kind: str
    value: Column
    dtype: T.DataType | None = None
    make: Callable[[Column], list[Column]] | None = None
    p: float | None = None
    rank_error: float | None = None
    limit: int | None = None
    alive: Column | None = None

    @property
    def cells(self) -> Column:
        return self.value if self.alive is None else F.when(self.alive, self.value)


class Unknown(Exception):
    """A step cannot be bound before its request is answered."""

    def __init__(self, request: Request):
        self.request = request


Ask = Callable[[DataFrame, Request], Any]


def answer_now(df: DataFrame, request: Request) -> Any:
    return answers(df, [request])[0]


def answers(df: DataFrame, requests: Sequence[Request]) -> list[Any]:
    """Answers in the order of the requests: lists of aggregates, a quantile, a value as text, a list of values or None."""
    of = {kind: [i for i, r in enumerate(requests) if r.kind == kind and not r.rank_error] for kind in ("aggregate", "quantile", "mode", "values")}
    calls = [lambda i=i: {i: _values(df, requests[i])} for i in of["values"]]
    near = {i: r for i, r in enumerate(requests) if r.rank_error}
    calls += [lambda i=i, r=r: {i: approximate_quantile(df, r.cells, r.p, r.rank_error).value} for i, r in near.items()]
    if of["aggregate"]:
        calls.append(lambda: _aggregates(df, {i: requests[i] for i in of["aggregate"]}))
    if of["quantile"]:
        search = Quantiles({i: (requests[i].cells.cast("double"), (requests[i].p,)) for i in of["quantile"]})
        calls.append(lambda: {i: found[0] for i, found in search.solve(df).items()})
    if of["mode"]:
        calls.append(lambda: _modes(df, {i: requests[i] for i in of["mode"]}))
    found = {i: answer for part in together(*calls) for i, answer in part.items()}
    return [found[i] for i in range(len(requests))]


def _aggregates(df: DataFrame, requests: dict[int, Request]) -> dict[int, list]:
    parts = {(i, k): made for i, r in requests.items() for k, made in enumerate(r.make(r.cells))}
    found = aggregate(df, parts)
    return {i: [v for (j, _), v in found.items() if j == i] for i in requests}


def _modes(df: DataFrame, requests: dict[int, Request]) -> dict[int, str | None]:
    """The most frequent value of each, the smallest on a tie in its own type's order; values are counted as text."""
    cells = df.select(F.posexplode(F.array(*[r.cells.cast("string") for r in requests.values()])).alias("c", "v")).where("v IS NOT NULL")
    counts = cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    place = lambda c, r: F.min(F.when(F.col("c") == c, F.struct((-F.col("n")).alias("rank"), F.col("v").try_cast(r.dtype).alias("value"))))
    row = counts.agg(*[place(c, r)["value"].cast("string").alias(f"m{c}") for c, r in enumerate(requests.values())]).collect()[0]
    return dict(zip(requests, row))


def _values(df: DataFrame, request: Request) -> list | None:
    return at_most(df.select(request.cells.alias("value")), "value", request.limit)


def present(df: DataFrame, name: str) -> Column:
    """A column's cells with NaN as NULL."""
    return F.when(~missing(df, name), col(name))
