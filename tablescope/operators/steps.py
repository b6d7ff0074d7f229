"""The contract of a cleaning or transform step.

A step never forces a count: it returns the new DataFrame lazily, and its sentence is worked out only
when somebody asks for it.  Steps that cannot apply leave the table unchanged and say why.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StepCounts:
    rows_before: int
    rows_after: int
    cells_changed: int

    @property
    def rows_removed(self) -> int:
        return self.rows_before - self.rows_after


@dataclass(frozen=True)
class StepResult:
    """``transform`` is the step bound to its statistics; ``touched`` marks input rows it alters."""

    source: DataFrame
    transform: Callable[[DataFrame], DataFrame]
    sentence: Callable[[StepCounts], str]
    touched: Column | None = None
    drops_rows: bool = False
    refused: bool = False

    @cached_property
    def df(self) -> DataFrame:
        return self.transform(self.source)

    def counts(self) -> StepCounts:
        touched = F.lit(0) if self.touched is None else F.count_if(self.touched)
        before, cells = self.source.agg(F.count(F.lit(1)), touched).collect()[0]
        return StepCounts(before, self.df.count() if self.drops_rows else before, cells)

    @property
    def message(self) -> str:
        """What was done, in words; runs the counts."""
        if self.refused or (self.touched is None and not self.drops_rows):
            return self.sentence(StepCounts(0, 0, 0))
        return self.sentence(self.counts())

    @property
    def changed(self) -> bool:
        if self.refused:
            return False
        if self.touched is None and not self.drops_rows:
            return True
        counts = self.counts()
        return bool(counts.cells_changed or counts.rows_removed)


def unchanged(df: DataFrame, why: str) -> StepResult:
    return StepResult(df, lambda d: d, lambda _: why, refused=True)


def not_found(df: DataFrame, name: str) -> StepResult:
    return unchanged(df, f"Column '{name}' not found — nothing was changed.")
