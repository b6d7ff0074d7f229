"""Suggested cleaning steps and recipes: a recipe is a list of steps, undo drops the last one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import count_text, missing, percent
from ..operators import cleaning, transforms
from ..operators.statistics import Ask, Request, Unknown, answer_now, answers
from ..operators.steps import StepCounts, StepResult
from .duplicates import count_copies
from .measures import local_frame, together
from .profile import profile
from .semantic import Table, detect

OPERATIONS: dict[str, Callable[..., StepResult]] = {
    "remove_duplicates": cleaning.remove_duplicates,
    "fill_missing": cleaning.fill_missing,
    "drop_missing_rows": cleaning.drop_missing_rows,
    "drop_column": cleaning.drop_column,
    "rename_column": cleaning.rename_column,
    "trim_whitespace": cleaning.trim_whitespace,
    "standardize_case": cleaning.standardize_case,
    "currency_to_number": cleaning.currency_to_number,
    "log_transform": transforms.log_transform,
    "standard_scale": transforms.standard_scale,
    "minmax_scale": transforms.minmax_scale,
    "one_hot_encode": transforms.one_hot_encode,
    "extract_date_part": transforms.extract_date_part,
}

# Steps that need statistics of their column before they can be bound.
ASKING = ("fill_missing", "log_transform", "standard_scale", "minmax_scale", "one_hot_encode")

# Steps that look at one row at a time, and so also run on a stream.
ROW_LOCAL = ("drop_missing_rows", "drop_column", "rename_column", "trim_whitespace", "standardize_case", "currency_to_number", "extract_date_part")


@dataclass(frozen=True)
class Step:
    operation: str
    arguments: dict[str, Any] = field(default_factory=dict)

    def on(self, df: DataFrame, ask: Ask = answer_now) -> StepResult:
        more = {"ask": ask} if self.operation in ASKING else {}
        return OPERATIONS[self.operation](df, **self.arguments, **more)

    @property
    def column(self) -> str | None:
        return self.arguments.get("name") or self.arguments.get("old")

    @property
    def columns(self) -> set[str]:
        """Columns that the step names."""
        return {v for k, v in self.arguments.items() if k in ("name", "old", "new")}

    @property
    def needs_rows(self) -> bool:
        """Whether it drops rows by more than the cell of one column."""
        return self.operation == "remove_duplicates" or (self.operation == "drop_missing_rows" and self.column is None)

    @property
    def row_local(self) -> bool:
        constant = self.operation == "fill_missing" and self.arguments.get("strategy") == "constant"
        return constant or self.operation in ROW_LOCAL


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()

    def then(self, operation: str, **arguments: Any) -> Recipe:
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation: {operation}")
        return Recipe((*self.steps, Step(operation, arguments)))

    def undo(self) -> Recipe:
        """The recipe before its last step; nothing is stored, so it can go back all the way."""
        return Recipe(self.steps[:-1])

    def bind(self, df: DataFrame) -> list[StepResult]:
        """The steps bound to their statistics, which are found for a whole run of steps in one search.

        A run ends at a step that needs whole rows (removed duplicates, rows with any missing cell).  Within it, what steps ask
        is gathered first (``_wanted``) and answered together; only a statistic of a column that itself waits for one takes another search.
        """
        results: list[StepResult] = []
        at = 0
        while at < len(self.steps):
            end = next((i for i in range(at, len(self.steps)) if self.steps[i].needs_rows), len(self.steps))
            known: dict[int, Any] = {}
            while True:
                frame, asked = self._wanted(df, range(at, end), known)
                if not asked:
                    break
                known.update(zip(asked, answers(frame, list(asked.values()))))
            for i in range(at, min(end + 1, len(self.steps))):
                results.append(self.steps[i].on(df, lambda _, request, i=i: known[i]))
                df = results[-1].df
            at = end + 1
        return results

    def _wanted(self, df: DataFrame, run: range, known: dict[int, Any]) -> tuple[DataFrame, dict[int, Request]]:
        """The requests of a run of steps beyond what is known, by step, and a frame of all rows of ``df`` to answer them on.

        A step whose request is not known makes its columns pending; later steps on those wait, too, and others go on.
        Rows dropped for a missing cell are marked, not dropped, and requests behind hold for the rows that are left.
        """
        alive, pending, asked = None, set(), {}
        for i in run:
            step = self.steps[i]
            if step.columns & pending:
                if step.operation == "drop_missing_rows":
                    break
                pending |= step.columns
                continue

            def ask(_, request, i=i, alive=alive):
                if i not in known:
                    raise Unknown(replace(request, alive=alive))
                return known[i]

            try:
                result = step.on(df, ask)
            except Unknown as unknown:
                asked[i] = unknown.request
                pending |= step.columns
                continue
            if result.drops_rows:
                kept, flag = ~missing(df, step.column), f"__alive_{i}"
                df = df.withColumn(flag, kept if alive is None else alive & kept)
                alive = F.col(flag)
            else:
                df = result.df
        return df, asked

    def run(self, df: DataFrame) -> DataFrame:
        results = self.bind(df)
        return results[-1].df if results else df

    def apply(self, df: DataFrame) -> Table:
        """The cleaned table with its column types detected anew."""
        return detect(self.run(df))

    def audit(self, df: DataFrame) -> DataFrame:
        """One row per step: rows before and after, cells changed, and the sentence.

        Steps that keep all rows are counted together in one scan, by flags carried beside the data;
        only a step that drops rows starts a new scan.  Beside a write, ``audit_beside`` counts without any scan of its own.
        """
        results = self.bind(df)
        counted, _ = self._flagged(df, results, lambda frame, _, __: frame)
        measured = together(
            *[lambda f=frame, m=marks: f.agg(F.count(F.lit(1)), *[F.count_if(_touched(i)) for i in m]).collect()[0] for frame, marks, _ in counted]
        )
        return self._audited(df.sparkSession, results, [(marks, end, list(row)) for (_, marks, end), row in zip(counted, measured)])

    def audit_beside(self, df: DataFrame, write: Callable[[DataFrame], Any]) -> DataFrame:
        """``write`` gets the cleaned table and must run over all of it, once; the audit is counted by the same scan.

        The counts are metrics that Spark observes while rows pass: one observation before each step that drops rows, and
        one at the end.  No job is started but those of ``write``.  Metrics are those of the action that ended well, so a
        lost executor's tasks count once.
        """
        results, seen = self.bind(df), []

        def observed(frame: DataFrame, marks: list[int], end: int) -> DataFrame:
            seen.append((marks, end, Observation(f"rows before step {end + 1}, {uuid.uuid4().hex}")))
            return frame.observe(seen[-1][-1], F.count(F.lit(1)).alias("rows"), *[F.count_if(_touched(i)).alias(f"cells_{i}") for i in marks])

        _, cleaned = self._flagged(df, results, observed)
        write(cleaned)
        parts = [(marks, end, _observed(watch, marks)) for marks, end, watch in seen]
        return self._audited(df.sparkSession, results, parts)

    def _flagged(self, df: DataFrame, results: list[StepResult], watch: Callable) -> tuple[list[tuple[DataFrame, list[int], int]], DataFrame]:
        """Frames before each step that drops rows and at the end, with the flags they carry and the step; the final table."""
        frame, flags, counted = df, [], []
        for i, result in enumerate(results):
            if result.touched is not None and not result.refused:
                flags.append(i)
                frame = frame.withColumn(f"__touched_{i}", F.coalesce(result.touched, F.lit(False)))
            if result.drops_rows:
                frame = watch(frame, flags, i)
                counted.append((frame, flags, i))
                frame, flags = result.transform(frame.drop(*[f"__touched_{k}" for k in flags])), []
            else:
                frame = result.transform(frame)
        frame = watch(frame, flags, len(results))
        counted.append((frame, flags, len(results)))
        return counted, frame.drop(*[f"__touched_{k}" for k in flags])

    def _audited(self, spark, results: list[StepResult], parts: list[tuple[list[int], int, list[int]]]) -> DataFrame:
        """Rows of the audit from (flags, step, rows and cells of the flags) of each part of the recipe."""
        before: dict[int, int] = {}
        cells: dict[int, int] = {}
        start = 0
        for marks, end, row in parts:
            before.update(dict.fromkeys(range(start, end + 1), row[0]))
            cells.update(zip(marks, row[1:]))
            start = end + 1
        before[len(results)] = parts[-1][2][0]
        lines = []
        for i, (step, result) in enumerate(zip(self.steps, results)):
            after = before[i + 1] if result.drops_rows else before[i]
            counts = StepCounts(before[i], after, cells.get(i, 0))
            lines.append((i + 1, step.operation, step.column, *(counts.rows_before, counts.rows_after, counts.cells_changed), result.sentence(counts)))
        ddl = "step int, operation string, column string, rows_before bigint, rows_after bigint, cells_changed bigint, message string"
        return local_frame(spark, lines, ddl)


def _observed(watch: Observation, marks: list[int]) -> list[int]:
    """Rows and cells of an observation; zeros where Catalyst knew that no row comes by and left it out of the plan."""
    try:
        found = watch.get
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        return [0] * (1 + len(marks))
    return [found["rows"], *[found[f"cells_{i}"] for i in marks]]


def _touched(step: int) -> Column:
    return F.col(f"__touched_{step}")


# --- Suggestions -----------------------------------------------------------------------

SUGGESTION_STEPS = {
    "remove_duplicates": lambda c: Step("remove_duplicates"),
    "fill_missing_median": lambda c: Step("fill_missing", {"name": c, "strategy": "median"}),
    "fill_missing_mode": lambda c: Step("fill_missing", {"name": c, "strategy": "mode"}),
    "drop_missing_rows": lambda c: Step("drop_missing_rows", {"name": c}),
    "log_transform": lambda c: Step("log_transform", {"name": c}),
}


def suggestions(table: Table) -> DataFrame:
    """Problems with the step that fixes them: 1 first, 2 next, 3 optional."""
    df = table.df
    found, n_copies = together(lambda: profile(df, table.types, ()), lambda: count_copies(df))
    copies = local_frame(df.sparkSession, [(n_copies,)], "n bigint").where("n > 0")
    duplicate = copies.select(
        F.lit(1).alias("priority"),
        F.lit(1).alias("section"),
        F.lit(0).alias("ordinal"),
        F.concat(count_text(F.col("n")), F.lit(" duplicate rows found ("), percent(F.col("n"), F.lit(found.n_rows), 1).cast("string"), F.lit("% of your data).")).alias("issue"),
        F.lit("Remove duplicate rows").alias("action"),
        F.lit("remove_duplicates").alias("operation"),
        F.lit(None).cast("string").alias("column"),
    )
    pct = percent(F.col("missing"), F.lit(found.n_rows), 1)
    cells = count_text(F.col("missing"))
    name = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    number, date = F.col("semantic_type").isin("financial", "metric"), F.col("semantic_type") == "date_column"
    missing = found.frame.where("missing > 0").select(
        F.when(pct > V.SUGGEST_URGENT_PCT, 1).otherwise(2).alias("priority"),
        F.lit(2).alias("section"),
        "ordinal",
        F.concat(name, F.lit(" is "), pct.cast("string"), F.lit("% empty ("), cells, F.lit(" missing values).")).alias("issue"),
        F.when(number, F.concat(F.lit("Fill "), cells, F.lit(" empty values in "), name, F.lit(" with the median value")))
        .when(date, F.concat(F.lit("Remove "), cells, F.lit(" rows with a missing date in "), name))
        .otherwise(F.concat(F.lit("Fill "), cells, F.lit(" empty values in "), name, F.lit(" with the most common value")))
        .alias("action"),
        F.when(number, "fill_missing_median").when(date, "drop_missing_rows").otherwise("fill_missing_mode").alias("operation"),
        "column",
    )
    skewed = found.frame.where((F.abs("skewness") >= V.SKEW_LIMIT) & (F.col("minimum") >= 0)).select(
        F.lit(3).alias("priority"),
        F.lit(3).alias("section"),
        "ordinal",
        F.concat(name, F.lit(" has a very uneven value distribution — a few extreme values are much larger than the rest.")).alias("issue"),
        F.concat(F.lit("Apply log scale to "), name, F.lit(" to compress extreme values")).alias("action"),
        F.lit("log_transform").alias("operation"),
        "column",
    )
    return duplicate.unionByName(missing).unionByName(skewed).orderBy("priority", "section", "ordinal")


def suggested_recipe(table: Table) -> Recipe:
    """All suggestions as one recipe (a few steps per column at most)."""
    return Recipe(tuple(SUGGESTION_STEPS[r.operation](r.column) for r in suggestions(table).collect()))


def auto_clean(table: Table) -> DataFrame:
    return suggested_recipe(table).run(table.df)
