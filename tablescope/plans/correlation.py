"""Correlations of numeric columns and variance inflation, from sums of one scan.

Pairs of columns are in long form: a row becomes one (pair number, x, y) cell per pair, and a grouping with a small state sums up
the co-moments of each pair, so code does not grow with columns.  Correlations are over the rows where both are present.

Variance inflation tells how well a column is given by all others together.  It needs one matrix over the same rows, those
without a missing cell: the same pair sums over these rows, and the inverse of the matrix on its diagonal.  The matrix has a row
per column; columns that are constant or given exactly by others have no finite inflation (null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, missing, number_columns
from .measures import local_frame, together

SINGULAR = 1e-10  # a pivot below this share means the column is given by those before


def _pairs(df: DataFrame, cells: list[Column]) -> dict[tuple[int, int], tuple[int, float | None]]:
    """Rows and correlation of each pair of cells."""
    pairs = list(combinations(range(len(cells)), 2))
    if not pairs:
        return {}
    both = F.array(*[F.when(cells[i].isNotNull() & cells[j].isNotNull(), F.struct(cells[i].alias("x"), cells[j].alias("y"))) for i, j in pairs])
    varied = (F.min("p.x") < F.max("p.x")) & (F.min("p.y") < F.max("p.y"))  # moments of a constant may be rounded off zero
    related = F.when(varied, F.try_divide(F.covar_pop("p.x", "p.y"), F.stddev_pop("p.x") * F.stddev_pop("p.y")))
    rows = df.select(F.posexplode(both).alias("k", "p")).where("p IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), related.alias("r"))
    found = {pairs[r.k]: (r.n, r.r) for r in rows.collect()}
    return dict.fromkeys(pairs, (0, None)) | found


def inflation(matrix: np.ndarray) -> list[float | None]:
    """The diagonal of a correlation matrix's inverse, from its factor; null for columns that are given by others.

    A column among those that depend on each other has no finite value; the others keep theirs.
    """
    out: list[float | None] = []
    for k in range(len(matrix)):
        others = [i for i in range(len(matrix)) if i != k]
        left, spread, _ = np.linalg.svd(matrix[np.ix_(others, others)], hermitian=True) if others else (np.zeros((0, 0)), np.zeros(0), None)
        strong = spread > SINGULAR
        shared = (left[:, strong].T @ matrix[others, k]) ** 2 / spread[strong] if others else np.zeros(0)
        rest = 1 - float(shared.sum())
        out.append(None if not np.isfinite(rest) or rest < SINGULAR else 1 / rest)
    return out


def correlations(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column_a, column_b, n_rows, correlation)`` of each pair of numeric columns, in schema order; null if one is constant."""
    names = number_columns(df) if names is None else names
    found = _pairs(df, [F.when(~missing(df, n), col(n).cast("double")) for n in names])
    lines = [(names[i], names[j], n, r) for (i, j), (n, r) in found.items()]
    return local_frame(df.sparkSession, lines, "column_a string, column_b string, n_rows bigint, correlation double")


def variance_inflation(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(ordinal, column, n_rows, vif)`` over the rows without a missing cell in ``names``."""
    names = number_columns(df) if names is None else names
    complete = df.where(~F.coalesce(*[F.when(missing(df, n), True) for n in names], F.lit(False))) if names else df
    cells = [col(n).cast("double") for n in names]
    found, n_rows = together(lambda: _pairs(complete, cells), complete.count)
    matrix = np.eye(len(names))
    constant = set(range(len(names))) if len(names) > 1 else set()
    for (i, j), (_, r) in found.items():
        matrix[i, j] = matrix[j, i] = 0.0 if r is None else r
        constant -= {i, j} if r is not None else set()
    vif = [None if i in constant else v for i, v in enumerate(inflation(matrix))]
    lines = [(i, n, n_rows, v) for i, (n, v) in enumerate(zip(names, vif))]
    return local_frame(df.sparkSession, lines, "ordinal int, column string, n_rows bigint, vif double")
