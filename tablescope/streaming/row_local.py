"""Row-by-row cleaning of a stream: the same projections and filters, on an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import nan_to_null
from ..plans.recipe import Recipe
from ..sources.loading import null_tokens, trim_header


def clean_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """Header trim, missing tokens and the recipe; refuses steps that need the whole table."""
    whole = [s.operation for s in recipe.steps if not s.row_local]
    if whole:
        raise ValueError(f"these steps need the whole table, so they cannot run on a stream: {whole}")
    return recipe.run(nan_to_null(null_tokens(trim_header(stream))))
