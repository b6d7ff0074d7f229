"""Profiling, quality scoring, cleaning and summarising tables with Spark DataFrames."""

from .plans.insights import insights
from .plans.profile import profile
from .plans.quality import column_health, findings, score_dataset
from .plans.recipe import Recipe, auto_clean, suggested_recipe, suggestions
from .plans.report import report, table_context, table_profile
from .plans.semantic import Table, detect, recommendations
from .sources.loading import load_csv, prepare
from .sources.saving import write_csv, write_report

__all__ = [
    "Recipe", "Table", "auto_clean", "column_health", "detect", "findings", "insights", "load_csv", "prepare", "profile",
    "recommendations", "report", "score_dataset", "suggested_recipe", "suggestions", "table_context", "table_profile", "write_csv", "write_report",
]
