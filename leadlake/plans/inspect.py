"""Plan text of a frame, for checks and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """The physical plan as Spark prints it."""
    return df._jdf.queryExecution().executedPlan().toString()
