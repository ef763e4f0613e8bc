"""Broadcast only what is known to be small.

``small_side`` counts the side first (a bounded ``limit`` count, so the check itself stays cheap) and
gives the hint only below the bound; beyond it the join is left to the planner, which then shuffles
both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_small(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df
