"""Exact top-k per group.

``row_number() <= k`` over a window is planned with a partial, map-side
group limit (``WindowGroupLimit``) before the shuffle, so each map task sends
at most k rows per group and a hot group never ships all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """The k first rows of each group in ``order`` (1-based ``rank``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
