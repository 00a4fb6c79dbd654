"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimension rows up to which a side is broadcast; beyond, Spark joins by shuffle and splits skewed keys.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows; the count stops just beyond."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
