"""Broadcast joins behind a check of the broadcast side's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a parameter table (fields, categories) that are broadcast at most.
MOST_ROWS = 100_000


def broadcast_if_small(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``rows`` marked for a broadcast if they are at most ``most``, else as they are, for a shuffled join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
