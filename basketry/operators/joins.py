"""Join helpers.

A side is broadcast only after its size has been proven: ``limit(n + 1)``
counts at most ``n + 1`` rows, so the check is cheap even when the side is
not small. Beyond the bound the plain join stays, and Spark (with AQE) picks
a sort-merge or shuffled hash join and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_within(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_within(df: DataFrame, max_rows: int, known: bool | None = None) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``.

    ``known`` passes a bound proven elsewhere (for example on the table the
    side is derived from), which saves the counting job.
    """
    small = row_count_within(df, max_rows) if known is None else known
    return F.broadcast(df) if small else df
