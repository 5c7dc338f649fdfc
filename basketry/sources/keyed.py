"""Stages written bucketed and sorted by a key, so that work per key needs no exchange.

``write_keyed`` writes a table once, dealt and sorted by its key into buckets;
aggregates and joins by that key over ``KeyedStage.each`` then run inside the
buckets. A key with more than ``hot_rows`` rows would fill one bucket, so the
rows of such keys, and rows without a key, lie in a plain part beside the
buckets, where Spark's partial aggregates and skew splitting apply. A key lies wholly
in one part, so a function that works key by key gives the same rows over the
parts as over the table.

The buckets are a table of the session's catalog (Spark knows buckets only
there), its files below the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .storage import materialize

HOT_ROWS = 2_000_000
#: rows of a bucket that the number of buckets aims at
BUCKET_ROWS = 4_000_000


@dataclass(frozen=True)
class KeyedStage:
    """``buckets``: the table dealt by ``key``; ``rest``: rows of hot keys and of none, or None."""

    key: str
    buckets: DataFrame
    rest: DataFrame | None

    def each(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` over every part; right for work that keeps the rows of a key together and apart from others."""
        parts = [self.buckets] if self.rest is None else [self.buckets, self.rest]
        return reduce(DataFrame.unionByName, map(work, parts))


def write_keyed(df: DataFrame, key: str, label: str, hot_rows: int = HOT_ROWS, buckets: int | None = None) -> KeyedStage:
    """Write ``df`` as a ``KeyedStage``. Rows repeat as they do in ``df``; an empty table has empty buckets."""
    spark = df.sparkSession
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = materialize(sizes.where((F.col("__n") > hot_rows) | F.col(key).isNull()), f"{label}-hot")
    any_hot = not hot.isEmpty()
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    cold = df.where(F.col(key).isNotNull())
    rest = None
    if any_hot:
        names = hot.where(F.col(key).isNotNull()).select(key)  # at most rows / hot_rows of them
        rest = materialize(df.where(F.col(key).isNull()).unionByName(cold.join(names, key, "left_semi")), f"{label}-rest")
        cold = cold.join(names, key, "left_anti")
    table = f"keyed_{uuid.uuid4().hex[:16]}"
    (cold.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, label)).format("parquet").saveAsTable(table))
    return KeyedStage(key, spark.table(table), rest)
