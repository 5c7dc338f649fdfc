"""Ordered running aggregates that do not put a hot key into one task.

``row_number``/``lag``/running ``sum`` over ``Window.partitionBy(key)`` send
every row of a key to one task; with one user (or one order, or one tie
group) holding a third of all rows that task is the job. The operator here
computes the same numbers in three steps:

1. ``repartitionByRange`` on (key, order): the sampled bounds cut a hot key
   into several ranges, because the order columns are part of the range key.
2. the running value inside each (range partition, key) block, a window
   whose groups are bounded by the range partition size.
3. the totals of the blocks of the same key that sit in *earlier* range
   partitions (a table of at most keys + partitions rows), joined back.

The range-partitioned rows, tagged with their partition id, are read by
step 2 and step 3. Range bounds come from a random sample, so two
evaluations could place a row in different partitions; the tagged rows are
therefore checkpointed once (reliable ``DataFrame.checkpoint`` into the
shared ``spark.checkpoint.dir``), which also keeps the result stable when
an executor is lost and a stage is recomputed.

Keys are first counted (a partial aggregate). Keys with at most
``HOT_KEY_ROWS`` rows — normally all of them — use a plain window
partitioned by key, since such a group fits one task; only the hot keys
(broadcast as a small set: at most rows / HOT_KEY_ROWS of them) take the
range-partitioned path, and the two parts are unioned.

With ``keys=[]`` the result is a global running aggregate (for example the
cumulative share over all products) without a single-partition window.
The caller must supply a total order (unique within a key), otherwise the
running value of tied rows is not defined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PID = "__range_pid"
HOT_KEY_ROWS = 2_000_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column] | None = None,
    prior_max: dict[str, Column] | None = None,
    partitions: int | None = None,
    totals: bool = False,
    hot_rows: int = HOT_KEY_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Add running aggregates along ``order`` inside each ``keys`` group.

    ``sums``: ``{out: value}`` adds the inclusive running sum of ``value``
    (use ``F.lit(1)`` for a 1-based row number).
    ``prior_max``: ``{out: value}`` adds the maximum of ``value`` over the
    rows *before* the current one (NULL on the first row); when ``value``
    grows along ``order`` this is ``lag(value)``.
    ``totals``: also add ``{out}_total``, the sum over the whole key group
    (for ``keys=[]`` the grand total), taken from the block table.
    ``bounded``: the caller has proven that ``df`` has at most ``hot_rows``
    rows (for example a set of catalogue products); a global order then
    runs as one plain window.
    """
    sums = sums or {}
    prior_max = prior_max or {}
    keys = list(keys)
    if not keys:
        if bounded:
            return _windowed(df, keys, order, sums, prior_max, totals)
        return _ranged(df, keys, order, sums, prior_max, partitions, totals)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > F.lit(hot_rows)).select(*keys)
    if hot.limit(1).count() == 0:
        return _windowed(df, keys, order, sums, prior_max, totals)
    hot = F.broadcast(hot)
    plain = _windowed(df.join(hot, keys, "left_anti"), keys, order, sums, prior_max, totals)
    split = _ranged(df.join(hot, keys, "left_semi"), keys, order, sums, prior_max, partitions, totals)
    return plain.unionByName(split)


def _windowed(df, keys, order, sums, prior_max, totals) -> DataFrame:
    """Plain per-key windows: used when every key group fits one task."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = [F.col(f"`{c}`") for c in df.columns]
    cols += [F.sum(expr).over(upto).alias(name) for name, expr in sums.items()]
    cols += [F.max(expr).over(before).alias(name) for name, expr in prior_max.items()]
    if totals:
        cols += [F.sum(expr).over(whole).alias(f"{name}_total") for name, expr in sums.items()]
    return df.select(*cols)


def _ranged(df, keys, order, sums, prior_max, partitions, totals) -> DataFrame:
    """Range-partitioned blocks with offsets from earlier blocks (hot keys, global order)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = partitions or _partitions(df)

    staged = df
    for name, expr in sums.items():
        staged = staged.withColumn(f"__v_{name}", expr)
    for name, expr in prior_max.items():
        staged = staged.withColumn(f"__m_{name}", expr)

    ensure_checkpoint_dir(df.sparkSession)
    ranged = staged.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols) \
        .withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True)

    block = Window.partitionBy(_PID, *keys).orderBy(*order_cols)
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged
    for name in sums:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(upto))
    for name in prior_max:
        local = local.withColumn(f"__l_{name}", F.max(f"__m_{name}").over(before))

    aggs = [F.sum(f"__v_{name}").alias(f"__b_{name}") for name in sums]
    aggs += [F.max(f"__m_{name}").alias(f"__b_{name}") for name in prior_max]
    blocks = local.groupBy(_PID, *keys).agg(*aggs)
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy()) \
        .orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = (Window.partitionBy(*keys) if keys else Window.partitionBy()) \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = blocks.select(
        _PID, *keys,
        *[F.coalesce(F.sum(f"__b_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}")
          for name in sums],
        *[F.sum(f"__b_{name}").over(whole).alias(f"{name}_total") for name in sums if totals],
        *[F.max(f"__b_{name}").over(earlier).alias(f"__o_{name}") for name in prior_max],
    )

    joined = local.join(offsets, [_PID, *keys], "inner")
    out = joined
    for name in sums:
        out = out.withColumn(name, F.col(f"__l_{name}") + F.col(f"__o_{name}"))
    for name in prior_max:
        out = out.withColumn(name, F.greatest(F.col(f"__l_{name}"), F.col(f"__o_{name}")))
    keep = list(df.columns) + list(sums) + list(prior_max)
    if totals:
        keep += [f"{name}_total" for name in sums]
    return out.select(*keep)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                out: str, bounded: bool = False) -> DataFrame:
    """1-based ``row_number()`` within ``keys`` along a total ``order``."""
    return running_aggregates(df, keys, order, sums={out: F.lit(1)}, bounded=bounded) \
        .withColumn(out, F.col(out).cast("int"))
