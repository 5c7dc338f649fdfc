"""Segment profiles: bases, product / aisle / department means, top and bottom lists.

The reference builds a wide user × product frame and loops over clusters.
Here everything is long and single-pass:

* a segment mean is ``sum(value) / users_in_segment`` over the *present*
  cells (an absent cell is 0 and adds nothing);
* the top-n / bottom-n lists must still see absent items (mean 0). Rather
  than joining every segment with every item, the items are numbered in
  ascending name order and, per segment, only the first and last ``n``
  absent numbers of each gap between present items are emitted — enough to
  contain the ``n`` smallest and largest absent names. Work is bounded by
  ``present cells × 2n``.

Total order for ranks: mean descending, item ascending; "bottom" is the tail
of the same order (``tail`` keeps descending order, so its last item is the
smallest mean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import USER_FEATURES
from .joins import broadcast_if_within
from .merge import DIMENSION_ROWS, lookup_with_default
from .sequence import running_aggregates

CLUSTER_ROWS = 100_000
TOP_N = 10          # fixed value: top 10 per segment charts
EXTREME_N = 5       # fixed value: top 5 and bottom 5 lists


def label_by_modulo(users: DataFrame, k: int = 3) -> DataFrame:
    """Fixture label ``user_id % k`` so profiles do not depend on clustering."""
    return users.select("user_id", F.pmod(F.col("user_id"), F.lit(k)).cast("int").alias("cluster")) \
        .distinct()


def attach_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``df['cluster'] = y_pred`` by key, not by row position."""
    return rows.join(labels, "user_id", "inner")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Users per cluster."""
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("users"))


def segment_rows(labelled: DataFrame, cluster: int) -> DataFrame:
    """``data[data['cluster'] == c]``."""
    return labelled.where(F.col("cluster") == F.lit(cluster))


def segment_bases(user_rows: DataFrame, labels: DataFrame, cols=tuple(USER_FEATURES)) -> DataFrame:
    """Mean of each user feature per cluster, transposed to ``(feature, cluster, mean)``.

    NULL features (users below the order minimum) are skipped by ``avg`` (Q16).
    """
    per = attach_labels(user_rows.select("user_id", *cols), labels).groupBy("cluster") \
        .agg(*[F.avg(c).alias(c) for c in cols])
    return per.unpivot(["cluster"], list(cols), "feature", "mean")


def segment_means(values: DataFrame, labels: DataFrame, item: str) -> DataFrame:
    """``groupby('cluster').mean()`` of a long ``(user_id, item, value)`` matrix, absent = 0.

    The per-cluster user counts (one row per segment) are broadcast once proven small.
    """
    sizes = cluster_sizes(labels)
    sums = attach_labels(values, labels).groupBy("cluster", item).agg(F.sum("value").alias("total"))
    return sums.join(broadcast_if_within(sizes, CLUSTER_ROWS), "cluster").select(
        "cluster", item, (F.col("total") / F.col("users")).alias("mean"))


def roll_up(values: DataFrame, dim: DataFrame, level: str, item: str = "product_name",
            small: bool | None = None) -> DataFrame:
    """Add the product cells of one aisle / department per user.

    Names absent from the dimension roll up into ``'Unknown'`` (J14).
    """
    names = values.select(item).distinct()
    lookup = lookup_with_default(names, dim, item, small).select(item, level)
    return values.join(broadcast_if_within(lookup, DIMENSION_ROWS, small), item, "inner") \
        .groupBy("user_id", level).agg(F.sum("value").alias("value"))


def item_counts(names: DataFrame, dim: DataFrame, level: str, n: int = EXTREME_N,
                item: str = "product_name", small: bool | None = None) -> DataFrame:
    """Products per aisle / department among the matrix columns, top ``n``."""
    lookup = lookup_with_default(names.select(item).distinct(), dim, item, small)
    return lookup.groupBy(level).agg(F.count(F.lit(1)).alias("n_products")) \
        .orderBy(F.col("n_products").desc(), F.col(level).asc()).limit(n)


def _numbered_universe(universe: DataFrame, item: str, bounded: bool = False) -> DataFrame:
    """``(item, g, n_items)``: 1-based number in ascending name order and the item count."""
    run = running_aggregates(universe.select(item).where(F.col(item).isNotNull()).distinct(),
                             [], [item], sums={"g": F.lit(1)}, totals=True, bounded=bounded)
    return run.select(item, F.col("g").cast("long").alias("g"),
                      F.col("g_total").cast("long").alias("n_items"))


#: sub-groups of a segment whose own first items are ranked before the segment's
RANK_BUCKETS = 64


def _first_items(items: DataFrame, item: str, n: int, *order) -> DataFrame:
    """The first ``n`` items per cluster with their rank: first of each hash bucket, then of the cluster."""
    bucket = F.pmod(F.xxhash64(item), F.lit(RANK_BUCKETS))
    near = Window.partitionBy("cluster", "__bucket").orderBy(*order)
    few = items.withColumn("__bucket", bucket).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= n)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))) \
        .where(F.col("rank") <= n)


def ranked_items(means: DataFrame, universe: DataFrame, item: str, top: int, bottom: int,
                 bounded: bool = False, segments: DataFrame | None = None) -> DataFrame:
    """Top ``top`` and bottom ``bottom`` items per cluster, absent items counting as 0.

    Result: ``(cluster, end, rank, item, mean)`` with ``end`` in
    {'top', 'bottom'}; ``rank`` is 1-based from the respective end. When a
    cluster has fewer items than ``top + bottom`` the lists overlap (Q18).
    ``segments`` (with a ``cluster`` column) names all clusters, so that one
    without any present item gets its lists of zeros too.
    """
    k = max(top, bottom)
    numbered = _numbered_universe(universe, item, bounded)
    present = means.join(numbered, item, "inner")
    w = Window.partitionBy("cluster").orderBy("g")
    gaps = present.select(
        "cluster", "g", "n_items",
        F.coalesce(F.lag("g").over(w), F.lit(0)).alias("prev_g"),
        F.lead("g").over(w).alias("next_g"),
    )
    prev_gap = F.array_union(
        F.sequence(F.col("prev_g") + 1, F.least(F.col("g") - 1, F.col("prev_g") + k)),
        F.sequence(F.greatest(F.col("prev_g") + 1, F.col("g") - k), F.col("g") - 1))
    tail_gap = F.array_union(
        F.sequence(F.col("g") + 1, F.least(F.col("n_items"), F.col("g") + k)),
        F.sequence(F.greatest(F.col("g") + 1, F.col("n_items") - k + 1), F.col("n_items")))
    empty = F.array().cast("array<long>")
    cand = gaps.select(
        "cluster",
        F.explode(F.array_union(
            F.when(F.col("g") - F.col("prev_g") > 1, prev_gap).otherwise(empty),
            F.when(F.col("next_g").isNull() & (F.col("n_items") > F.col("g")), tail_gap).otherwise(empty),
        )).alias("g")).distinct()
    absent = cand.join(numbered.select("g", item), "g", "inner") \
        .select("cluster", item, F.lit(0.0).alias("mean"))
    items = present.select("cluster", item, "mean").unionByName(absent)
    if segments is not None:
        n = numbered.agg(F.max("n_items")).first()[0] or 0
        ends = sorted({g for g in (*range(1, min(k, n) + 1), *range(max(1, n - k + 1), n + 1))})
        blank = segments.select("cluster").distinct().join(means.select("cluster").distinct(), "cluster", "left_anti")
        items = items.unionByName(
            blank.select("cluster", F.explode(F.array(*(F.lit(g).cast("long") for g in ends)).cast("array<long>")).alias("g"))
            .join(numbered.select("g", item), "g").select("cluster", item, F.lit(0.0).alias("mean")))
    out = []
    if top:
        out.append(_first_items(items, item, top, F.col("mean").desc(), F.col(item).asc()).withColumn("end", F.lit("top")))
    if bottom:
        out.append(_first_items(items, item, bottom, F.col("mean").asc(), F.col(item).desc())
                   .withColumn("end", F.lit("bottom")))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return both.select("cluster", "end", "rank", item, "mean")


def top_items(means: DataFrame, universe: DataFrame, item: str, n: int = TOP_N,
              bounded: bool = False) -> DataFrame:
    """Top ``n`` items per cluster, ``(cluster, rank, item, mean)`` (T4)."""
    return ranked_items(means, universe, item, n, 0, bounded).drop("end")
