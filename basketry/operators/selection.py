"""Pareto product selection, user sampling and distinct values.

The reference keeps the products whose running share of all order lines
stays within 80 %, then drops the 6 most bought products. The running share
needs a global order over products; it is computed with the range-partitioned
running sum, so no single-partition window and no cross join with a one-row
total is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import running_aggregates

# Fixed values of the selection step.
PARETO_PERCENT = 80.0
TOP_EXCLUDED = 6
SAMPLE_FRACTION = 0.25
SAMPLE_SEED = 16


def product_counts(lines: DataFrame, key: str = "product_id") -> DataFrame:
    """``value_counts()``: lines per product, as ``(key, observation_count)``.

    The aggregate is partial before the shuffle, so a product with a third of
    all lines is reduced to one row per map task first.
    """
    return lines.where(F.col(key).isNotNull()).groupBy(key) \
        .agg(F.count(F.lit(1)).alias("observation_count"))


def _count_order(key: str) -> list[Column]:
    return [F.col("observation_count").desc(), F.col(key).asc()]


def cumulative_share(counts: DataFrame, key: str = "product_id", bounded: bool = False) -> DataFrame:
    """Running share of all lines in descending count order, in percent.

    ROWS semantics with the tie-break ``key`` ascending: tied counts get
    distinct running totals (5, 10, 13 for counts 5, 5, 3). ``bounded``: the
    product set is proven small (a catalogue bound), so one window suffices;
    otherwise the range-partitioned running sum is used.
    """
    run = running_aggregates(counts, [], _count_order(key),
                             sums={"__cum": F.col("observation_count")}, totals=True, bounded=bounded)
    return run.select(
        *counts.columns,
        (F.col("__cum") / F.col("__cum_total") * F.lit(100.0)).alias("cumulative_percentage"),
    )


def observation_share(counts: DataFrame, key: str = "product_id", bounded: bool = False) -> DataFrame:
    """Each product's share of all lines, in percent."""
    run = running_aggregates(counts, [], _count_order(key),
                             sums={"__cum": F.col("observation_count")}, totals=True, bounded=bounded)
    return run.select(
        *counts.columns,
        (F.col("observation_count") / F.col("__cum_total") * F.lit(100.0)).alias("observation_percentage"),
    )


def pareto_cutoff(shares: DataFrame, percent: float = PARETO_PERCENT) -> DataFrame:
    """Products whose running share, own share included, is at most ``percent`` (F1)."""
    return shares.where(F.col("cumulative_percentage") <= F.lit(float(percent)))


def pareto_target(cutoff: DataFrame) -> DataFrame:
    """Number of products kept by the cutoff, one row (F2)."""
    return cutoff.agg(F.count(F.lit(1)).alias("target"))


def top_products(counts: DataFrame, n: int = TOP_EXCLUDED, key: str = "product_id") -> DataFrame:
    """The ``n`` most bought products, ties by ascending key."""
    return counts.orderBy(*_count_order(key)).limit(n)


def lines_in_products(lines: DataFrame, kept: DataFrame, key: str = "product_id",
                      bounded: bool = False) -> DataFrame:
    """``isin(kept)`` as a semi join.

    With ``bounded`` (the catalogue's size is proven) the product set is
    broadcast and the line table is filtered in place, with no shuffle of its
    columns by the skewed product key. Otherwise AQE decides from the measured
    size of the set.
    """
    side = kept.select(key)
    return lines.join(F.broadcast(side) if bounded else side, key, "left_semi")


def lines_without_products(lines: DataFrame, excluded: DataFrame, key: str = "product_id",
                           bounded: bool = False) -> DataFrame:
    """``~isin(excluded)`` as an anti join (F5); ``bounded`` when ``excluded`` is a top-n."""
    side = excluded.select(key)
    return lines.join(F.broadcast(side) if bounded else side, key, "left_anti")


def pareto_lines(lines: DataFrame, percent: float = PARETO_PERCENT, top: int = TOP_EXCLUDED,
                 key: str = "product_id", bounded: bool = False) -> DataFrame:
    """Lines of the products in the running-share head, without the ``top`` most bought."""
    counts = product_counts(lines, key)
    cutoff = pareto_cutoff(cumulative_share(counts, key, bounded), percent)
    kept = lines_without_products(cutoff, top_products(counts, top, key), key, bounded=True)
    return lines_in_products(lines, kept, key, bounded)


def sample_hash(user: Column, seed: int) -> Column:
    """First 8 hex digits of ``md5('seed:user')`` as a number in [0, 2^32)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), user.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sample_predicate(user: Column, fraction: float = SAMPLE_FRACTION, seed: int = SAMPLE_SEED) -> Column:
    """Deterministic per-user sample membership: hash below ``fraction · 2^32``.

    It depends on the user id only, so keeping all rows of the sampled users
    is a filter with no join and no shuffle.
    """
    return sample_hash(user, seed) < F.lit(int(fraction * 2 ** 32))


def sample_users(rows: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int = SAMPLE_SEED,
                 user_col: str = "user_id", exact: bool = False) -> DataFrame:
    """Distinct sampled users.

    ``exact=True`` keeps exactly ``round(fraction · n)`` users (half to even):
    the users with the smallest hashes, numbered with the range-partitioned
    global row number.
    """
    users = rows.select(user_col).where(F.col(user_col).isNotNull()).distinct()
    if not exact:
        return users.where(sample_predicate(F.col(user_col), fraction, seed))
    ranked = running_aggregates(
        users.withColumn("__h", sample_hash(F.col(user_col), seed)),
        [], [F.col("__h"), F.col(user_col)], sums={"__rn": F.lit(1)}, totals=True)
    return ranked.where(F.col("__rn") <= F.bround(F.col("__rn_total") * F.lit(float(fraction)))) \
        .select(user_col)


def sample_user_rows(rows: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int = SAMPLE_SEED,
                     user_col: str = "user_id", exact: bool = False) -> DataFrame:
    """All rows of the sampled users."""
    if not exact:
        return rows.where(sample_predicate(F.col(user_col), fraction, seed))
    return rows.join(sample_users(rows, fraction, seed, user_col, exact=True), user_col, "left_semi")


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """``drop_duplicates`` / ``unique`` (R2)."""
    return df.select(*cols).distinct()


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"Column", "DataFrame", "F"}]
