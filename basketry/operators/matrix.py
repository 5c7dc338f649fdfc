"""User × product matrix in long and wide form, column-shape operators, splits.

The canonical matrix is long: ``(user_id, product_name, sticky)``, absent
pairs meaning 0. The wide pivot (one column per product name) exists for
parity with the reference and is refused beyond ``MAX_WIDE_COLUMNS``; the
sparse per-user vector is the scalable input of the latent models.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from ..sources.schemas import USER_FEATURES
from .joins import broadcast_if_within
from .selection import sample_hash
from .sequence import row_numbers

MAX_WIDE_COLUMNS = 50_000          # a wide schema lives on the driver
MAX_CATALOGUE_ROWS = 2_000_000
BATCH_ROWS = 256                   # fixed value: mini-batch size of the reference
VALIDATION_FRACTION = 0.2          # fixed value: Keras validation_split
SPLIT_SEED = 7


def select_by_name(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def select_from_position(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """``iloc[:, start:stop]`` resolved to names once."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P3."""
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P4."""
    return df.withColumnsRenamed(dict(mapping))


def duplicate_keys(pairs: DataFrame, keys=("user_id", "product_name"), item: str = "product_id") -> DataFrame:
    """Key pairs that a pivot would see twice (D5); the matrix step refuses a non-empty result."""
    return pairs.groupBy(*keys).agg(F.count_distinct(item).alias("n_items")) \
        .where(F.col("n_items") > 1)


def product_columns(long: DataFrame, item: str = "product_name",
                    max_columns: int = MAX_WIDE_COLUMNS) -> list[str]:
    """Sorted product names that become the wide columns (a schema, so bounded and checked)."""
    names = long.select(item).where(F.col(item).isNotNull()).distinct() \
        .limit(max_columns + 1).collect()
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} product columns: use the long or sparse form")
    return sorted(r[0] for r in names)


def sticky_matrix(long: DataFrame, item: str = "product_name", value: str = "sticky",
                  columns: list[str] | None = None) -> DataFrame:
    """Wide pivot: one row per user, one column per product name, absent = 0.

    Two values for one cell stop the query, as the reference's pivot does
    (D5); the check is part of the same aggregate. Product names may hold any
    characters. The cells are dealt by user before both aggregates (a user has
    one per product), so no half-filled wide row is shuffled.
    """
    cols = columns if columns is not None else product_columns(long, item)
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate (user_id, product_name) cell")).cast("double")) \
        .otherwise(F.max(value))
    cell = F.when(F.col(item).isNotNull(), cell)
    wide = long.select("user_id", item, value).repartition("user_id").groupBy("user_id", item).agg(cell.alias("__cell")).groupBy("user_id").pivot(item, cols).agg(F.max("__cell"))
    return wide.select("user_id", *(F.coalesce(F.col(quoted(c)), F.lit(0.0)).alias(c) for c in cols))


def melt(wide: DataFrame, keys: Iterable[str], item: str = "product_name", value: str = "value") -> DataFrame:
    """The wide matrix back in long form, zeros included."""
    keys = list(keys)
    return wide.unpivot([F.col(quoted(k)) for k in keys],
                        [F.col(quoted(c)) for c in wide.columns if c not in keys], item, value)


def user_constants(rows: DataFrame, cols: Iterable[str] = tuple(USER_FEATURES)) -> DataFrame:
    """Per-user constant columns, one row per user (A17; ``first()`` → ``max``)."""
    return rows.groupBy("user_id").agg(*[F.max(c).alias(c) for c in cols])


def user_matrix(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """user features ⋈ wide matrix on ``user_id``."""
    return user_constants(rows).join(wide, "user_id", "inner")


def product_index(long: DataFrame, item: str = "product_name", bounded: bool = False) -> DataFrame:
    """0-based column index of each product in ascending name order."""
    names = long.select(item).where(F.col(item).isNotNull()).distinct()
    return row_numbers(names, [], [item], "__rn", bounded).select(
        item, (F.col("__rn") - 1).cast("int").alias("idx"))


def sparse_triples(long: DataFrame, index: DataFrame, item: str = "product_name",
                   value: str = "sticky", small: bool | None = None) -> DataFrame:
    """``(user_id, idx, value)`` — the matrix as non-zero cells; the catalogue index is
    broadcast once its size is proven."""
    return long.join(broadcast_if_within(index, MAX_CATALOGUE_ROWS, small), item, "inner") \
        .select("user_id", "idx", F.col(value).alias("value"))


def user_arrays(triples: DataFrame) -> DataFrame:
    """One sparse vector per user (R4): ``(user_id, indices array<int>, values array<double>)``, by index.

    A user's cells are bounded by the catalogue (one per product).
    """
    grouped = triples.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("cells"))
    return grouped.select("user_id", F.col("cells.idx").alias("indices"),
                          F.col("cells.value").cast("array<double>").alias("values"))


def holdout_split(users: DataFrame, fraction: float = VALIDATION_FRACTION, seed: int = SPLIT_SEED,
                  user_col: str = "user_id") -> DataFrame:
    """Train / validation assignment by a per-user hash (R7): row order does not exist in Spark."""
    is_val = sample_hash(F.col(user_col), seed) < F.lit(int(fraction * 2 ** 32))
    return users.withColumn("split", F.when(is_val, F.lit("validation")).otherwise(F.lit("train")))


def minibatch_ids(users: DataFrame, n_batches: int, seed: int = SPLIT_SEED,
                  user_col: str = "user_id") -> DataFrame:
    """Mini-batch bucket per user (R8): ``hash mod n_batches``."""
    return users.withColumn("batch", F.pmod(sample_hash(F.col(user_col), seed), F.lit(n_batches)).cast("int"))


def batch_count(n_rows: int, batch: int = BATCH_ROWS) -> int:
    return max(1, -(-n_rows // batch))
