"""Merging the basket tables into one order-line table, and product lookups.

Dimension sides (products, aisles, departments, name lookups) are broadcast
only after ``broadcast_if_within`` has proven their row count; the order
side is never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.basket import BasketTables
from ..sources.schemas import LINE_COLUMNS
from .joins import broadcast_if_within
from .sequence import row_numbers

DIMENSION_ROWS = 2_000_000

# Fixed value: label used by the name lookups for names absent from the dimension.
UNKNOWN = "Unknown"


def fill_nulls(df: DataFrame, value: int = 0) -> DataFrame:
    """``fillna(0)`` on a whole frame: numeric columns only."""
    return df.na.fill(value)


def merge_lines(orders: DataFrame, order_products: DataFrame) -> DataFrame:
    """orders ⋈ order lines on ``order_id`` (J1, inner: orders without lines vanish)."""
    return orders.join(order_products, "order_id", "inner")


def merge_products(lines: DataFrame, products: DataFrame, small: bool | None = None) -> DataFrame:
    """⋈ products on ``product_id`` (J2, inner)."""
    return lines.join(broadcast_if_within(products, DIMENSION_ROWS, small), "product_id", "inner")


def merge_dimensions(lines: DataFrame, aisles: DataFrame, departments: DataFrame,
                     small: bool | None = None) -> DataFrame:
    """⋈ aisles on ``aisle_id``, ⋈ departments on ``department_id`` (J3, inner)."""
    return lines.join(broadcast_if_within(aisles, DIMENSION_ROWS, small), "aisle_id", "inner") \
        .join(broadcast_if_within(departments, DIMENSION_ROWS, small), "department_id", "inner")


def merge_full(tables: BasketTables, small: bool | None = None, small_labels: bool | None = None) -> DataFrame:
    """The merged order-line table: null days filled with 0, then J1, J2, J3.

    ``small``, ``small_labels``: the products, and the aisles and departments,
    are already proven to fit a broadcast, or not to.
    """
    orders = fill_nulls(tables.orders)
    lines = merge_lines(orders, tables.order_products)
    lines = merge_products(lines, tables.products, small)
    lines = merge_dimensions(lines, tables.aisles, tables.departments, small_labels)
    return lines.select(*LINE_COLUMNS)


def counts_with_names(counts: DataFrame, products: DataFrame, small: bool | None = None) -> DataFrame:
    """Per-product counts ⟕ products on ``product_id``."""
    return counts.join(broadcast_if_within(products, DIMENSION_ROWS, small), "product_id", "left")


def product_dim(products: DataFrame, aisles: DataFrame, departments: DataFrame,
                small_labels: bool | None = None) -> DataFrame:
    """products ⟕ aisles ⟕ departments."""
    return products.join(broadcast_if_within(aisles, DIMENSION_ROWS, small_labels), "aisle_id", "left") \
        .join(broadcast_if_within(departments, DIMENSION_ROWS, small_labels), "department_id", "left") \
        .select("product_id", "product_name", "aisle_id", "aisle", "department_id", "department")


def name_attributes(dim: DataFrame) -> DataFrame:
    """name → (aisle, department), one row per name.

    A Python ``dict(zip(names, values))`` keeps the *last* product of a
    duplicated name; rows have no order in Spark, so the product with the
    largest ``product_id`` wins (a fixed, documented tie rule).
    """
    return dim.where(F.col("product_name").isNotNull()).groupBy("product_name").agg(
        F.max_by("aisle", "product_id").alias("aisle"),
        F.max_by("department", "product_id").alias("department"),
    )


def lookup_with_default(names: DataFrame, dim: DataFrame, name_col: str = "product_name",
                        small: bool | None = None) -> DataFrame:
    """Attach aisle and department to a set of names, ``'Unknown'`` when absent."""
    attrs = broadcast_if_within(name_attributes(dim), DIMENSION_ROWS, small)
    return names.join(attrs, names[name_col] == attrs["product_name"], "left").select(
        names[name_col].alias(name_col),
        F.coalesce(attrs["aisle"], F.lit(UNKNOWN)).alias("aisle"),
        F.coalesce(attrs["department"], F.lit(UNKNOWN)).alias("department"),
    )


def product_id_to_name(df: DataFrame, products: DataFrame, small: bool | None = None) -> DataFrame:
    """Replace ``product_id`` by the product's name, keeping column position."""
    named = df.join(broadcast_if_within(products.select("product_id", "product_name"),
                                        DIMENSION_ROWS, small), "product_id", "left")
    cols = [F.col("product_name").alias("product_name") if c == "product_id" else F.col(c)
            for c in df.columns if c != "product_name"]
    return named.select(*cols)


def category_codes(df: DataFrame, column: str, out: str | None = None,
                   small: bool | None = None) -> DataFrame:
    """0-based codes in ascending value order, NULL stays NULL (P6, pandas ``category``).

    The distinct values are numbered with the range-partitioned global row
    number (no single-partition window), then joined back.
    """
    out = out or f"{column}_code"
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = row_numbers(values, [], [column], "__code", bounded=bool(small)) \
        .select(column, (F.col("__code") - 1).cast("int").alias(out))
    return df.join(broadcast_if_within(codes, DIMENSION_ROWS, small), column, "left") \
        .select(*df.columns, out)


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"DataFrame", "F"}]
