"""Readers for the driver's star-schema tables and the fixture adapters.

The reference works on five grocery tables (orders, order lines, products,
aisles, departments). The test data is a TPC-H-like star schema, so the
adapters below derive those five tables from it (FIXTURES.md):

* grain ``"name"`` (fixture A): a product is a part *name*; its id is the
  smallest part key with that name; the aisle is the second word of the
  name, the department the first word.
* grain ``"part"`` (fixture B): a product is a part key; the name is the
  (non-unique) part name, the aisle the brand, the department the type; the
  product dimension keeps only parts with ``p_size > 5`` so that lookups
  meet unknown products.

The order number per customer (a customer may hold any share of all
orders) is computed with the range-partitioned running aggregate in
``operators.sequence``, so a hot customer is split across tasks. The cart
position is a plain window per order: after grouping to one row per
(order, product) an order holds at most one row per catalogue product, so
its window partition is bounded by the catalogue, not by the data.
Dimension vocabularies (aisles, departments) are numbered with a global
window over their *distinct* values, which the catalogue bounds as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_within, row_count_within
from ..operators.sequence import HOT_KEY_ROWS, running_aggregates
from .storage import read_parquet

# Fixed values of the fixture definition.
EVAL_SET = "prior"
MIN_SIZE_IN_PART_DIMENSION = 5      # fixture B keeps parts with p_size > 5
DIMENSION_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class BasketTables:
    orders: DataFrame
    order_products: DataFrame
    products: DataFrame
    aisles: DataFrame
    departments: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the cluster has cores.

    A file with one row group is read by one task, and everything up to the
    first exchange (joins with broadcast dimensions, partial aggregates)
    would run in that task. On large inputs the scan already has many
    splits and this is a no-op.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _vocabulary_ids(values: DataFrame, value_col: str, id_col: str) -> DataFrame:
    """1-based ids in ascending order of a distinct dimension vocabulary."""
    return values.where(F.col(value_col).isNotNull()).select(
        F.row_number().over(Window.orderBy(value_col)).cast("long").alias(id_col), value_col)


def fixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: order number and days since the prior order per customer."""
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("order_date"),
    )
    seq = running_aggregates(
        o, keys=["user_id"], order=["order_date", "order_id"],
        sums={"order_number": F.lit(1)},
        prior_max={"prior_date": F.col("order_date")},
    )
    return seq.select(
        "order_id", "user_id",
        F.lit(EVAL_SET).alias("eval_set"),
        F.col("order_number").cast("int").alias("order_number"),
        (F.dayofweek("order_date") - 1).cast("int").alias("order_dow"),
        F.datediff("order_date", "prior_date").cast("double").alias("days_since_prior_order"),
    )


def dimension_bound(spark: SparkSession, sf_dir: str, max_rows: int = DIMENSION_BROADCAST_ROWS) -> bool:
    """Every fixture dimension is derived from ``part`` and has at most as many
    rows, so one bounded count of the raw ``part`` scan proves all of them."""
    return row_count_within(read_table(spark, sf_dir, "part"), max_rows)


@dataclass(frozen=True)
class Bounds:
    """Which fixture dimensions are proven to fit a broadcast."""

    parts: bool
    products: bool
    labels: bool       # aisles and departments


def dimension_bounds(spark: SparkSession, sf_dir: str, grain: str = "name",
                     max_rows: int = DIMENSION_BROADCAST_ROWS) -> Bounds:
    """Each dimension by its own rows: many parts may share few names, brands and types."""
    if dimension_bound(spark, sf_dir, max_rows):
        return Bounds(True, True, True)
    part = read_table(spark, sf_dir, "part")

    def few(*cols: str) -> bool:
        return all(row_count_within(part.select(c).distinct(), max_rows) for c in cols)

    names = grain == "name" and few("p_name")
    return Bounds(False, names, names or (grain == "part" and few("p_brand", "p_type")))


def _product_maps(spark: SparkSession, sf_dir: str, grain: str, bounds: Bounds | None = None):
    """(part key -> product id, products, aisles, departments)."""
    part = read_table(spark, sf_dir, "part")
    small, labels = (bounds.products, bounds.labels) if bounds else (None, None)
    if grain == "name":
        names = part.groupBy("p_name").agg(F.min("p_partkey").alias("product_id"))
        names = names.select(
            "product_id", F.col("p_name").alias("product_name"),
            F.element_at(F.split("p_name", " "), 2).alias("aisle"),
            F.element_at(F.split("p_name", " "), 1).alias("department"),
        )
        part_map = part.select("p_partkey", "p_name").join(
            broadcast_if_within(names.select(F.col("product_name").alias("p_name"), "product_id"),
                                DIMENSION_BROADCAST_ROWS, small),
            "p_name").select("p_partkey", "product_id")
        attrs = names
    elif grain == "part":
        part_map = part.select("p_partkey", F.col("p_partkey").alias("product_id"))
        attrs = part.where(F.col("p_size") > MIN_SIZE_IN_PART_DIMENSION).select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("aisle"),
            F.col("p_type").alias("department"),
        )
    else:
        raise ValueError(f"unknown product grain {grain!r}")

    if grain == "name":
        vocab_src = attrs
    else:
        vocab_src = part.select(F.col("p_brand").alias("aisle"), F.col("p_type").alias("department"))
    aisles = _vocabulary_ids(vocab_src.select("aisle").distinct(), "aisle", "aisle_id")
    departments = _vocabulary_ids(vocab_src.select("department").distinct(),
                                  "department", "department_id")
    products = attrs.join(broadcast_if_within(aisles, DIMENSION_BROADCAST_ROWS, labels), "aisle", "left") \
        .join(broadcast_if_within(departments, DIMENSION_BROADCAST_ROWS, labels), "department", "left") \
        .select("product_id", "product_name", "aisle_id", "department_id")
    return part_map, products, aisles, departments


def fixture_order_products(lineitem: DataFrame, part_map: DataFrame, orders: DataFrame,
                           small: bool | None = None, hot_orders: int = HOT_KEY_ROWS) -> DataFrame:
    """One row per (order, product): cart position and the reorder flag.

    The part → product map has one row per part, so the bound proven on
    ``part`` lets it be broadcast; beyond it the join is a sort-merge join.
    The reorder flag compares each line with the pair's first order number.
    A pair has at most one line per order of its user, so where no user has
    more than ``hot_orders`` orders this is a plain window; otherwise it is an
    aggregate joined back, so a hot user × product pair is reduced map-side
    and split by AQE rather than sorted in one window task.
    """
    pm = broadcast_if_within(part_map, DIMENSION_BROADCAST_ROWS, small)
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber") \
        .join(pm, F.col("l_partkey") == F.col("p_partkey")) \
        .groupBy(F.col("l_orderkey").alias("order_id"), "product_id") \
        .agg(F.min("l_linenumber").alias("position"))
    lines = lines.withColumn("add_to_cart_order", F.row_number().over(
        Window.partitionBy("order_id").orderBy("position", "product_id")))
    seq = lines.join(orders.select("order_id", "user_id", "order_number"), "order_id")
    if orders.where(F.col("order_number") > hot_orders).isEmpty():
        numbered = seq.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull()).withColumn(
            "first_number", F.min("order_number").over(Window.partitionBy("user_id", "product_id")))
    else:
        first = seq.groupBy("user_id", "product_id").agg(F.min("order_number").alias("first_number"))
        numbered = seq.join(first, ["user_id", "product_id"])
    return numbered.select(
        "order_id", "product_id",
        F.col("add_to_cart_order").cast("int").alias("add_to_cart_order"),
        (F.col("order_number") > F.col("first_number")).cast("int").alias("reordered"),
    )


def basket_tables(spark: SparkSession, sf_dir: str, grain: str = "name",
                  bounds: Bounds | None = None,
                  store: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> BasketTables:
    """The five reference tables derived from the star schema at ``sf_dir``.

    ``bounds``: the dimension bounds, if already proven. ``store(label, build)``
    may write the orders and order lines once (``sources.storage``); without
    it they stay lazy.
    """
    keep = store or (lambda label, build: build())
    orders = keep("orders", lambda: fixture_orders(spark, sf_dir))
    part_map, products, aisles, departments = _product_maps(spark, sf_dir, grain, bounds)
    order_products = keep("order_products", lambda: fixture_order_products(
        spread(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")),
        part_map, orders, bounds.parts if bounds else None))
    return BasketTables(orders, order_products, products, aisles, departments)


def latent_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture C: ``(user_id, latent array<double>, label)`` from ``embeddings``."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user_id"),
        F.col("embedding").cast("array<double>").alias("latent"),
        F.col("label").cast("int").alias("label"),
    )


__all__ = ["BasketTables", "basket_tables", "fixture_orders", "fixture_order_products",
           "latent_fixture", "read_table"]
