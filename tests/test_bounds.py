"""Dimension bounds by each dimension's own rows, and the plans and rows that follow from them."""

import re
import tempfile

from pyspark.sql import functions as F

from basketry.operators import matrix as mx
from basketry.operators import merge
from basketry.sources.basket import basket_tables, dimension_bounds, fixture_order_products


def _star(spark):
    """24 parts of 3 names, 2 brands and 2 types; 4 customers with 6 orders each."""
    d = tempfile.mkdtemp(prefix="star-")
    spark.range(24).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("red item"), (F.col("id") % 3).cast("string")).alias("p_name"),
        F.concat(F.lit("brand"), (F.col("id") % 2).cast("string")).alias("p_brand"),
        F.concat(F.lit("type"), (F.col("id") % 2).cast("string")).alias("p_type"),
        F.lit(9).alias("p_size")).write.parquet(f"{d}/part.parquet")
    spark.range(24).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") != 23, F.col("id") % 4).alias("o_custkey"),
        F.timestamp_seconds(F.col("id") * 86400).alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    spark.range(120).select(
        (F.col("id") % 24).alias("l_orderkey"), (F.col("id") * 7 % 25).alias("l_partkey"),
        (F.col("id") / 24).cast("int").alias("l_linenumber")).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_many_parts_of_few_names_leave_the_products_small(spark):
    d = _star(spark)
    by_name, by_part = (dimension_bounds(spark, d, grain, max_rows=10) for grain in ("name", "part"))
    assert (by_name.parts, by_name.products, by_name.labels) == (False, True, True)
    assert (by_part.parts, by_part.products, by_part.labels) == (False, False, True)
    none = dimension_bounds(spark, d, "part", max_rows=1)
    assert (none.parts, none.products, none.labels) == (False, False, False)
    tables = basket_tables(spark, d, "name", by_name)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge.merge_dimensions(merge.merge_products(tables.order_products, tables.products, by_name.products),
                                        tables.aisles, tables.departments, by_name.labels)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[(product|aisle|department)_id", plan)


def test_reorder_flags_with_and_without_hot_users(spark):
    d = _star(spark)
    orders = basket_tables(spark, d).orders.localCheckpoint()
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 3).alias("product_id"))
    plain, hot = (fixture_order_products(lines, parts, orders, True, hot_orders=n) for n in (6, 5))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hot.collect()))
    assert plain.where("reordered = 1").count() > 0 and plain.where("order_id = 23").count() == 0
    flags = plain._jdf.queryExecution().executedPlan().toString()
    assert "first_number" in flags and len(re.findall(r"SortMergeJoin \[user_id", flags)) == 0


def test_wide_matrix_shuffles_cells_not_wide_rows(spark):
    cells = spark.range(60).select((F.col("id") % 7).alias("user_id"), (F.col("id") / 7).cast("int").cast("string").alias(
        "product_name"), F.col("id").cast("double").alias("sticky")).localCheckpoint()
    wide = mx.sticky_matrix(cells)
    plan = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert wide.count() == 7 and {r["0"] for r in wide.collect()} == {0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0}
