"""Explicit schemas of the five basket tables and of the derived tables.

CSV sources are always read with these schemas (no inference): inference
costs a full extra pass and can pick different types per file.
"""

from pyspark.sql import types as T

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("eval_set", T.StringType(), True),
    T.StructField("order_number", T.IntegerType(), False),
    T.StructField("order_dow", T.IntegerType(), True),
    T.StructField("days_since_prior_order", T.DoubleType(), True),
])

ORDER_PRODUCTS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("add_to_cart_order", T.IntegerType(), True),
    T.StructField("reordered", T.IntegerType(), True),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("aisle_id", T.LongType(), True),
    T.StructField("department_id", T.LongType(), True),
])

AISLES = T.StructType([
    T.StructField("aisle_id", T.LongType(), False),
    T.StructField("aisle", T.StringType(), True),
])

DEPARTMENTS = T.StructType([
    T.StructField("department_id", T.LongType(), False),
    T.StructField("department", T.StringType(), True),
])

TABLE_SCHEMAS = {
    "orders": ORDERS,
    "order_products": ORDER_PRODUCTS,
    "products": PRODUCTS,
    "aisles": AISLES,
    "departments": DEPARTMENTS,
}

# Column order of the merged order-line table (orders, then lines, then the
# product, aisle and department attributes), as the merge produces it.
LINE_COLUMNS = [
    "order_id", "user_id", "eval_set", "order_number", "order_dow",
    "days_since_prior_order", "product_id", "add_to_cart_order", "reordered",
    "product_name", "aisle_id", "department_id", "aisle", "department",
]

USER_FEATURES = ["avg_days_since_prior_order", "u_reordered_ratio",
                 "u_total_orders", "order_size_avg"]
PRODUCT_FEATURES = ["p_total_purchases", "p_reorder_ratio", "mean_add_to_cart_order"]
