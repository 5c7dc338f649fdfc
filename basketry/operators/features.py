"""User, product and user×product features, including the stickiness score.

Every feature is an aggregate over the order-line table at one grain:

* user: one two-level aggregate (lines → (user, order) → user); the order
  level gives the basket sizes, and the line-weighted means are carried as
  (sum, count) pairs so the second level needs no second pass.
* product: one aggregate.
* pair (user, product): one aggregate giving n, first and last order number;
  the telescoping sum of order gaps collapses to ``greatest(0, l - f - n)``
  so no window sort over (user, product) is needed.

All aggregates are partial before their shuffle, which reduces a hot user or
product to one row per map task.

Formulas (n = purchases of the pair, f / l = first / last order number,
T = the user's largest order number within the given lines)::

    spread        = greatest(0, l - f - n)
    Order_Range_D = T - f + 1
    sticky        = 0.5 * n / T + 0.5 * n / (Order_Range_D + spread)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_at_zero
from ..sources.schemas import PRODUCT_FEATURES, USER_FEATURES
from .joins import broadcast_if_within
from .merge import DIMENSION_ROWS
from .sequence import running_aggregates

# Fixed values of the feature step.
MIN_USER_ORDERS = 3
STICKY_WEIGHT = 0.5
WEEKDAY_NAMES = {0: "Sunday", 1: "Monday", 2: "Tuesday", 3: "Wednesday",
                 4: "Thursday", 5: "Friday", 6: "Saturday"}


# --------------------------------------------------------------------------
# user grain
# --------------------------------------------------------------------------

def order_sizes(lines: DataFrame) -> DataFrame:
    """Products per (user, order) — ``count(product_id)``."""
    return lines.groupBy("user_id", "order_id").agg(F.count("product_id").alias("size"))


def user_totals(lines: DataFrame) -> DataFrame:
    """All user-grain aggregates, before the minimum-orders filter.

    Means over *lines* (Q3): a large basket weighs more in the user's mean
    days and reorder ratio, as in the reference.
    """
    per_order = lines.groupBy("user_id", "order_id").agg(
        F.sum("days_since_prior_order").alias("days_sum"),
        F.count("days_since_prior_order").alias("days_n"),
        F.sum("reordered").alias("reordered_sum"),
        F.count("reordered").alias("reordered_n"),
        F.max("order_number").alias("max_order_number"),
        F.count("product_id").alias("size"),
    )
    return per_order.groupBy("user_id").agg(
        (F.sum("days_sum") / F.sum("days_n")).alias("avg_days_since_prior_order"),
        (F.sum("reordered_sum") / F.sum("reordered_n")).alias("u_reordered_ratio"),
        F.max("max_order_number").cast("int").alias("u_total_orders"),
        F.avg("size").alias("order_size_avg"),
    )


def user_features(lines: DataFrame, min_orders: int = MIN_USER_ORDERS) -> DataFrame:
    """The four user features for users with at least ``min_orders`` orders."""
    return user_totals(lines).where(F.col("u_total_orders") >= min_orders) \
        .select("user_id", *USER_FEATURES)


def user_avg_days(lines: DataFrame) -> DataFrame:
    """Mean days since the prior order over the user's lines (A3)."""
    return lines.groupBy("user_id").agg(
        F.avg("days_since_prior_order").alias("avg_days_since_prior_order"))


def user_total_orders(lines: DataFrame) -> DataFrame:
    """Largest order number per user (A4)."""
    return lines.groupBy("user_id").agg(F.max("order_number").cast("int").alias("u_total_orders"))


def users_min_orders(lines: DataFrame, min_orders: int = MIN_USER_ORDERS) -> DataFrame:
    """HAVING ``max(order_number) >= min_orders``."""
    return user_total_orders(lines).where(F.col("u_total_orders") >= min_orders)


def user_reorder_ratio(lines: DataFrame) -> DataFrame:
    """Mean reorder flag per user (A5)."""
    return lines.groupBy("user_id").agg(F.avg("reordered").alias("u_reordered_ratio"))


def order_size_avg(lines: DataFrame) -> DataFrame:
    """Mean basket size per user, a two-level aggregate."""
    return order_sizes(lines).groupBy("user_id").agg(F.avg("size").alias("order_size_avg"))


# --------------------------------------------------------------------------
# product grain
# --------------------------------------------------------------------------

def product_features(lines: DataFrame, key: str = "product_id") -> DataFrame:
    """Purchases, reorder ratio and mean cart position per product."""
    return lines.groupBy(key).agg(
        F.count("order_id").alias("p_total_purchases"),
        F.avg("reordered").alias("p_reorder_ratio"),
        F.avg("add_to_cart_order").alias("mean_add_to_cart_order"),
    )


def product_purchases(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id").agg(F.count("order_id").alias("p_total_purchases"))


def product_reorder_ratio(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id").agg(F.avg("reordered").alias("p_reorder_ratio"))


def product_cart_position(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id").agg(F.avg("add_to_cart_order").alias("mean_add_to_cart_order"))


def purchase_range(products: DataFrame, purchases: tuple[float, float],
                   reorder: tuple[float, float]) -> DataFrame:
    """Products inside an axis window of (purchases, reorder ratio) (F8)."""
    return products.where(
        F.col("p_total_purchases").between(purchases[0], purchases[1])
        & F.col("p_reorder_ratio").between(reorder[0], reorder[1]))


# --------------------------------------------------------------------------
# pair grain
# --------------------------------------------------------------------------

def pair_stats(lines: DataFrame) -> DataFrame:
    """n, first and last order number per (user, product)."""
    return lines.groupBy("user_id", "product_id").agg(
        F.count("order_id").alias("n"),
        F.min("order_number").alias("first_order_number"),
        F.max("order_number").alias("last_order_number"),
    )


def spread_expr(n="n", first="first_order_number", last="last_order_number"):
    """``sum(diff().fillna(0) - 1)`` clipped at 0, in closed form."""
    return clip_at_zero(F.col(last) - F.col(first) - F.col(n))


def pair_spread(lines: DataFrame) -> DataFrame:
    return pair_stats(lines).select("user_id", "product_id",
                                    spread_expr().cast("double").alias("spread"))


def order_gaps(lines: DataFrame) -> DataFrame:
    """Row form of the spread: ``order_number - lag(order_number)`` (NaN → 0) minus 1.

    Computed with the range-partitioned ``lag`` so a hot pair is split.
    """
    run = running_aggregates(lines, ["user_id", "product_id"], ["order_number", "order_id"],
                             prior_max={"__prev": F.col("order_number")})
    return run.select(
        *lines.columns,
        (F.coalesce(F.col("order_number") - F.col("__prev"), F.lit(0)) - F.lit(1))
        .cast("double").alias("order_diff"))


def user_last_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("user_id").agg(F.max("order_number").alias("total_orders"))


def order_span(lines: DataFrame) -> DataFrame:
    """total orders ⟖ first order per pair, and ``Order_Range_D``."""
    first = lines.groupBy("user_id", "product_id").agg(
        F.min("order_number").alias("first_order_number"))
    span = user_last_order(lines).join(first, "user_id", "right")
    return span.select("user_id", "total_orders", "product_id", "first_order_number",
                       (F.col("total_orders") - F.col("first_order_number") + 1).alias("Order_Range_D"))


def sticky_scores(lines: DataFrame) -> DataFrame:
    """``(user_id, product_id, n, sticky)`` from one pair aggregate and one user aggregate."""
    pairs = pair_stats(lines)
    total = user_last_order(lines)
    joined = pairs.join(total, "user_id", "inner")
    n = F.col("n")
    span = F.col("total_orders") - F.col("first_order_number") + F.lit(1)
    spread = spread_expr()
    w = F.lit(STICKY_WEIGHT)
    score = w * (n / F.col("total_orders")) + w * (n / (span + spread).cast("double"))
    return joined.select("user_id", "product_id", n.alias("n"), score.alias("sticky"))


def sticky(lines: DataFrame) -> DataFrame:
    """The stickiness score per (user, product) — the flagship feature."""
    return sticky_scores(lines).select("user_id", "product_id", "sticky")


def uxp_features(lines: DataFrame) -> DataFrame:
    """Times bought and sticky per pair."""
    return sticky_scores(lines).select("user_id", "product_id",
                                       F.col("n").alias("uxp_total_bought"), "sticky")


def pair_features(lines: DataFrame, min_orders: int = MIN_USER_ORDERS,
                  drop_small_users: bool = False) -> DataFrame:
    """pairs ⟕ user features ⟕ product features.

    The left join keeps pairs of users removed by the minimum-orders filter,
    with NULL user features (Q2), as the reference does; ``drop_small_users``
    drops these pairs instead.
    """
    pairs = uxp_features(lines)
    users = user_features(lines, min_orders)
    products = product_features(lines)
    return pairs.join(users, "user_id", "inner" if drop_small_users else "left") \
        .join(products, "product_id", "left") \
        .select("user_id", "product_id", "uxp_total_bought", "sticky",
                *USER_FEATURES, *PRODUCT_FEATURES)


def feature_table(lines: DataFrame, products: DataFrame, aisles: DataFrame,
                  departments: DataFrame, min_orders: int = MIN_USER_ORDERS,
                  small: bool | None = None, drop_small_users: bool = False,
                  small_labels: bool | None = None) -> DataFrame:
    """The long feature table: product id replaced by its name, aisle and department labels."""
    few = small or small_labels
    dim = products.join(F.broadcast(aisles) if few else aisles, "aisle_id", "left") \
        .join(F.broadcast(departments) if few else departments, "department_id", "left") \
        .select("product_id", "product_name", "aisle", "department")
    pf = pair_features(lines, min_orders, drop_small_users)
    return pf.join(broadcast_if_within(dim, DIMENSION_ROWS, small), "product_id", "left").select(
        "user_id", "product_name", "uxp_total_bought", "sticky",
        *USER_FEATURES, *PRODUCT_FEATURES, "aisle", "department")


def pair_modal_dow(lines: DataFrame) -> DataFrame:
    """Most frequent weekday per pair, ties to the smallest day.

    Counts per (user, product, day) are at most 7 rows per pair, so the
    arg-max is an aggregate: ``max(struct(count, -day))``.
    """
    counts = lines.groupBy("user_id", "product_id", "order_dow").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("user_id", "product_id").agg(
        F.max(F.struct(F.col("c"), (-F.col("order_dow")).alias("neg_dow"))).alias("m"))
    return best.select("user_id", "product_id", (-F.col("m.neg_dow")).cast("int").alias("order_dow"))


def weekday_names(df: DataFrame, col: str = "order_dow") -> DataFrame:
    """Replace the 0 = Sunday day number by its name; unmapped values become NULL."""
    mapping = F.create_map(*[x for k, v in WEEKDAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(col, F.try_element_at(mapping, F.col(col)))

