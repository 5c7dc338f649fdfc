"""Registered queries: one per operator of the coverage checklist.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables at ``sf_dir``; double columns are rounded to 6 decimals so that the
DuckDB oracle (``plans.oracle``) can be compared by value.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bk
from ..operators import bloom
from ..operators import embedding_map as em
from ..operators import features as feat
from ..operators import matrix as mx
from ..operators import merge
from ..operators import profiles as prof
from ..operators import quality as qual
from ..operators import selection as sel
from ..operators import kmeans as km
from ..operators import latent as lt
from ..operators import segments as seg
from ..operators import silhouette as sil
from ..operators import sketches as sk
from ..operators.autoencoder import DEC_TOLERANCE, DEC_MAX_STEPS, _flatten, dec_labels, dec_train, encode_fitted, \
    fit_autoencoder, fitted_weights, loss_and_gradient
from ..operators.sequence import row_numbers
from ..operators.sharded import weights_of
from ..functions import sql_functions
from ..session import scratch_path
from ..sources import files, npy
from ..sources.basket import read_table
from ..sources.schemas import USER_FEATURES
from ..sources.storage import materialize, remember, reuse_or_write
from .context import Basket, latent, latent_models, rounded

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return register


# ------------------------------------------------------------------ sources --

@query("basket_lines")
def _basket_lines(spark, sf_dir):
    """S-6: fixture adapter, the order-line table (order, product, cart position, reorder flag)."""
    return Basket(spark, sf_dir).tables.order_products


@query("basket_orders")
def _basket_orders(spark, sf_dir):
    """S-6: fixture adapter, orders with order number, weekday and days since the prior order."""
    return Basket(spark, sf_dir).tables.orders


@query("basket_products")
def _basket_products(spark, sf_dir):
    """S-6: fixture adapter, products, aisles and departments joined into one dimension."""
    return Basket(spark, sf_dir).dim


# -------------------------------------------------------------------- merge --

@query("orders_filled")
def _orders_filled(spark, sf_dir):
    """NULL days since the prior order become 0."""
    return merge.fill_nulls(Basket(spark, sf_dir).tables.orders)


@query("merge_lines")
def _merge_lines(spark, sf_dir):
    """Orders ⋈ order lines."""
    t = Basket(spark, sf_dir).tables
    return merge.merge_lines(merge.fill_nulls(t.orders), t.order_products)


@query("merge_products")
def _merge_products(spark, sf_dir):
    """⋈ products."""
    b = Basket(spark, sf_dir)
    t = b.tables
    return merge.merge_products(merge.merge_lines(merge.fill_nulls(t.orders), t.order_products),
                                t.products, b.small)


@query("merge_full")
def _merge_full(spark, sf_dir):
    """The merged order-line table."""
    return Basket(spark, sf_dir).data


# ---------------------------------------------------------------- selection --

@query("product_counts")
def _product_counts(spark, sf_dir):
    """Lines per product as (product_id, observation_count)."""
    return sel.product_counts(Basket(spark, sf_dir).data)


@query("cumulative_share")
def _cumulative_share(spark, sf_dir):
    """Running share of lines in descending count order."""
    b = Basket(spark, sf_dir)
    return sel.cumulative_share(sel.product_counts(b.data), bounded=b.small)


@query("observation_share")
def _observation_share(spark, sf_dir):
    """Each product's share of all lines."""
    b = Basket(spark, sf_dir)
    return sel.observation_share(sel.product_counts(b.data), bounded=b.small)


@query("pareto_cutoff")
def _pareto_cutoff(spark, sf_dir):
    """products within the 80 % running share."""
    b = Basket(spark, sf_dir)
    return sel.pareto_cutoff(sel.cumulative_share(sel.product_counts(b.data), bounded=b.small))


@query("pareto_target")
def _pareto_target(spark, sf_dir):
    """number of products within the 80 % running share."""
    b = Basket(spark, sf_dir)
    counts = sel.product_counts(b.data)
    return sel.pareto_target(sel.pareto_cutoff(sel.cumulative_share(counts, bounded=b.small)))


@query("top6_products")
def _top6_products(spark, sf_dir):
    """The six most bought products with their names."""
    b = Basket(spark, sf_dir)
    top = sel.top_products(sel.product_counts(b.data))
    return merge.counts_with_names(top, b.tables.products, b.small) \
        .select("product_id", "observation_count", "product_name", "aisle_id", "department_id")


@query("counts_with_names")
def _counts_with_names(spark, sf_dir):
    """Counts ⟕ products with the share of all lines."""
    b = Basket(spark, sf_dir)
    shares = sel.observation_share(sel.product_counts(b.data), bounded=b.small)
    return merge.counts_with_names(shares, b.tables.products, b.small)


@query("lines_in_head_products")
def _lines_in_head(spark, sf_dir):
    """lines of the products within the 80 % running share."""
    b = Basket(spark, sf_dir)
    cutoff = sel.pareto_cutoff(sel.cumulative_share(sel.product_counts(b.data), bounded=b.small))
    return sel.lines_in_products(b.data, cutoff, bounded=b.small)


@query("lines_in_head_products_bloom")
def _lines_in_head_bloom(spark, sf_dir):
    """F4 for a key set of any size: a Bloom filter where the lines are read, then the exact semi join."""
    b = Basket(spark, sf_dir)
    cutoff = sel.pareto_cutoff(sel.cumulative_share(sel.product_counts(b.data), bounded=b.small))
    return bloom.rows_with_keys(b.data, cutoff, "product_id")


@query("lines_without_top6")
def _lines_without_top6(spark, sf_dir):
    """lines of all but the six most bought products."""
    data = Basket(spark, sf_dir).data
    return sel.lines_without_products(data, sel.top_products(sel.product_counts(data)), bounded=True)


@query("pareto_lines")
def _pareto_lines(spark, sf_dir):
    """Pareto selection of order lines."""
    return Basket(spark, sf_dir).pareto


# ----------------------------------------------------------------- features --

@query("sticky")
def _sticky(spark, sf_dir):
    """Stickiness per (user, product) on the Pareto-selected lines (flagship)."""
    return feat.sticky(Basket(spark, sf_dir).pareto)


@query("user_features")
def _user_features(spark, sf_dir):
    """The four user features of users with at least 3 orders."""
    return feat.user_features(Basket(spark, sf_dir).pareto)


@query("product_features")
def _product_features(spark, sf_dir):
    """Purchases, reorder ratio and mean cart position per product."""
    return feat.product_features(Basket(spark, sf_dir).pareto)


@query("feature_table")
def _feature_table(spark, sf_dir):
    """The long feature table."""
    return Basket(spark, sf_dir).features



@query("uxp_features")
def _uxp_features(spark, sf_dir):
    """Times bought and sticky per pair."""
    return feat.uxp_features(Basket(spark, sf_dir).pareto)


@query("pair_features")
def _pair_features(spark, sf_dir):
    """Pairs ⟕ user features ⟕ product features (removed users keep NULL features)."""
    return feat.pair_features(Basket(spark, sf_dir).pareto)


@query("order_span")
def _order_span(spark, sf_dir):
    """Total orders ⟖ first order per pair, with Order_Range_D."""
    return feat.order_span(Basket(spark, sf_dir).pareto)


@query("user_avg_days")
def _user_avg_days(spark, sf_dir):
    """A3: mean days since the prior order over the user's lines."""
    return feat.user_avg_days(Basket(spark, sf_dir).pareto)


@query("user_total_orders")
def _user_total_orders(spark, sf_dir):
    """A4: largest order number per user."""
    return feat.user_total_orders(Basket(spark, sf_dir).pareto)


@query("users_min_orders")
def _users_min_orders(spark, sf_dir):
    """users with at least three orders."""
    return feat.users_min_orders(Basket(spark, sf_dir).pareto)


@query("user_reorder_ratio")
def _user_reorder_ratio(spark, sf_dir):
    """A5: mean reorder flag per user."""
    return feat.user_reorder_ratio(Basket(spark, sf_dir).pareto)


@query("order_size")
def _order_size(spark, sf_dir):
    """Products per (user, order)."""
    return feat.order_sizes(Basket(spark, sf_dir).pareto)


@query("order_size_avg")
def _order_size_avg(spark, sf_dir):
    """Mean basket size per user."""
    return feat.order_size_avg(Basket(spark, sf_dir).pareto)


@query("product_purchases")
def _product_purchases(spark, sf_dir):
    """Purchases per product."""
    return feat.product_purchases(Basket(spark, sf_dir).pareto)


@query("product_reorder_ratio")
def _product_reorder_ratio(spark, sf_dir):
    """Mean reorder flag per product."""
    return feat.product_reorder_ratio(Basket(spark, sf_dir).pareto)


@query("product_cart_position")
def _product_cart_position(spark, sf_dir):
    """A10: mean cart position per product."""
    return feat.product_cart_position(Basket(spark, sf_dir).pareto)


@query("purchase_range")
def _purchase_range(spark, sf_dir):
    """F8: products with 0–1000 purchases and a reorder ratio in [0, 1]."""
    return feat.purchase_range(feat.product_features(Basket(spark, sf_dir).pareto), (0, 1000), (0.0, 1.0))


#: the axis windows that the study looks at: (purchases, reorder ratio)
AXIS_WINDOWS = (((0, 10_000), (0.75, 1.0)), ((0, 1000), (0.75, 1.0)), ((0, 250), (0.75, 1.0)), ((0, 10_000), (0.0, 1.0)))


@query("axis_windows")
def _axis_windows(spark, sf_dir):
    """F8: the products inside each of the study's axis windows."""
    products = feat.product_features(Basket(spark, sf_dir).pareto)
    out = None
    for k, (purchases, reorder) in enumerate(AXIS_WINDOWS, 1):
        part = feat.purchase_range(products, purchases, reorder).withColumn("axis_window", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@query("feature_table_large_users")
def _feature_table_large_users(spark, sf_dir):
    """J11 with the minimum-orders filter in force (Q2): pairs of smaller users are dropped."""
    b = Basket(spark, sf_dir)
    t = b.tables
    return feat.feature_table(b.pareto, t.products, t.aisles, t.departments, small=b.small, drop_small_users=True,
                              small_labels=b.bounds.labels)


@query("sample_users_exact")
def _sample_users_exact(spark, sf_dir):
    """R1 with an exact count: the quarter of the users with the smallest hashes."""
    return sel.sample_users(Basket(spark, sf_dir).features, exact=True)


@query("pair_times_bought")
def _pair_times_bought(spark, sf_dir):
    """Purchases per (user, product)."""
    return feat.pair_stats(Basket(spark, sf_dir).pareto).select(
        "user_id", "product_id", F.col("n").alias("uxp_total_bought"))


@query("pair_first_order")
def _pair_first_order(spark, sf_dir):
    """First order number per (user, product)."""
    return feat.pair_stats(Basket(spark, sf_dir).pareto).select(
        "user_id", "product_id", "first_order_number")


@query("pair_spread")
def _pair_spread(spark, sf_dir):
    """Clipped sum of order gaps per (user, product), closed form."""
    return feat.pair_spread(Basket(spark, sf_dir).pareto)


@query("order_gaps")
def _order_gaps(spark, sf_dir):
    """Per-line order gap minus one (first purchase: -1)."""
    return feat.order_gaps(Basket(spark, sf_dir).pareto).select(
        "user_id", "product_id", "order_id", "order_number", "order_diff")


@query("pair_modal_dow")
def _pair_modal_dow(spark, sf_dir):
    """Most frequent weekday per pair, ties to the smallest day."""
    return feat.pair_modal_dow(Basket(spark, sf_dir).pareto)


@query("weekday_names")
def _weekday_names(spark, sf_dir):
    """Weekday number (0 = Sunday) mapped to its name."""
    return feat.weekday_names(merge.fill_nulls(Basket(spark, sf_dir).tables.orders)) \
        .select("order_id", "user_id", "order_number", "order_dow")


# ------------------------------------------------------------- projections --

@query("select_features")
def _select_features(spark, sf_dir):
    """The columns the matrix step keeps."""
    return mx.select_by_name(Basket(spark, sf_dir).features,
                             ["user_id", "product_name", "sticky", "avg_days_since_prior_order",
                              "u_reordered_ratio", "u_total_orders", "order_size_avg"])


@query("select_tail_columns")
def _select_tail_columns(spark, sf_dir):
    """Positional selection ``iloc[:, 5:]`` of the merged line table."""
    return mx.select_from_position(Basket(spark, sf_dir).data, 5)


@query("drop_columns")
def _drop_columns(spark, sf_dir):
    """The merged table without the aisle and department ids."""
    return mx.drop_columns(Basket(spark, sf_dir).data, ["aisle_id", "department_id"])


@query("rename_columns")
def _rename_columns(spark, sf_dir):
    """Per-pair gap sum renamed to ``spread`` (before clipping)."""
    gaps = feat.order_gaps(Basket(spark, sf_dir).pareto)
    summed = gaps.groupBy("user_id", "product_id").agg(F.sum("order_diff").alias("order_diff"))
    return mx.rename_columns(summed, {"order_diff": "spread"})


@query("derive_columns")
def _derive_columns(spark, sf_dir):
    """P5: the reference's sticky frame with its derived helper columns."""
    lines = Basket(spark, sf_dir).pareto
    frame = feat.pair_stats(lines).join(feat.user_last_order(lines), "user_id", "inner")
    n, total = F.col("n"), F.col("total_orders")
    range_d = total - F.col("first_order_number") + F.lit(1)
    spread = feat.spread_expr()
    return frame.select(
        "user_id", "product_id", n.alias("Times_Bought_N"), "total_orders", "first_order_number",
        range_d.alias("Order_Range_D"), spread.cast("double").alias("spread"),
        (F.lit(0.5) * (n / total) + F.lit(0.5) * (n / (range_d + spread).cast("double"))).alias("sticky"))


@query("category_codes")
def _category_codes(spark, sf_dir):
    """0-based codes of product, aisle and department names (sorted order)."""
    b = Basket(spark, sf_dir)
    dim = b.dim.select("product_id", "product_name", "aisle", "department")
    for c in ["product_name", "aisle", "department"]:
        dim = merge.category_codes(dim, c, f"{c}_code", b.small)
    return dim


@query("product_id_to_name")
def _product_id_to_name(spark, sf_dir):
    """Pair features with the product id replaced by the product name."""
    b = Basket(spark, sf_dir)
    return merge.product_id_to_name(feat.uxp_features(b.pareto), b.tables.products, b.small)


# ------------------------------------------------------------ dimensions --

@query("product_dim")
def _product_dim(spark, sf_dir):
    """Products ⟕ aisles ⟕ departments, part-key grain (incomplete dimension)."""
    return Basket(spark, sf_dir, grain="part").dim


@query("product_lookup_unknown")
def _product_lookup_unknown(spark, sf_dir):
    """Name → aisle / department with 'Unknown' default; duplicated names: largest id wins."""
    b = Basket(spark, sf_dir, grain="part")
    part = read_table(spark, sf_dir, "part")
    names = b.tables.order_products.select("product_id").distinct().join(
        part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")),
        "product_id").select("product_name").distinct()
    known = b.dim.where(F.length("product_name") % 2 == 0)  # some names are absent from the dimension
    return merge.lookup_with_default(names, known, "product_name", b.small)


@query("duplicate_keys")
def _duplicate_keys(spark, sf_dir):
    """(user, product name) keys with several products, part-key grain."""
    pairs = Basket(spark, sf_dir, grain="part").data.select("user_id", "product_name", "product_id")
    return mx.duplicate_keys(pairs)


# ------------------------------------------------------------------ matrix --

@query("sample_users")
def _sample_users(spark, sf_dir):
    """A 25 % user sample (hash threshold, seed 16)."""
    return sel.sample_users(Basket(spark, sf_dir).features)


@query("sample_user_rows")
def _sample_user_rows(spark, sf_dir):
    """All feature rows of the sampled users."""
    return sel.sample_user_rows(Basket(spark, sf_dir).features)


@query("distinct_users")
def _distinct_users(spark, sf_dir):
    """R2: distinct users of the selected lines."""
    return sel.distinct_values(Basket(spark, sf_dir).pareto, "user_id")


@query("user_constants")
def _user_constants(spark, sf_dir):
    """One row of user features per user."""
    return Basket(spark, sf_dir).user_rows


@query("sticky_matrix")
def _sticky_matrix(spark, sf_dir):
    """The wide user × product-name pivot, absent = 0, shown as one row per cell."""
    return mx.melt(mx.sticky_matrix(Basket(spark, sf_dir).features), ["user_id"])


@query("user_matrix")
def _user_matrix(spark, sf_dir):
    """User features ⋈ wide matrix, shown as one row per cell."""
    f = Basket(spark, sf_dir).features
    wide = mx.user_matrix(f, mx.sticky_matrix(f))
    return mx.melt(wide, ["user_id", *USER_FEATURES])


@query("user_vectors")
def _user_vectors(spark, sf_dir):
    """One sparse vector per user (index = rank of the product name), its cells in order."""
    return Basket(spark, sf_dir).vectors.select("user_id", F.posexplode(F.arrays_zip("indices", "values")).alias("k", "c")) \
        .select("user_id", "k", F.col("c.indices").alias("idx"), F.col("c.values").alias("value"))


@query("holdout_split")
def _holdout_split(spark, sf_dir):
    """80 / 20 train-validation assignment per user."""
    return mx.holdout_split(Basket(spark, sf_dir).user_rows.select("user_id"))


@query("minibatch_id")
def _minibatch_id(spark, sf_dir):
    """Mini-batch bucket per user, ceil(users / 256) buckets."""
    users = Basket(spark, sf_dir).user_rows.select("user_id")
    return mx.minibatch_ids(users, mx.batch_count(users.count()))


# ----------------------------------------------------------------- quality --

@query("profile_info")
def _profile_info(spark, sf_dir):
    """info() of the feature table."""
    return qual.profile_info(Basket(spark, sf_dir).features)


@query("profile_describe")
def _profile_describe(spark, sf_dir):
    """describe() of the numeric feature columns, exact quartiles."""
    return qual.profile_describe(Basket(spark, sf_dir).features)


SKETCHED = ("order_number", "order_dow", "days_since_prior_order", "add_to_cart_order", "user_id", "product_id")


@query("profile_sketch")
def _profile_sketch(spark, sf_dir):
    """D2, A15 from stored sketches: one row per weekday and column, merged to the whole line table.

    Counts, mean, least and greatest value are exact; the distinct count and the
    quartiles are checked against the lines and told as within their stated errors or not.
    """
    b = Basket(spark, sf_dir)
    stored = b._stage("line_sketches", lambda: sk.sketch_rows(b.data.withColumn("weekday", F.col("order_dow")),
                                                              SKETCHED, ["weekday"]))
    whole = sk.profile(sk.merge_sketches(stored))
    told = {r["column"]: r for r in whole.collect()}  # a row per column
    checks = []
    for c in told:
        ranks = [(F.sum((F.col(c) < told[c][f"q{int(q * 100)}"]).cast("long")),
                  F.sum((F.col(c) <= told[c][f"q{int(q * 100)}"]).cast("long")), q) for q in sk.QUANTILES]
        n = F.count(c)
        near = F.lit(True)
        for under, upto, q in ranks:
            near = near & (under <= (q + sk.RANK_ERROR) * n) & (upto >= (q - sk.RANK_ERROR) * n)
        exact = F.count_distinct(c)
        checks.append(F.struct(F.lit(c).alias("column"),
                               (F.abs(exact - told[c]["distinct"]) <= sk.DISTINCT_ERROR * exact).alias("distinct_within"),
                               near.alias("quartiles_within")))
    found = b.data.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))
    return whole.select("column", "n_rows", "n_values", "mean", "min", "max").join(found, "column")


@query("describe_strings")
def _describe_strings(spark, sf_dir):
    """describe() of the string feature columns."""
    return qual.describe_strings(Basket(spark, sf_dir).features)


@query("distinct_counts")
def _distinct_counts(spark, sf_dir):
    """nunique() of every feature column."""
    return qual.distinct_counts(Basket(spark, sf_dir).features)


@query("product_check")
def _product_check(spark, sf_dir):
    """Purchases joined with reorder ratio, described."""
    lines = Basket(spark, sf_dir).pareto
    check = feat.product_purchases(lines).join(feat.product_reorder_ratio(lines), "product_id")
    return qual.profile_describe(check)


@query("sorted_lines")
def _sorted_lines(spark, sf_dir):
    """Selected lines sorted by user, product and order number."""
    return qual.sorted_rows(Basket(spark, sf_dir).pareto, ["user_id", "product_id", "order_number"])


@query("row_slice")
def _row_slice(spark, sf_dir):
    """Rows 6–17 of the selected lines in (order, cart position) order, six columns."""
    return qual.row_slice(Basket(spark, sf_dir).pareto, ["order_id", "add_to_cart_order"], 6, 18,
                          ["order_id", "user_id", "add_to_cart_order", "reordered", "product_name",
                           "department"])


@query("format_metrics")
def _format_metrics(spark, sf_dir):
    """Product metrics printed with 10 and 5 decimals."""
    pf = feat.product_features(Basket(spark, sf_dir).pareto)
    return qual.format_metrics(pf, {"p_reorder_ratio": 10, "mean_add_to_cart_order": 5})


# ---------------------------------------------------------------- profiles --

@query("labelled_users")
def _labelled_users(spark, sf_dir):
    """User features with the segment label attached by key."""
    b = Basket(spark, sf_dir)
    return prof.attach_labels(b.user_rows, b.labels)


@query("cluster_sizes")
def _cluster_sizes(spark, sf_dir):
    """Users per segment."""
    return prof.cluster_sizes(Basket(spark, sf_dir).labels)


@query("segment_rows")
def _segment_rows(spark, sf_dir):
    """matrix rows of segment 1."""
    b = Basket(spark, sf_dir)
    return prof.segment_rows(prof.attach_labels(b.matrix, b.labels), 1)


@query("segment_bases")
def _segment_bases(spark, sf_dir):
    """Mean user features per segment, transposed."""
    b = Basket(spark, sf_dir)
    return prof.segment_bases(b.user_rows, b.labels)


def _level_values(b: Basket, level: str):
    if level == "product_name":
        return b.matrix
    return prof.roll_up(b.matrix, b.dim, level, small=b.small)


@query("segment_product_means")
def _segment_product_means(spark, sf_dir):
    """Mean sticky per segment and product, absent = 0 (present cells listed)."""
    b = Basket(spark, sf_dir)
    return prof.segment_means(b.matrix, b.labels, "product_name")


@query("user_aisle_matrix")
def _user_aisle_matrix(spark, sf_dir):
    """Sticky summed per user and aisle."""
    b = Basket(spark, sf_dir)
    return prof.roll_up(b.matrix, b.dim, "aisle", small=b.small)


@query("user_department_matrix")
def _user_department_matrix(spark, sf_dir):
    """Sticky summed per user and department."""
    b = Basket(spark, sf_dir)
    return prof.roll_up(b.matrix, b.dim, "department", small=b.small)


@query("segment_aisle_means")
def _segment_aisle_means(spark, sf_dir):
    """Mean aisle roll-up per segment."""
    b = Basket(spark, sf_dir)
    return prof.segment_means(_level_values(b, "aisle"), b.labels, "aisle")


@query("segment_department_means")
def _segment_department_means(spark, sf_dir):
    """Mean department roll-up per segment."""
    b = Basket(spark, sf_dir)
    return prof.segment_means(_level_values(b, "department"), b.labels, "department")


@query("aisle_product_counts")
def _aisle_product_counts(spark, sf_dir):
    """Products per aisle among the matrix columns, top 5."""
    b = Basket(spark, sf_dir)
    return prof.item_counts(b.matrix, b.dim, "aisle", small=b.small)


@query("department_product_counts")
def _department_product_counts(spark, sf_dir):
    """Products per department among the matrix columns, top 5."""
    b = Basket(spark, sf_dir)
    return prof.item_counts(b.matrix, b.dim, "department", small=b.small)


def _ranked(spark, sf_dir, level: str, top: int, bottom: int):
    b = Basket(spark, sf_dir)
    values = _level_values(b, level)
    means = prof.segment_means(values, b.labels, level)
    out = prof.ranked_items(means, values.select(level), level, top, bottom, bounded=b.small, segments=b.labels)
    return out.withColumnRenamed(level, "item")


for _level, _name in [("product_name", "products"), ("aisle", "aisles"), ("department", "departments")]:
    def _top10(spark, sf_dir, level=_level):
        return _ranked(spark, sf_dir, level, prof.TOP_N, 0).drop("end")
    _top10.__doc__ = f"T4: top 10 {_name} per segment by mean, absent = 0."
    query(f"segment_top10_{_name}")(_top10)

    def _extremes(spark, sf_dir, level=_level):
        return _ranked(spark, sf_dir, level, prof.EXTREME_N, prof.EXTREME_N)
    _extremes.__doc__ = f"T5: top 5 and bottom 5 {_name} per segment, absent = 0."
    query(f"segment_extremes_{_name}")(_extremes)


# ------------------------------------------------------------ sources/sinks --

@query("scan_csv")
def _scan_csv(spark, sf_dir):
    """S-1: orders written as CSV, with an extra column and in another column order, read by header name."""
    orders = Basket(spark, sf_dir).tables.orders
    path = scratch_path(spark, "orders_csv")
    files.write_csv(orders.select(*reversed(orders.columns)).select(
        "user_id", F.lit(8).alias("order_hour_of_day"), *[c for c in reversed(orders.columns) if c != "user_id"]), path)
    return files.read_csv(spark, path, "orders")


@query("scan_csv_names")
def _scan_csv_names(spark, sf_dir):
    """S-1: products whose names hold quotes, commas and a line break, written as CSV and read back."""
    products = Basket(spark, sf_dir).tables.products
    name = F.concat(F.lit('"Big" '), F.col("product_name"), F.lit(', dark\n"x"'))
    path = scratch_path(spark, "products_csv")
    files.write_csv(products.withColumn("product_name", name).withColumn("extra", F.lit("a,b")), path)
    return files.read_csv(spark, path, "products", multiline=True)


@query("write_csv")
def _write_csv(spark, sf_dir):
    """S-2: the feature table written as CSV and read back."""
    features = Basket(spark, sf_dir).features
    path = scratch_path(spark, "features_csv")
    files.write_csv(features, path)
    return files.read_csv(spark, path, features.schema)


@query("write_latent")
def _write_latent(spark, sf_dir):
    """S-3: latent matrices of two models written partitioned by model; rows per model."""
    path = scratch_path(spark, "latent")
    files.write_latent(latent_models(spark, sf_dir), path)
    back = files.scan_latent(spark, path)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("users"),
                                     F.sum(F.size("latent")).alias("values"))


@query("scan_latent")
def _scan_latent(spark, sf_dir):
    """S-4: all models read back at once, one row per latent value."""
    path = scratch_path(spark, "latent")
    files.write_latent(latent_models(spark, sf_dir), path)
    return lt.latent_values(files.scan_latent(spark, path))


@query("scan_npy")
def _scan_npy(spark, sf_dir):
    """S-3, S-4: two models' latent matrices written as NumPy files and read back by the data source, one row per value."""
    folder = scratch_path(spark, "npy").removeprefix("file://")  # NumPy's files need a path that the file system knows
    os.makedirs(folder)
    models = materialize(latent_models(spark, sf_dir), "npy_models")
    for name in ("embedding", "embedding_sigmoid"):
        npy.write_npy(models.where(F.col("model") == name), f"{folder}/{name}.npy")
    ids = row_numbers(latent(spark, sf_dir).select("user_id"), [], ["user_id"], "rn") \
        .select("user_id", (F.col("rn") - 1).cast("long").alias("row"))
    return lt.latent_values(npy.read_npy(spark, folder).join(ids, "row"))


@query("sql_sticky")
def _sql_sticky(spark, sf_dir):
    """U1, A14 from SQL text: stickiness by the registered SQL function."""
    sql_functions.register(spark)
    return spark.sql("""
        SELECT p.user_id, p.product_id, stickiness(p.n, t.total, p.first_order, p.last_order) AS sticky
        FROM (SELECT user_id, product_id, count(order_id) AS n, min(order_number) AS first_order,
                     max(order_number) AS last_order FROM {lines} GROUP BY user_id, product_id) p
        JOIN (SELECT user_id, max(order_number) AS total FROM {lines} GROUP BY user_id) t ON t.user_id = p.user_id""",
        lines=Basket(spark, sf_dir).pareto)


@query("sql_target_distribution")
def _sql_target_distribution(spark, sf_dir):
    """U3, U4 from SQL text: soft assignment to the label-0/1/2 centroids and the target distribution."""
    sql_functions.register(spark)
    points = latent(spark, sf_dir)
    given = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in _fixture_centroids(points)))
    q = spark.sql("SELECT user_id, soft_assignment(latent, :centroids) AS q FROM {points}", {"centroids": given},
                  points=points)
    totals = spark.sql("SELECT sum(q[0]) AS a, sum(q[1]) AS b, sum(q[2]) AS c FROM {q}", q=q).first()
    return spark.sql("""
        SELECT user_id, cluster, q[cluster] AS q, p
        FROM (SELECT user_id, q, target_distribution(q, :totals) AS ps FROM {q})
        LATERAL VIEW posexplode(ps) AS cluster, p""", {"totals": F.array(*(F.lit(t) for t in totals))}, q=q)


@query("weights_roundtrip")
def _weights_roundtrip(spark, sf_dir):
    """S-5: a model's weights and centroids written as Parquet and read back, one row per weight."""
    d = Basket(spark, sf_dir).width
    points = latent(spark, sf_dir)
    path = scratch_path(spark, "weights")
    files.write_weights(lt.weight_table(spark, lt.fixture_layers(d), _fixture_centroids(points)), path)
    return files.read_weights(spark, path).select(
        "layer", "kind", "row", F.posexplode("values").alias("col", "value"))


@query("score_saved_model")
def _score_saved_model(spark, sf_dir):
    """S-5, C10, C3, C4, C6: a saved encoder and its centroids, loaded, score every user: q, p and label."""
    b = Basket(spark, sf_dir)
    layers = lt.fixture_layers(b.width)
    z = lt.encode(b.vectors, layers, b.width)
    centroids = seg.label_centroids(z.join(b.labels, "user_id"), [0, 1, 2], "cluster")
    path = scratch_path(spark, "model")
    files.write_weights(lt.weight_table(spark, layers, centroids), path)
    loaded, mu = lt.layers_from_table(files.read_weights(spark, path))
    scored = seg.target_distribution(seg.soft_assignment(lt.encode(b.vectors, loaded, b.width), mu), len(mu))
    label = seg.hard_labels(scored).select("user_id", F.col("cluster").alias("label"))
    return seg.long_assignments(scored).join(label, "user_id")


# ------------------------------------------------------------------ latent --

@query("latent_histogram")
def _latent_histogram(spark, sf_dir):
    """100-bin histogram of all latent values per model."""
    return lt.histogram(lt.latent_values(latent_models(spark, sf_dir)), lt.LATENT_BINS)


@query("mean_activations")
def _mean_activations(spark, sf_dir):
    """Mean of each latent dimension per model."""
    return lt.mean_activations(lt.latent_values(latent_models(spark, sf_dir)))


@query("activation_histogram")
def _activation_histogram(spark, sf_dir):
    """50-bin histogram of the mean activations per model."""
    return lt.activation_histogram(lt.latent_values(latent_models(spark, sf_dir)))


@query("latent_sparsity")
def _latent_sparsity(spark, sf_dir):
    """Percent of values below 5 % of the model's maximum in magnitude."""
    return lt.latent_sparsity(lt.latent_values(latent_models(spark, sf_dir)))


@query("latent_variance")
def _latent_variance(spark, sf_dir):
    """Population variance of all latent values per model."""
    return lt.latent_variance(lt.latent_values(latent_models(spark, sf_dir)))


def _fixture_centroids(points):
    return seg.label_centroids(points, [0, 1, 2])


def _scored(spark, sf_dir):
    points = latent(spark, sf_dir)
    return seg.target_distribution(seg.soft_assignment(points, _fixture_centroids(points)), 3)


@query("soft_assignment")
def _soft_assignment(spark, sf_dir):
    """Student-t soft assignment to the label-0/1/2 centroids."""
    points = latent(spark, sf_dir)
    return seg.long_assignments(seg.soft_assignment(points, _fixture_centroids(points)), ("q",))


@query("target_distribution")
def _target_distribution(spark, sf_dir):
    """C4: soft assignment and the sharpened target distribution."""
    return seg.long_assignments(_scored(spark, sf_dir))


@query("kl_loss")
def _kl_loss(spark, sf_dir):
    """Mean KL(P || Q) with Keras clipping."""
    return seg.kl_loss(_scored(spark, sf_dir))


@query("hard_labels")
def _hard_labels(spark, sf_dir):
    """Arg-max cluster per user, lowest index on ties."""
    return seg.hard_labels(_scored(spark, sf_dir)).select("user_id", "cluster")


@query("mean_assignment")
def _mean_assignment(spark, sf_dir):
    """Mean q and p per cluster."""
    return seg.mean_assignment(_scored(spark, sf_dir))


@query("label_churn")
def _label_churn(spark, sf_dir):
    """Share of users whose label moves when centroid 2 becomes the label-3 mean."""
    points = latent(spark, sf_dir)
    before = seg.label_centroids(points, [0, 1, 2])
    after = seg.label_centroids(points, [0, 1, 3])
    lb = seg.hard_labels(seg.soft_assignment(points, before)).select("user_id", "cluster")
    la = seg.hard_labels(seg.soft_assignment(points, after)).select("user_id", "cluster")
    return seg.label_churn(lb, la)


@query("dec_step")
def _dec_step(spark, sf_dir):
    """C8 (two steps): centroid gradients over all users and the updates with momentum, scaled to show.

    ``gradient`` and ``gradient2`` are times 1e6, ``update2`` (the second
    velocity over the learning rate) too; ``moved`` is the way from the first
    to the last centroid times 1e6.
    """
    points = latent(spark, sf_dir)
    cents = _fixture_centroids(points)
    scored = seg.target_distribution(seg.soft_assignment(points, cents), 3)
    grad = seg.centroid_gradient(scored, cents)
    one, velocity = seg.dec_step(scored, cents)
    two, velocity2 = seg.dec_step(scored, one, velocity)
    rows = [(j, i, 1e6 * float(grad[j, i]), 1e6 * float(velocity2[j, i] / seg.LEARNING_RATE),
             1e6 * float(two[j, i] - cents[j, i])) for j in range(cents.shape[0]) for i in range(cents.shape[1])]
    return spark.createDataFrame(rows, "cluster int, dim int, gradient double, update2 double, moved double")


@query("dec_refine")
def _dec_refine(spark, sf_dir):
    """C8 (loop): DEC refinement from k-means centroids to its stop rule, labels per user."""
    points = latent(spark, sf_dir).select("user_id", "latent")
    _, cents = seg.kmeans_segments(points, seg.N_CLUSTERS, n_init=seg.N_INIT)
    _, labels, _ = seg.dec_refine(points, cents)
    return labels


@query("dec_one_stage")
def _dec_one_stage(spark, sf_dir):
    """C8 in one barrier stage: its labels against those of the loop of jobs, and its stop rule.

    ``users_apart``: users whose labels differ between the two; ``stopped_by_rule``:
    the churn fell below its bound, or the steps ran out.
    """
    points = latent(spark, sf_dir).select("user_id", "latent")
    _, cents = seg.kmeans_segments(points, seg.N_CLUSTERS, n_init=seg.N_INIT)
    _, labels, history = seg.dec_refine(points, cents, barrier=True)
    _, loop, _ = seg.dec_refine(points, cents)
    step, churn = history[-1] if history else (0, 1.0)
    stopped = churn < DEC_TOLERANCE or step >= DEC_MAX_STEPS
    return (labels.join(loop.withColumnRenamed("cluster", "other"), "user_id", "full")
            .agg(F.count("*").alias("users"),
                 F.coalesce(F.sum((~F.col("cluster").eqNullSafe(F.col("other"))).cast("long")), F.lit(0)).alias("users_apart"),
                 F.lit(stopped).alias("stopped_by_rule")))


@query("silhouette_sq")
def _silhouette_sq(spark, sf_dir):
    """Squared-Euclidean silhouette of the latent vectors by their label."""
    points = latent(spark, sf_dir)
    labels = points.select("user_id", F.col("label").alias("cluster"))
    return seg.silhouette_of_vectors(points, labels)


@query("silhouette_sq_basket")
def _silhouette_sq_basket(spark, sf_dir):
    """C14 (re-aimed, linear): squared-Euclidean silhouette of the sparse basket vectors."""
    b = Basket(spark, sf_dir)
    return seg.silhouette_from_triples(b.triples, b.labels)


@query("silhouette_euclidean")
def _silhouette_euclidean(spark, sf_dir):
    """C14: Euclidean silhouette of the latent vectors by their label, with its standard error (0 where exact)."""
    points = latent(spark, sf_dir)
    return sil.silhouette_euclidean(points, points.select("user_id", F.col("label").alias("cluster"))) \
        .select("silhouette", "users")


@query("silhouette_euclidean_basket")
def _silhouette_euclidean_basket(spark, sf_dir):
    """C14: Euclidean silhouette of the sparse basket vectors by segment, with its standard error."""
    b = Basket(spark, sf_dir)
    return sil.silhouette_euclidean(b.vectors, b.labels, d=b.width)


@query("elbow")
def _elbow(spark, sf_dir):
    """Within-cluster sum of squares for k = 1 … 14, 10 restarts each."""
    return seg.elbow(latent(spark, sf_dir))


@query("elbow_k1")
def _elbow_k1(spark, sf_dir):
    """C1, k = 1: total within-cluster sum of squares around the global mean."""
    return seg.inertia_k1(latent(spark, sf_dir))


@query("kmeans_segments")
def _kmeans_segments(spark, sf_dir):
    """K-means with 3 clusters, best of 10 restarts; labels per user."""
    labels, _ = seg.kmeans_segments(latent(spark, sf_dir))
    return labels


@query("latent_map_2d")
def _latent_map_2d(spark, sf_dir):
    """C15 (re-aimed from t-SNE): 2-D PCA map of the latent vectors with the label."""
    points = latent(spark, sf_dir)
    return seg.latent_map_2d(points, points.select("user_id", F.col("label").alias("cluster")))


@query("neighbour_affinities")
def _neighbour_affinities(spark, sf_dir):
    """The map's affinities ``p_{j|i} + p_{i|j}`` over the 90 nearest neighbours at perplexity 30."""
    return em.affinities(em.neighbours(latent(spark, sf_dir), int(em.NEIGHBOURS * em.PERPLEXITY)))


@query("latent_map_tsne")
def _latent_map_tsne(spark, sf_dir):
    """Non-linear 2-D map (t-SNE, perplexity 30, 1,000 steps) of all latent vectors, with the label."""
    points = latent(spark, sf_dir)
    return em.map_2d(points).join(points.select("user_id", F.col("label").alias("cluster")), "user_id")


@query("encode_latent")
def _encode_latent(spark, sf_dir):
    """Fixed-weight encoder (d -> 8 -> 4, sigmoid) applied to every user vector."""
    b = Basket(spark, sf_dir)
    z = lt.encode(b.vectors, lt.fixture_layers(b.width), b.width)
    return z.select("user_id", F.posexplode("latent").alias("dim", "value"))


@query("reconstruction_error")
def _reconstruction_error(spark, sf_dir):
    """C11: mean reconstruction error of the fixed-weight autoencoder, train and validation."""
    b = Basket(spark, sf_dir)
    errs = lt.reconstruction_errors(b.vectors, lt.fixture_layers(b.width), b.width)
    return mx.holdout_split(errs).groupBy("split").agg(
        F.avg("mse").alias("mse"), F.count(F.lit(1)).alias("users"))


@query("lloyd_step")
def _lloyd_step(spark, sf_dir):
    """C2 (one step): users at their nearest label-0/1/2 centroid, and the means of these groups."""
    points = latent(spark, sf_dir)
    cents = _fixture_centroids(points)
    nearest = seg.hard_labels(seg.soft_assignment(points, cents)).select("user_id", "latent", "cluster")
    return nearest.select("user_id", "cluster", F.posexplode("latent").alias("dim", "value")) \
        .groupBy("cluster", "dim").agg(F.avg("value").alias("mean"), F.count("*").alias("users"))


@query("kmeans_fixed_point")
def _kmeans_fixed_point(spark, sf_dir):
    """The fitted k-means is a fixed point: every user at its nearest centre, every centre its users' mean."""
    points = latent(spark, sf_dir).select("user_id", "latent")
    labels, cents = seg.kmeans_segments(points)
    nearest = seg.hard_labels(seg.soft_assignment(points, cents)).select("user_id", F.col("cluster").alias("near"))
    joined = points.join(labels, "user_id").join(nearest, "user_id")
    means = joined.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum((F.col("cluster") != F.col("near")).cast("int")).alias("away"),
        F.array(*(F.avg(F.get("latent", F.lit(i))) for i in range(cents.shape[1]))).alias("mean")).collect()
    shift = max(float(np.abs(np.array(r["mean"]) - cents[r["cluster"]]).max()) for r in means)
    return spark.createDataFrame(
        [(sum(r["n"] for r in means), len(means), sum(r["away"] for r in means), shift < 1e-6)],
        "users long, clusters int, users_not_at_nearest long, centres_are_means boolean")


FIXTURE_MODELS = ([0, 1], [0, 1, 2], [0, 1, 2, 3])


@query("lloyd_many_step")
def _lloyd_many_step(spark, sf_dir):
    """C1 (one combined step): three models, from the centroids of labels 0-1, 0-2 and 0-3, advanced in one pass:
    new centres, users per centre, and the cost under the old ones."""
    points = latent(spark, sf_dir)
    steps = km.lloyd_step(points, [seg.label_centroids(points, labels) for labels in FIXTURE_MODELS])
    rows = [(len(c), j, i, float(c[j, i]), int(n[j]), float(cost))
            for c, n, cost in steps for j in range(c.shape[0]) for i in range(c.shape[1])]
    return spark.createDataFrame(rows, "k int, cluster int, dim int, mean double, users long, cost double")


@query("elbow_invariants")
def _elbow_invariants(spark, sf_dir):
    """k = 1 costs the total sum of squares, and the cost never rises with k (checked on the fitted curve)."""
    points = latent(spark, sf_dir)
    cost = [r["inertia"] for r in seg.elbow(points).orderBy("k").collect()]
    total = seg.total_sum_of_squares(points)
    return spark.createDataFrame(
        [("k1_is_total", abs(cost[0] - total) <= 1e-9 * total), ("all_k", len(cost) == len(seg.ELBOW_KS)),
         ("never_rises", all(b <= a for a, b in zip(cost, cost[1:])))], "invariant string, holds boolean")


@query("autoencoder_gradient")
def _autoencoder_gradient(spark, sf_dir):
    """C9 (one full-data pass): gradient sums of the fixture autoencoder (L1 1e-3), times 1000."""
    b = Basket(spark, sf_dir)
    layers = lt.fixture_layers(b.width)
    _, _, _, grads = loss_and_gradient(b.vectors, layers, b.width, 1e-3)
    return lt.weight_table(spark, [(1e3 * w, 1e3 * g) for w, g in grads]).select(
        "layer", "kind", "row", F.posexplode("values").alias("col", "value"))


@query("autoencoder_loss")
def _autoencoder_loss(spark, sf_dir):
    """Mean penalised loss and mean squared error of the fixture autoencoder (L1 1e-3)."""
    b = Basket(spark, sf_dir)
    n, loss, err, _ = loss_and_gradient(b.vectors, lt.fixture_layers(b.width), b.width, 1e-3)
    return spark.createDataFrame([(int(n), float(loss / n), float(err / n))], "users long, loss double, mse double")


def _training_rows(b: Basket):
    """The user vectors with their train / validation split."""
    return b.vectors.join(mx.holdout_split(b.vectors.select("user_id")), "user_id")


HISTORY = "epoch int, loss double, val_loss double, mse double, val_mse double"


@query("autoencoder_fit")
def _autoencoder_fit(spark, sf_dir):
    """Autoencoder fit (hidden width d, latent 150, L1 1e-7) to its stop rule; the epoch history."""
    b = Basket(spark, sf_dir)
    d = b.width
    res = fit_autoencoder(_training_rows(b), d, [(d, d), (d, 150), (150, d)], 1e-7)
    return spark.createDataFrame([(int(e), *map(float, rest)) for e, *rest in res.history], HISTORY)


@query("latent_sweep")
def _latent_sweep(spark, sf_dir):
    """C12 with A26-A30: grid over (latent width, L1 strength) = (150, 1e-8), (150, 1e-9), each fitted to
    its stop rule, its latent matrix written and profiled."""
    b = Basket(spark, sf_dir)
    d = b.width
    rows, models = [], None
    for ld, r in [(150, 1e-8), (150, 1e-9)]:
        res = fit_autoencoder(_training_rows(b), d, [(d, d), (d, ld), (ld, d)], r)
        name = f"{ld}-{r:g}"
        rows.append((name, ld, r, *map(float, res.history[res.best_epoch][1:])))
        z = lt.with_model(encode_fitted(b.vectors, res, d), name)
        models = z if models is None else models.unionByName(z)
    path = scratch_path(spark, "sweep_latent")
    files.write_latent(models, path)
    values = lt.latent_values(files.scan_latent(spark, path))
    fits = spark.createDataFrame(rows, "model string, ld int, r double, train_loss double, val_loss double, "
                                       "train_mse double, val_mse double")
    return fits.join(lt.latent_sparsity(values), "model").join(lt.latent_variance(values), "model")


@query("autoencoder_adam_step")
def _autoencoder_adam_step(spark, sf_dir):
    """C9 on block tables (one epoch): the fixture autoencoder's weights, times 1000, after one Adam step over each
    task's users (up to 16,384 a task) as one mini-batch; the parameters stay on the executors."""
    b = Basket(spark, sf_dir)
    d = b.width
    rows = b.vectors.withColumn("split", F.lit("train"))
    fit = fit_autoencoder(rows, d, lt.layer_shapes(d), 1e-3, epochs=1, batch_rows=1 << 30, driver_values=0,
                          start=_flatten(lt.fixture_layers(d)), keep="last")
    return weights_of(fit.model, fit.shapes).select(
        "layer", "kind", "row", F.posexplode(F.transform("values", lambda x: F.lit(1000.0) * x)).alias("col", "value"))


@query("autoencoder_wide_epoch")
def _autoencoder_wide_epoch(spark, sf_dir):
    """C9 at the width of the product keys (fixture B, hidden width d, latent 150, L1 1e-7): one epoch on block
    tables, with its training and validation losses."""
    b = Basket(spark, sf_dir, "part")
    d = b.width
    res = fit_autoencoder(_training_rows(b), d, [(d, d), (d, 150), (150, d)], 1e-7, epochs=1, driver_values=0)
    return spark.createDataFrame([(int(e), *map(float, rest)) for e, *rest in res.history], HISTORY)


def _fitted_chain(spark, b: Basket) -> tuple[DataFrame, dict]:
    """(user_id, latent, q, p, cluster) of the study's chain over ``b``, written once a session, and what its loops told.

    Autoencoder fit at the study's widths, its weights written, latent vectors,
    k-means, DEC with the encoder to its stop rule, labels.
    """
    told: dict = {}

    def build():
        d = b.width
        fit = fit_autoencoder(_training_rows(b), d, [(d, d), (d, 150), (150, d)], 1e-7)
        files.write_weights(fitted_weights(spark, fit), scratch_path(spark, "chain_model"))
        z = encode_fitted(b.vectors, fit, d)
        _, cents = seg.kmeans_segments(z, seg.N_CLUSTERS, n_init=seg.N_INIT)
        done = dec_train(b.vectors, fit, cents, d)
        told.update(history=fit.history, best=fit.best_epoch, churn=done.history, centroids=done.centroids)
        return seg.target_distribution(seg.soft_assignment(dec_labels(b.vectors, done, d), done.centroids), len(cents))

    scored = reuse_or_write(spark, "chain_scored", b.key, build)
    return scored, remember(spark, ("chain_told", b.key), lambda: told)


@query("segmentation_chain")
def _segmentation_chain(spark, sf_dir):
    """The whole study: autoencoder fit (d, d, 150, d), weights, latent vectors, k-means, DEC with the encoder,
    labels; size, mean q and p, and silhouettes per segment."""
    b = Basket(spark, sf_dir)
    scored, _ = _fitted_chain(spark, b)
    labels = scored.select("user_id", "cluster")
    latent_sil = seg.silhouette_of_vectors(scored, labels).first()[0]
    matrix_sil = seg.silhouette_from_triples(b.triples, labels).first()[0]
    return (prof.cluster_sizes(labels).join(seg.mean_assignment(scored), "cluster", "right")
            .withColumn("users", F.coalesce("users", F.lit(0)))
            .withColumn("latent_silhouette", F.lit(latent_sil)).withColumn("matrix_silhouette", F.lit(matrix_sil)))


@query("learned_segment_bases")
def _learned_segment_bases(spark, sf_dir):
    """A20 on the learned labels: mean user features of the segments that the chain found."""
    b = Basket(spark, sf_dir)
    scored, _ = _fitted_chain(spark, b)
    return prof.segment_bases(b.user_rows, scored.select("user_id", "cluster"))


@query("learned_segment_extremes")
def _learned_segment_extremes(spark, sf_dir):
    """T5 on the learned labels: top 5 and bottom 5 products of the segments that the chain found."""
    b = Basket(spark, sf_dir)
    scored, _ = _fitted_chain(spark, b)
    means = prof.segment_means(b.matrix, scored.select("user_id", "cluster"), "product_name")
    return prof.ranked_items(means, b.matrix.select("product_name"), "product_name", 5, 5)


@query("chain_invariants")
def _chain_invariants(spark, sf_dir):
    """What the chain's loops promise, checked on their written result.

    Labels are the arg-max of q for the stored centroids; the kept epoch has the
    least validation loss; the fit ended by patience or its epochs; DEC ended by
    its churn or its steps; every user has one label.
    """
    b = Basket(spark, sf_dir)
    scored, told = _fitted_chain(spark, b)
    again = seg.hard_labels(seg.soft_assignment(scored.select("user_id", "latent", F.col("cluster").alias("label")),
                                                told["centroids"]))
    users, away = again.agg(F.count("*"), F.sum((F.col("label") != F.col("cluster")).cast("int"))).first()
    val = [h[2] for h in told["history"]]
    last_step, last_churn = told["churn"][-1]
    rows = [("labels_are_argmax", away == 0), ("best_epoch_is_least", min(val) == val[told["best"]]),
            ("fit_stopped_by_rule", len(val) == 200 or len(val) - 1 - told["best"] == 10),
            ("dec_stopped_by_rule", last_churn < DEC_TOLERANCE or last_step >= DEC_MAX_STEPS),
            ("one_label_per_user", users == b.vectors.count())]
    return spark.createDataFrame([(n, bool(ok)) for n, ok in rows], "invariant string, holds boolean")


@query("describe_latent")
def _describe_latent(spark, sf_dir):
    """D2 on the latent matrix: describe() of every latent dimension."""
    points = latent(spark, sf_dir)
    d = points.select(F.max(F.size("latent"))).first()[0] or 0
    wide = points.select(*(F.get("latent", F.lit(i)).alias(f"z{i}") for i in range(d)))
    return qual.profile_describe(wide, [f"z{i}" for i in range(d)])


@query("dec_train_encoder")
def _dec_train_encoder(spark, sf_dir):
    """C8 with encoder training: DEC on the basket vectors to its stop rule, encoder (d -> 8 -> 4) and
    centroids updated together from k-means initial centroids; labels per user."""
    b = Basket(spark, sf_dir)
    d = b.width
    encoder = lt.fixture_layers(d)[:2]
    _, cents = seg.kmeans_segments(lt.encode(b.vectors, encoder, d), seg.N_CLUSTERS, n_init=seg.N_INIT)
    done = dec_train(b.vectors, encoder, cents, d)
    z = lt.encode(b.vectors, done.encoder, d)
    return seg.hard_labels(seg.soft_assignment(z, done.centroids)).select("user_id", "cluster")


# ------------------------------------------------------------- matrix blocks --

def _user_blocks(b: Basket, cols_per_block: int = bk.COLS_PER_BLOCK):
    """The user x product matrix in blocks, written once: users dealt by hash, products by ranges of their index."""
    def build():
        n = bk.blocks_for(b.triples, "user_id")
        return bk.to_blocks(b.triples, "user_id", "idx", "value", bk.hashed(F.col("user_id"), n),
                            bk.ranged(F.col("idx"), cols_per_block))
    return b._stage(f"blocks-{cols_per_block}", build)


@query("block_column_sums")
def _block_column_sums(spark, sf_dir):
    """R3 in blocks: sum and stored cells of every matrix column."""
    sums = bk.column_sums(_user_blocks(Basket(spark, sf_dir)))
    return sums.select(F.col("col").cast("int").alias("idx"), "total", "n_cells")


@query("block_transpose")
def _block_transpose(spark, sf_dir):
    """R5 on the block matrix: the cells of the product x user matrix."""
    cells = bk.to_cells(bk.transpose(_user_blocks(Basket(spark, sf_dir), 16)))
    return cells.select(F.col("row").cast("int").alias("idx"), F.col("col").alias("user_id"), F.col("val").alias("value"))


@query("block_gram")
def _block_gram(spark, sf_dir):
    """R3 in blocks: the product x product matrix of common stickiness (transpose times matrix)."""
    blocks = _user_blocks(Basket(spark, sf_dir), 16)
    cells = bk.to_cells(bk.multiply(bk.transpose(blocks), blocks))
    return cells.select(F.col("row").cast("int").alias("idx"), F.col("col").cast("int").alias("idx2"),
                        F.col("val").alias("value"))


@query("matrix_column_range")
def _matrix_column_range(spark, sf_dir):
    """A range of the wide matrix's columns, read from the blocks of that range only."""
    return bk.wide_range(_user_blocks(Basket(spark, sf_dir), 16), 14, 20, cols_per_block=16)


@query("encode_latent_blocks")
def _encode_latent_blocks(spark, sf_dir):
    """C10 by block products: the fixed-weight encoder (d -> 8 -> 4) without a dense row of width d."""
    b = Basket(spark, sf_dir)
    (w1, b1), (w2, b2) = lt.fixture_layers(b.width)[:2]
    hidden = bk.layer(_user_blocks(b), bk.weight_blocks(spark, np.asarray(w1)), list(b1))
    again = bk.to_blocks(hidden, "row", "col", "val", bk.hashed(F.col("row"), bk.blocks_for(hidden, "row")),
                         bk.ranged(F.col("col")))
    z = bk.layer(again, bk.weight_blocks(spark, np.asarray(w2)), list(b2))
    return z.select(F.col("row").alias("user_id"), F.col("col").cast("int").alias("dim"), F.col("val").alias("value"))


# ------------------------------------------------------- stages keyed by user --

@query("user_features_keyed")
def _user_features_keyed(spark, sf_dir):
    """J5 over lines written in buckets of users: no exchange."""
    return Basket(spark, sf_dir).pareto_by_user.each(feat.user_features)


@query("sticky_keyed")
def _sticky_keyed(spark, sf_dir):
    """A12-A14 over lines written in buckets of users: no exchange."""
    return Basket(spark, sf_dir).pareto_by_user.each(feat.sticky)


@query("user_vectors_keyed")
def _user_vectors_keyed(spark, sf_dir):
    """R4 over matrix cells written in buckets of users: no exchange."""
    b = Basket(spark, sf_dir)
    vectors = b.keyed("triples", lambda: b.triples).each(mx.user_arrays)
    return vectors.select("user_id", F.posexplode(F.arrays_zip("indices", "values")).alias("k", "cell")).select(
        "user_id", "k", F.col("cell.indices").alias("idx"), F.col("cell.values").alias("value"))
