"""Stickiness, spread and user/product features on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import features as feat


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_single_purchase_is_fully_sticky(lines):
    s = by_key(feat.sticky(lines([(1, 1, 10)])), "user_id", "product_id")
    assert s[(1, 10)]["sticky"] == pytest.approx(1.0)


def test_spread_and_sticky_orders_1_2_10_of_10(lines):
    rows = [(1, n, 10) for n in (1, 2, 10)] + [(1, n, 99) for n in range(1, 11)]
    df = lines(rows)
    spread = by_key(feat.pair_spread(df), "user_id", "product_id")
    assert spread[(1, 10)]["spread"] == 6.0
    s = by_key(feat.sticky(df), "user_id", "product_id")
    assert s[(1, 10)]["sticky"] == pytest.approx(0.5 * 3 / 10 + 0.5 * 3 / 16)


def test_gap_rows_sum_to_closed_form(lines):
    rows = [(u, n, p) for u in (1, 2) for p in (5, 6) for n in (1, 3, 4, 9) if (n + p + u) % 3]
    df = lines(rows)
    row_form = feat.order_gaps(df).groupBy("user_id", "product_id").agg(
        F.greatest(F.lit(0.0), F.sum("order_diff")).alias("s"))
    closed = feat.pair_spread(df)
    a = by_key(row_form, "user_id", "product_id")
    b = by_key(closed, "user_id", "product_id")
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["s"] == b[k]["spread"]


def test_users_below_three_orders_keep_null_features(lines):
    df = lines([(1, 1, 10), (1, 2, 10), (2, 1, 10), (2, 2, 11), (2, 3, 10)])
    pf = by_key(feat.pair_features(df), "user_id", "product_id")
    assert pf[(1, 10)]["u_total_orders"] is None
    assert pf[(2, 10)]["u_total_orders"] == 3
    assert pf[(2, 10)]["order_size_avg"] == pytest.approx(1.0)


def test_empty_lines_give_empty_results_with_schema(lines, spark):
    empty = lines([(1, 1, 10)]).limit(0)
    out = feat.sticky(empty)
    assert out.columns == ["user_id", "product_id", "sticky"]
    assert out.count() == 0


def test_modal_weekday_ties_to_smallest(spark):
    rows = [(i, 1, i, 10, 0.0, 0, 1, dow) for i, dow in enumerate([3, 5, 3, 5, 1])]
    df = spark.createDataFrame(rows, "order_id long, user_id long, order_number int, product_id long, "
                                     "days_since_prior_order double, reordered int, "
                                     "add_to_cart_order int, order_dow int")
    assert feat.pair_modal_dow(df).first()["order_dow"] == 3
