"""Stages in buckets of a key: same rows as the plain table, no exchange, hot keys beside the buckets."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import features as feat
from basketry.operators import matrix as mx
from basketry.sources.keyed import write_keyed


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def line_table(spark, rows):
    return spark.createDataFrame(
        [(10 * (u or 0) + n, u, n, p, float(n), n % 2, 1, n % 7) for u, n, p in rows],
        "order_id long, user_id long, order_number int, product_id long, days_since_prior_order double, "
        "reordered int, add_to_cart_order int, order_dow int")


ROWS = [(u, n, (u * n) % 5) for u in range(1, 30) for n in range(1, 6)] + [(7, n, p) for n in range(1, 9) for p in range(9)]


@pytest.mark.parametrize("hot_rows", [20, 10**6])
@pytest.mark.parametrize("work", [feat.user_features, feat.sticky, feat.user_totals, feat.order_span])
def test_same_rows_and_no_exchange(spark, no_broadcast, work, hot_rows):
    lines = line_table(spark, ROWS)
    stage = write_keyed(lines, "user_id", "lines", hot_rows, buckets=3)
    assert (stage.rest is None) == (hot_rows > 100)
    if stage.rest is not None:
        assert {r[0] for r in stage.rest.select("user_id").distinct().collect()} == {7}
    assert "Exchange" not in work(stage.buckets)._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(str, d.collect())) for d in (stage.each(work), work(lines)))
    assert got == want


def test_vectors_need_no_exchange(spark):
    cells = spark.createDataFrame([(u, i, 1.0 * i) for u in range(40) for i in range(u % 5)], "user_id long, idx int, value double")
    stage = write_keyed(cells, "user_id", "cells", buckets=4)
    got = mx.user_arrays(stage.buckets)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, mx.user_arrays(cells).collect()))


def test_null_keys_repeats_and_empty(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), (1, 1, "c"), (1, 1, "c"), (2, 5, None)]
    df = spark.createDataFrame(rows, "user_id long, value int, key string")
    stage = write_keyed(df, "user_id", "odd", buckets=2)
    assert sorted(map(str, stage.each(lambda d: d).collect())) == sorted(map(str, df.collect()))
    counts = stage.each(lambda d: d.groupBy("user_id").agg(F.count("*").alias("n")))
    assert {tuple(r) for r in counts.collect()} == {(None, 2), (1, 2), (2, 1)}
    none = write_keyed(df.limit(0), "user_id", "none")
    assert none.rest is None and none.buckets.count() == 0 and none.buckets.columns == df.columns
