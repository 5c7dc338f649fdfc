"""Running totals, Pareto cutoff, sampling and the skew-safe sequence operator."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators import selection as sel
from basketry.operators.sequence import row_numbers, running_aggregates


@pytest.mark.parametrize("bounded", [False, True])
def test_tied_counts_get_rows_semantics(spark, bounded):
    counts = spark.createDataFrame([(1, 5), (2, 5), (3, 3)], "product_id long, observation_count long")
    got = {r.product_id: r.cumulative_percentage for r in sel.cumulative_share(counts, bounded=bounded).collect()}
    assert got == pytest.approx({1: 5 / 13 * 100, 2: 10 / 13 * 100, 3: 100.0})


def test_running_share_exactly_80_percent_is_kept(spark):
    counts = spark.createDataFrame([(1, 40), (2, 40), (3, 20)], "product_id long, observation_count long")
    kept = sel.pareto_cutoff(sel.cumulative_share(counts))
    assert sorted(r.product_id for r in kept.collect()) == [1, 2]


@pytest.mark.parametrize("hot_rows", [100, 2_000_000])
def test_running_aggregates_match_window_with_a_hot_key(spark, hot_rows):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 30), i, rnd.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    ours = running_aggregates(df, ["k"], ["o"], sums={"cum": F.col("v"), "rn": F.lit(1)},
                              prior_max={"prev": F.col("o")}, totals=True, hot_rows=hot_rows)
    w = Window.partitionBy("k").orderBy("o")
    ref = df.select("k", "o", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                    F.row_number().over(w).alias("rn"), F.lag("o").over(w).alias("prev"),
                    F.sum("v").over(Window.partitionBy("k")).alias("cum_total"))
    a = {(r.k, r.o): (r.cum, r.rn, r.prev, r.cum_total) for r in ours.collect()}
    b = {(r.k, r.o): (r.cum, r.rn, r.prev, r.cum_total) for r in ref.collect()}
    assert a == b


@pytest.mark.parametrize("bounded", [False, True])
def test_global_row_numbers_are_a_permutation(spark, bounded):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    got = sorted((r.x, r.rn) for r in row_numbers(df, [], ["x"], "rn", bounded).collect())
    assert [rn for _, rn in got] == list(range(1, 501))
    assert [x for x, _ in got] == list(range(500))


def test_hash_sample_is_deterministic_and_near_fraction(spark):
    users = spark.range(20000).withColumnRenamed("id", "user_id")
    a = sel.sample_users(users).count()
    assert a == sel.sample_users(users).count()
    assert abs(a / 20000 - 0.25) < 0.02
    exact = sel.sample_users(users, exact=True).count()
    assert exact == 5000


def test_top_products_tie_break(spark):
    counts = spark.createDataFrame([(i, 10 if i < 8 else 1) for i in range(12)],
                                   "product_id long, observation_count long")
    assert [r.product_id for r in sel.top_products(counts).collect()] == [0, 1, 2, 3, 4, 5]
