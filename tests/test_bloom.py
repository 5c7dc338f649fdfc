"""Bloom-filtered membership equals the semi join and filters before the exchange."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import bloom


def test_bits_are_a_power_of_two_with_room():
    for n in (0, 1, 5, 6, 1000, 1 << 20):
        bits = bloom.bits_for(n)
        assert bits & (bits - 1) == 0 and bits >= max(64, n * bloom.BITS_PER_KEY)


@pytest.mark.parametrize("kept", [[], [None], [0], [-1, 2**62, 7, 7, None], list(range(0, 4000, 3))])
@pytest.mark.parametrize("max_bits", [32, bloom.MAX_BITS])
def test_equals_semi_join(spark, kept, max_bits):
    rows = spark.createDataFrame([(i, f"r{i}") for i in [*range(-5, 600), 2**62, None, 7]], "product_id long, words string")
    side = spark.createDataFrame([(k, 1) for k in kept], "product_id long, extra int")
    got = bloom.rows_with_keys(rows, side, "product_id", max_bits)
    assert got.columns == rows.columns
    want = [r for r in rows.collect() if r.product_id is not None and r.product_id in kept]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_few_other_keys_pass(spark):
    keys = spark.range(0, 3000).withColumnRenamed("id", "k")
    n_bits = bloom.bits_for(3000)
    words = bloom.bloom_filter(keys, "k", n_bits)
    assert words.select(F.size("words")).first()[0] == n_bits // 64
    held = spark.range(0, 23000).select("id", bloom.may_hold(words.scalar(), F.col("id"), n_bits).alias("ok")).where("ok")
    assert held.where("id < 3000").count() == 3000
    assert held.where("id >= 3000").count() < 0.02 * 20000


def test_rows_are_cut_before_their_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 50000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        got = bloom.rows_with_keys(rows, spark.range(0, 50).withColumnRenamed("id", "k"), "k")
        plan = got._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        tested = join[join.index("Filter"):].splitlines()[0]
        assert join.index("Exchange") < join.index("Filter") and "ubquery" in tested and "xxhash64" in tested
        assert got.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
