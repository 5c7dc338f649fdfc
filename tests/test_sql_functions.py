"""The SQL functions against the column expressions of the library."""

import pytest
from pyspark.sql import functions as F

from basketry.functions import sql_functions
from basketry.functions.scalar import histogram_bin
from basketry.operators import segments as seg

CENTROIDS = "array(array(0D, 0D), array(1D, 1D), array(5D, 0D))"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sql_functions.register(spark)
    sql_functions.register(spark)  # again: no error


def test_scalar_functions(spark):
    r = spark.sql("SELECT clip_at_zero(-1D) AS a, clip_at_zero(2D) AS b, stickiness(2L, 4, 1, 3) AS s").first()
    assert (r.a, r.b) == (0.0, 2.0) and r.s == pytest.approx(0.5 * 2 / 4 + 0.5 * 2 / 4)
    vals = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (None,), (float("nan"),)], "v double")
    both = vals.select(F.expr("histogram_bin(v, 0D, 1D, 4)").alias("x"),
                       histogram_bin(F.col("v"), F.lit(0.0), F.lit(1.0), 4).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both] == [0, 1, 3, None, None]


def test_assignments_and_table_function(spark):
    df = spark.createDataFrame([(1, [0.2, 0.1]), (2, [4.0, 0.0])], "user_id long, latent array<double>")
    cents = [[0.0, 0.0], [1.0, 1.0], [5.0, 0.0]]
    want = {r.user_id: (r.q, r.cluster) for r in seg.hard_labels(seg.soft_assignment(df, cents)).collect()}
    got = df.selectExpr("user_id", f"soft_assignment(latent, {CENTROIDS}) AS q").selectExpr("*", "hard_label(q) AS c").collect()
    assert all(r.q == pytest.approx(want[r.user_id][0]) and r.c == want[r.user_id][1] for r in got)
    rows = spark.sql(f"SELECT * FROM assignments(array(4D, 0D), {CENTROIDS})").collect()
    assert [r.q for r in sorted(rows, key=lambda r: r.cluster)] == pytest.approx(want[2][0])
    p = spark.sql("SELECT target_distribution(array(0.25D, 0.75D), array(1D, 3D)) AS p").first().p
    assert p == pytest.approx([0.25, 0.75])
