"""The study's own formulas as SQL functions, for users of ``spark.sql``.

``register(spark)`` defines temporary SQL functions (bodies in SQL, inlined by
Catalyst; no Python): the clip (U1), the stickiness score, the histogram bin,
the Student-t soft assignment (U4), the target distribution (U3) and the
arg-max label, and a table function that lists a vector's assignments.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.features import STICKY_WEIGHT

FUNCTIONS = (
    "clip_at_zero(x DOUBLE) RETURNS DOUBLE RETURN greatest(0D, x)",
    # n: times bought; total: the user's orders; first_order, last_order: orders that hold the product
    f"""stickiness(n BIGINT, total INT, first_order INT, last_order INT) RETURNS DOUBLE RETURN
        {STICKY_WEIGHT}D * (n / total)
        + {STICKY_WEIGHT}D * (n / CAST(total - first_order + 1 + greatest(0, last_order - first_order - n) AS DOUBLE))""",
    """histogram_bin(v DOUBLE, lo DOUBLE, hi DOUBLE, bins INT) RETURNS INT RETURN
        CASE WHEN v IS NULL OR isnan(v) THEN NULL WHEN hi = lo THEN 0
             ELSE CAST(least(bins - 1, floor((v - lo) / (hi - lo) * bins)) AS INT) END""",
    "scaled_to_one(w ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(w, v -> v / aggregate(w, 0D, (a, b) -> a + b))",
    """soft_assignment(latent ARRAY<DOUBLE>, centroids ARRAY<ARRAY<DOUBLE>>) RETURNS ARRAY<DOUBLE> RETURN
        scaled_to_one(transform(centroids, c -> 1D / (1D + aggregate(
            zip_with(latent, c, (x, y) -> (x - y) * (x - y)), 0D, (a, b) -> a + b))))""",
    """target_distribution(q ARRAY<DOUBLE>, totals ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN
        scaled_to_one(zip_with(q, totals, (a, f) -> a * a / f))""",
    "hard_label(q ARRAY<DOUBLE>) RETURNS INT RETURN CAST(array_position(q, array_max(q)) - 1 AS INT)",
    """assignments(latent ARRAY<DOUBLE>, centroids ARRAY<ARRAY<DOUBLE>>) RETURNS TABLE (cluster INT, q DOUBLE) RETURN
        SELECT pos, col FROM (SELECT soft_assignment(latent, centroids) AS q) LATERAL VIEW posexplode(q) AS pos, col""",
)


def register(spark: SparkSession) -> None:
    """Define (or define again) the functions in this session."""
    for body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
