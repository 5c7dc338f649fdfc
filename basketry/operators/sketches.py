"""Column profiles as mergeable sketches (D2, A15), beside the exact path of ``quality``.

One pass gives a row per (group, column) with exact counts, sum, least and
greatest value, a HyperLogLog sketch for distinct counts and a KLL sketch for
quantiles. The rows are small, can be stored with a stage, and merge to the profile of any
union of groups without reading the data again.

Nulls and NaN are counted apart and left out of everything else; a column without values has null
statistics and no distinct values. An empty table without groups gives a row of zero counts per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_LOG_K = 12
KLL_K = 200
#: stated errors: three standard errors of HLL, and the rank error of KLL at 99 %
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_LOG_K / 2)
RANK_ERROR = 0.0165
QUANTILES = (0.25, 0.5, 0.75)
STATE = ("n_rows", "n_values", "total", "min", "max", "hll", "kll")


def sketch_rows(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, *STATE)``: one aggregate over ``df``, partial before the shuffle."""
    def state(c: str):
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_values"),
            F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.hll_sketch_agg(F.when(v == 0, 0.0).otherwise(v).cast("string"), HLL_LOG_K).alias("hll"),
            F.kll_sketch_agg_double(v, KLL_K).alias("kll"))
    wide = df.groupBy(*by).agg(F.array(*(state(c) for c in cols)).alias("states"))
    return wide.select(*by, F.inline("states"))


def merge_sketches(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``sketch_rows`` merged over all groups but ``by``."""
    return rows.groupBy(*by, "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll", KLL_K).alias("kll"))


def profile(rows: DataFrame) -> DataFrame:
    """What the sketches tell: counts, mean, least and greatest value exactly, the rest within the stated errors."""
    some = F.col("n_values") > 0
    return rows.select(
        *(c for c in rows.columns if c not in STATE), "n_rows", "n_values",
        (F.col("total") / F.col("n_values")).alias("mean"), "min", "max",
        F.hll_sketch_estimate("hll").alias("distinct"),
        *(F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(q))).alias(f"q{int(q * 100)}") for q in QUANTILES))
