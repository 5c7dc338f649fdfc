"""Profiling and data-quality operators: ``info``, ``describe``, ``nunique``,
positional peeks and formatted metrics.

Exact quartiles are computed without sorting a column: a histogram tells the
bins that hold the quantile positions, and only the distinct values of these
bins are ranked, then interpolated linearly (pandas' default).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = (0.25, 0.5, 0.75)
QUANTILE_BINS = 4096
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, cols: Sequence[str], value: Column | None = None) -> DataFrame:
    """``(column, value)`` rows, one per cell (``unpivot``)."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column", "value")


def profile_info(df: DataFrame) -> DataFrame:
    """``info()``: column position, name, non-null count and type."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column", "non_null")
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    return F.broadcast(types).join(long, "column").select("position", "column", "non_null", "dtype")


def exact_quantiles(long: DataFrame, probs: Iterable[float] = QUANTILES, bins: int = QUANTILE_BINS) -> DataFrame:
    """Linear-interpolation quantiles per ``column`` of a ``(column, value)`` frame.

    NULL and NaN values are skipped; infinities stand at the ends of the order. Result: ``(column, p, q)``. A histogram of
    ``bins`` equal-width bins per column tells which bins hold the wanted
    ranks; only the values of these bins are grouped (equal values fold before
    the shuffle) and ranked. Nothing of the size of the input is sorted.
    """
    probs = [float(p) for p in probs]
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    stats = vals.groupBy("column").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"),
                                       F.count(F.lit(1)).alias("n"))  # one row per column
    width = F.col("hi") - F.col("lo")
    place = F.when(F.col("value") == float("-inf"), -1).when(F.col("value") == float("inf"), bins) \
        .when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width * bins))) \
        .otherwise(0).cast("int")
    binned = vals.join(F.broadcast(stats), "column").select("column", "value", "n", place.alias("bin"))
    by_bin = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = binned.groupBy("column", "n", "bin").agg(F.count(F.lit(1)).alias("c")) \
        .withColumn("before", F.sum("c").over(by_bin) - F.col("c"))  # bins per column
    wanted = F.array(*(F.struct(F.lit(p).alias("p"), ((F.col("n") - 1) * F.lit(p)).alias("h")) for p in probs))
    ranks = counts.select("column", "bin", "before", "c", F.explode(wanted).alias("w")) \
        .select("column", "bin", "before", "c", "w.p", "w.h", F.explode(F.array(F.floor("w.h"), F.ceil("w.h"))).alias("rank")) \
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).distinct()
    by_value = Window.partitionBy("column", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = binned.join(F.broadcast(ranks.select("column", "bin").distinct()), ["column", "bin"], "left_semi") \
        .groupBy("column", "bin", "value").agg(F.count(F.lit(1)).alias("m")) \
        .withColumn("upto", F.sum("m").over(by_value))
    at = inside.join(F.broadcast(ranks), ["column", "bin"]) \
        .where((F.col("rank") >= F.col("before") + F.col("upto") - F.col("m"))
               & (F.col("rank") < F.col("before") + F.col("upto")))  # a few ranks per column
    frac = F.max("h") - F.floor(F.max("h"))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    q = F.when((frac == 0) | (low == high), low).otherwise(low + frac * (high - low))
    return at.groupBy("column", "p").agg(q.alias("q"))


def profile_describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``describe()`` of numeric columns in long form.

    ``(column, count, mean, std, min, q25, q50, q75, max)``; ``std`` is the
    sample standard deviation. NULL and NaN are skipped. The exact quartiles come from a histogram and the
    values of the bins that hold them; ``approx=True`` uses ``percentile_approx`` (a bounded sketch
    per column, partial before the shuffle) instead.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = _long(df, cols).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    if approx:
        qs = long.groupBy("column").agg(F.percentile_approx("value", list(QUANTILES)).alias("qs"))
        q = qs.select("column", *[F.col("qs")[i].alias(str(p)) for i, p in enumerate(QUANTILES)])
    else:
        q = exact_quantiles(long).groupBy("column").pivot("p", list(QUANTILES)).agg(F.first("q"))
    q = q.select("column", *[F.col(f"`{p}`").alias(f"q{int(p * 100)}") for p in QUANTILES])
    return stats.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``describe(include='all')`` for string columns: count, unique, top, freq.

    ``top`` is the most frequent value, ties to the smallest value.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    long = df.select(*[F.col(f"`{c}`") for c in cols]).unpivot([], list(cols), "column", "value") \
        .where(F.col("value").isNotNull())
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by(F.struct(F.col("n"), F.col("value")), F.struct(-F.col("n"), F.col("value"))).alias("top_s"),
    ).select("column", "count", "unique", F.col("top_s.value").alias("top"), F.col("top_s.n").alias("freq"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``nunique()``: distinct non-null values per column, long form.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``), whose state
    is bounded per column, instead of an exact distinct per column.
    """
    cols = list(cols) if cols is not None else df.columns
    agg = F.approx_count_distinct if approx else F.count_distinct
    counts = df.agg(*[agg(F.col(f"`{c}`")).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "n_unique")


def sorted_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A full sort (range partitioned by Spark)."""
    return df.orderBy(*cols)


def row_slice(df: DataFrame, order: Sequence[str], start: int, stop: int,
              cols: Sequence[str] | None = None) -> DataFrame:
    """``iloc[start:stop, cols]`` over an explicit total order."""
    out = df.orderBy(*order).offset(start).limit(stop - start)
    return out.select(*cols) if cols is not None else out


def format_metrics(df: DataFrame, formats: dict[str, int]) -> DataFrame:
    """``f"{x:.Nf}"`` on the given columns."""
    return df.select(*[F.format_string(f"%.{formats[c]}f", F.col(c)).alias(c) if c in formats
                       else F.col(c) for c in df.columns])
