"""Column expressions shared by the operators. All are built-in Spark
functions (JVM side, whole-stage codegen); none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_at_zero(x: Column) -> Column:
    """``lambda x: 0 if x < 0 else x``."""
    return F.greatest(F.lit(0), x)


def percent_of(part: Column, total: Column) -> Column:
    """``part / total * 100`` in that operation order."""
    return part / total * F.lit(100.0)


def histogram_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin index in ``[0, bins)``; the last bin is closed on the right.

    ``least(bins - 1, floor((v - lo) / (hi - lo) * bins))``; when ``hi == lo``
    every value falls in bin 0. A null or NaN has no bin.
    """
    width = hi - lo
    raw = F.floor((v - lo) / width * F.lit(float(bins)))
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), raw)).cast("int")
    return F.when(v.isNotNull() & ~F.isnan(v), at)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equally long ``array<double>`` columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def format_fixed(x: Column, decimals: int) -> Column:
    """Python ``f"{x:.Nf}"`` (X7): fixed decimals, no thousands separator."""
    return F.format_string(f"%.{decimals}f", x)


def quoted(name: str) -> str:
    """A column name in backticks, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"
