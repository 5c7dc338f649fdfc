"""Connected components of a link table, on Spark.

Alternating large-star and small-star steps over (u, v) rows: every step is a
grouped minimum and a join on the node, so a node with very many links is
pre-aggregated before the shuffle and its join rows are split by AQE. Steps
end when the rows no longer change; each step's rows are written to the shared
checkpoint folder. No link or label reaches the driver, only two numbers per
step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .exchange import stored


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (sym.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u")
            .select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"),
                    F.col("m").alias("v")).where("u != v").distinct())


def _written(rows: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The rows, written, and what tells them from other rows (count and sum of hashes, taken while writing)."""
    told = Observation(name)
    out = stored(rows.observe(told, F.count(F.lit(1)).alias("n"),
                              F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), name)
    return out, (told.get["n"], told.get["s"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (columns u, v: long); component is its smallest node.

    Nulls and self-links are ignored; an empty table gives an empty table;
    repeated links count once.
    """
    e = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e, seen = _written(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .distinct(), name)
    while seen[0]:
        e, now = _written(_small_star(_large_star(e)), name)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
