"""File sources and sinks: CSV with explicit schemas, latent and weight tables.

Parquet is the default sink. CSV exists because the reference hands its
stages over as CSV files; it is always read with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import quoted
from .schemas import TABLE_SCHEMAS

LATENT = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("latent", T.ArrayType(T.DoubleType()), True),
])


def write_csv(df: DataFrame, path: str) -> None:
    """``to_csv(path, index=False)``: a header line, one part file per partition (S-2).

    Quotes inside a field are doubled, as pandas and RFC 4180 write them.
    """
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multiline: bool = False) -> DataFrame:
    """CSV scan with a header and an explicit schema (S-1); ``schema`` may name a basket table.

    Columns are taken *by header name* and cast to ``schema``, so the file's
    column order and any extra columns do not matter. All fields are read as
    strings (no inference pass) and cast once; a row with a wrong number of
    fields stops the read. ``multiline`` allows line breaks inside quoted
    fields; such a file is read by one task, so it is meant for dimensions.
    """
    if isinstance(schema, str):
        schema = TABLE_SCHEMAS[schema]
    raw = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline,
                             mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return raw.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_latent(models: DataFrame, path: str) -> None:
    """Latent matrices of several models in one table partitioned by ``model`` (S-3)."""
    models.write.mode("overwrite").partitionBy("model").parquet(path)


def scan_latent(spark: SparkSession, path: str) -> DataFrame:
    """All models at once; a filter on ``model`` prunes partitions (S-4)."""
    return spark.read.parquet(path).select("model", "user_id", "latent")


def write_weights(table: DataFrame, path: str) -> None:
    """Model weights, one row per matrix row: ``(layer, kind, row, values)`` (S-5)."""
    table.write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("layer", "kind", "row", "values")


# File names of the reference's five input tables.
BASKET_CSV_FILES = {
    "aisles": "aisles.csv",
    "departments": "departments.csv",
    "order_products": "order_products__prior.csv",
    "orders": "orders.csv",
    "products": "products.csv",
}


#: tables with names in them, which may hold line breaks
DIMENSION_FILES = ("aisles", "departments", "products")


def read_basket_csv(spark: SparkSession, folder: str):
    """The five grocery tables from a folder of the reference's CSV files."""
    from .basket import BasketTables
    folder = folder.rstrip("/")
    t = {name: read_csv(spark, f"{folder}/{fname}", name, multiline=name in DIMENSION_FILES)
         for name, fname in BASKET_CSV_FILES.items()}
    return BasketTables(t["orders"], t["order_products"], t["products"], t["aisles"], t["departments"])


def write_basket_csv(tables, folder: str) -> None:
    """Write five basket tables as the reference's CSV files (one folder per file name)."""
    for name, fname in BASKET_CSV_FILES.items():
        write_csv(getattr(tables, name), f"{folder.rstrip('/')}/{fname}")
