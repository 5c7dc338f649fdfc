"""Shared building blocks of the registered queries.

A ``Basket`` builds, once per query, the frames that several operators start
from (the five tables, the merged line table, the Pareto-selected lines, the
feature table). Nothing is cached across queries; Spark reuses identical
shuffle outputs inside one plan (exchange reuse).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import quoted
from ..operators import features as feat
from ..operators import merge
from ..operators import latent as lt
from ..operators import matrix as mx
from ..operators import selection as sel
from ..operators.profiles import label_by_modulo
from ..sources.basket import BasketTables, Bounds, basket_tables, dimension_bounds, latent_fixture
from ..sources.keyed import KeyedStage, write_keyed
from ..sources.storage import remember, reuse_or_write, source_fingerprint

DOUBLE_DIGITS = 6


def rounded(df: DataFrame, digits: int = DOUBLE_DIGITS) -> DataFrame:
    """Round every double column: sums and means of doubles depend on addition order.

    ``+ 0.0`` turns a negative zero into 0.0, so the sign of a rounded-away
    tiny value never depends on the engine.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(quoted(f.name)), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(quoted(f.name)))
    return df.select(*cols)


SOURCES = ("orders", "lineitem", "part")


class Basket:
    """Stages of the basket flow for one dataset; each shared stage is a written
    table registered under the identity of the input files, so every query of a
    session over the same files reads it instead of recomputing it."""

    def __init__(self, spark: SparkSession, sf_dir: str, grain: str = "name") -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.grain = grain
        self.key = (self.grain, source_fingerprint([f"{self.sf_dir}/{t}.parquet" for t in SOURCES], spark))

    def _stage(self, label: str, build) -> DataFrame:
        return reuse_or_write(self.spark, f"{label}-{self.grain}", self.key, build)

    @cached_property
    def bounds(self) -> Bounds:
        """Proven once per input: which dimensions fit a broadcast."""
        return remember(self.spark, ("dimension_bounds", self.key),
                        lambda: dimension_bounds(self.spark, self.sf_dir, self.grain))

    @cached_property
    def small(self) -> bool:
        """The product, aisle and department tables fit a broadcast."""
        return self.bounds.products

    @cached_property
    def tables(self) -> BasketTables:
        return basket_tables(self.spark, self.sf_dir, self.grain, self.bounds, store=self._stage)

    @cached_property
    def data(self) -> DataFrame:
        """The merged order-line table (script 1 output), written once."""
        return self._stage("lines", lambda: merge.merge_full(self.tables, self.small, self.bounds.labels))

    @cached_property
    def dim(self) -> DataFrame:
        t = self.tables
        return merge.product_dim(t.products, t.aisles, t.departments, self.bounds.labels)

    @cached_property
    def pareto(self) -> DataFrame:
        """Lines of the 80 % head products without the top 6 (script 2/3 selection), written once."""
        return self._stage("pareto_lines", lambda: sel.pareto_lines(self.data, bounded=self.small))

    def keyed(self, label: str, build) -> KeyedStage:
        """A stage written in buckets of ``user_id``, once per input."""
        return remember(self.spark, ("keyed", label, self.key), lambda: write_keyed(build(), "user_id", f"keyed-{label}"))

    @cached_property
    def pareto_by_user(self) -> KeyedStage:
        """The Pareto-selected lines in buckets of users."""
        return self.keyed("pareto_lines", lambda: self.pareto)

    @cached_property
    def features(self) -> DataFrame:
        """The long feature table (script 3 output), written once."""
        t = self.tables
        return self._stage("features", lambda: feat.feature_table(
            self.pareto, t.products, t.aisles, t.departments, small=self.small, small_labels=self.bounds.labels))

    @cached_property
    def matrix(self) -> DataFrame:
        """The user × product matrix in long form: ``(user_id, product_name, value)``."""
        return self.features.select("user_id", "product_name", F.col("sticky").alias("value"))

    @cached_property
    def labels(self) -> DataFrame:
        """Fixture segment label ``user_id % 3`` for every user of the matrix."""
        return label_by_modulo(self.matrix.select("user_id"))

    @cached_property
    def user_rows(self) -> DataFrame:
        """One row per matrix user with the four user features."""
        return mx.user_constants(self.features)

    @cached_property
    def index(self) -> DataFrame:
        """0-based product index in ascending name order (the matrix columns)."""
        return mx.product_index(self.features, bounded=self.small)

    @cached_property
    def width(self) -> int:
        """Number of matrix columns d (a catalogue-sized scalar)."""
        return self.index.count()

    @cached_property
    def triples(self) -> DataFrame:
        """Non-zero matrix cells ``(user_id, idx, value)`` (the matrix stage), written once."""
        return self._stage("triples", lambda: mx.sparse_triples(
            self.features, self.index, small=self.small or self.width <= mx.MAX_CATALOGUE_ROWS))

    @cached_property
    def vectors(self) -> DataFrame:
        """Sparse user vectors ``(user_id, indices, values)``."""
        return mx.user_arrays(self.triples)


def latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture C: ``(user_id, latent, label)``."""
    return latent_fixture(spark, sf_dir)


def latent_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two latent models of the same users: the raw vectors and their sigmoid."""
    lat = latent_fixture(spark, sf_dir).select("user_id", "latent")
    return lt.with_model(lat, "embedding").unionByName(
        lt.with_model(lt.sigmoid_latent(lat), "embedding_sigmoid"))
