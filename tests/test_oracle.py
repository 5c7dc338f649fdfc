"""Registered queries against their DuckDB oracle on the smallest fixture.

A representative subset runs by default; ``BASKETRY_FULL_ORACLE=1`` runs all.
"""

import os

import pytest

from small_data import SF_SMALL
from oracle_compare import compare, duck

SUBSET = ["basket_lines", "merge_full", "cumulative_share", "pareto_lines", "sticky", "feature_table",
          "order_gaps", "category_codes", "sticky_matrix", "profile_describe",
          "segment_extremes_products", "latent_histogram", "target_distribution", "dec_step",
          "silhouette_sq_basket", "encode_latent", "scan_csv"]


def _names():
    import __spark_entry__ as entry
    sql = entry.oracle_sql()
    names = list(sql) if os.environ.get("BASKETRY_FULL_ORACLE") else SUBSET
    return [n for n in names if n in sql]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    ok, _, _, detail = compare(spark, con, SF_SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, detail


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["user_id", "product_id", "sticky"]
    assert df.count() > 0
