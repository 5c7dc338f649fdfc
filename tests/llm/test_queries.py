"""The registered queries: plans, and SQL where it exists, on the smallest tables."""

import re

import pytest

from basketry.llm.queries import QUERIES
from basketry.llm.sql import SQL
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pair_joins_in_any_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.startswith("op2_"):
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, name):
    ok, _, _, detail = compare(spark, duck(SF), SF, name, QUERIES[name], SQL[name])
    assert ok, detail


def test_repeated_exchanges_are_shared(spark):
    """The texts of substring dedup are shuffled once for its three uses."""
    df = QUERIES["op7_substring_dedup"](spark, SF)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 2


def test_entry_registers_all():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(SQL) <= set(entry.oracle_sql())
