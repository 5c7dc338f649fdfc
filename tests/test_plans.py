"""Physical-plan guards: no pair enumeration anywhere, pruned scans for the flagship."""

import re

import pytest

from small_data import SF_SMALL

CHEAP_TO_BUILD = None  # every registered query; iterative ones build their models first
SKIP = {"elbow", "latent_map_tsne", "elbow_invariants", "lloyd_many_step", "kmeans_segments", "kmeans_fixed_point", "dec_refine", "dec_one_stage", "dec_train_encoder", "autoencoder_fit",
        "latent_sweep", "segmentation_chain", "autoencoder_wide_epoch", "autoencoder_adam_step",
        "learned_segment_bases", "learned_segment_extremes", "chain_invariants", "pipeline"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _names():
    import __spark_entry__ as entry
    return [n for n in entry.queries() if n not in SKIP and not re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", _names())
def test_no_cartesian_or_nested_loop_join(spark, name):
    import __spark_entry__ as entry
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_reads_only_the_columns_it_needs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas, plan
    for s in schemas:
        assert len(s.split(",")) <= 4, s


def test_pareto_filter_does_not_shuffle_the_lines(spark):
    """The operator itself, unwritten, with static broadcasts out of reach: no exchange above the line scan."""
    from basketry.operators import selection as sel
    lines = spark.range(1000).selectExpr("id as order_id", "id % 7 as product_id", "id as payload")
    kept = lines.groupBy("product_id").count().where("count > 100")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(sel.lines_in_products(lines, kept, bounded=True))
        unbounded = _plan(sel.lines_in_products(lines, kept))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange[^\n]*\n[^\n]*payload", plan)
    assert "SortMergeJoin" in unbounded


STAGES = ["tables.orders", "tables.order_products", "tables.products", "data", "pareto", "features", "triples"]


@pytest.mark.parametrize("stage", STAGES)
def test_stage_builders_form_no_pairs(spark, stage, monkeypatch):
    """The plans that do the work: every shared stage planned without its written inputs."""
    from basketry.plans import context
    monkeypatch.setattr(context, "reuse_or_write", lambda spark, label, key, build: build())
    df = context.Basket(spark, SF_SMALL)
    for name in stage.split("."):
        df = getattr(df, name)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Exchange" in plan
