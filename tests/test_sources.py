"""Sources and sinks: the reference's CSV layout, latent partition pruning."""

import tempfile

from pyspark.sql import functions as F

from small_data import SF_SMALL
from basketry.operators import merge
from basketry.sources import files
from basketry.sources.basket import basket_tables


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_basket_csv_round_trip_by_column_name(spark):
    tables = basket_tables(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="basket-csv-")
    # reorder columns before writing: the reader must match them by header name
    shuffled = type(tables)(*[t.select(*reversed(t.columns)) for t in
                              (tables.orders, tables.order_products, tables.products,
                               tables.aisles, tables.departments)])
    files.write_basket_csv(shuffled, folder)
    back = files.read_basket_csv(spark, folder)
    for name in ["orders", "order_products", "products", "aisles", "departments"]:
        a, b = getattr(tables, name), getattr(back, name)
        assert b.schema == files.TABLE_SCHEMAS[name] or b.columns == a.columns
        assert _rows(a.select(*a.columns)) == _rows(b.select(*a.columns)), name
    assert merge.merge_full(back).count() == merge.merge_full(tables).count()


def test_latent_scan_prunes_model_partitions(spark):
    lat = spark.createDataFrame([("a", 1, [0.1]), ("b", 2, [0.2])], "model string, user_id long, latent array<double>")
    path = tempfile.mkdtemp(prefix="latent-") + "/t"
    files.write_latent(lat, path)
    df = files.scan_latent(spark, path).where(F.col("model") == "a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "(model#" in plan
    assert [r.user_id for r in df.collect()] == [1]


def test_stage_registry_reuses_and_rebuilds(spark):
    import os
    import time
    from basketry.sources import storage

    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = storage.reuse_or_write(spark, "t", ("k", 1), build)
    b = storage.reuse_or_write(spark, "t", ("k", 1), build)
    assert len(calls) == 1 and a.count() == b.count() == 5
    storage.reuse_or_write(spark, "t", ("k", 2), build)
    assert len(calls) == 2

    path = tempfile.mkdtemp(prefix="fp-") + "/f.txt"
    with open(path, "w") as fh:
        fh.write("a")
    before = storage.source_fingerprint([path], spark)
    time.sleep(0.01)
    with open(path, "w") as fh:
        fh.write("ab")
    os.utime(path, None)
    assert storage.source_fingerprint([path], spark) != before


def test_reads_csv_that_pandas_wrote(spark, tmp_path):
    import pandas as pd
    rows = pd.DataFrame({"department_id": [4, 5], "extra": ["x", 'y "z"'], "aisle_id": [3, 2],
                         "product_name": ['"Big" Bar, dark', "Say\n\"hi\", now"], "product_id": [1, 2]})
    rows.to_csv(tmp_path / "products.csv", index=False)
    got = files.read_csv(spark, str(tmp_path / "products.csv"), "products", multiline=True).orderBy("product_id")
    assert [tuple(r) for r in got.collect()] == [(1, '"Big" Bar, dark', 3, 4), (2, 'Say\n"hi", now', 2, 5)]
    files.write_csv(got.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert pd.read_csv(part)["product_name"].tolist() == rows["product_name"].tolist()


def test_columns_go_by_name_not_by_position(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n1,2,prior,3,4,8,15.0\n")
    r = files.read_csv(spark, str(tmp_path / "orders.csv"), "orders").first()
    assert (r.order_id, r.days_since_prior_order) == (1, 15.0)


def test_overwriting_a_part_file_changes_the_fingerprint(spark, tmp_path):
    import time
    from basketry.sources import storage
    folder = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(folder)
    before = storage.source_fingerprint([folder], spark)
    part = next((tmp_path / "t").glob("part-*"))
    time.sleep(0.02)
    part.write_bytes(part.read_bytes())
    assert storage.source_fingerprint([folder], spark) != before


def test_weights_and_centroids_round_trip_exactly(spark, tmp_path):
    import numpy as np
    from basketry.operators import latent as lt
    rng = np.random.default_rng(3)
    layers = [(rng.normal(size=s), rng.normal(size=s[1])) for s in [(7, 5), (5, 3), (3, 7)]]
    mu = rng.normal(size=(4, 3))
    files.write_weights(lt.weight_table(spark, layers, mu), str(tmp_path / "w"))
    back, mu2 = lt.layers_from_table(files.read_weights(spark, str(tmp_path / "w")))
    assert np.array_equal(mu, mu2) and len(back) == 3
    assert all(np.array_equal(a, c) and np.array_equal(b, e) for (a, b), (c, e) in zip(layers, back))
    assert lt.layers_from_table(lt.weight_table(spark, layers))[1] is None
