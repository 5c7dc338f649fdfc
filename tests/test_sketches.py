"""Mergeable column profiles: parts merge to the whole, errors stay within what is stated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import quality
from basketry.operators import sketches as sk

COLS = ["a", "b", "column"]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 4), float(rng.normal()), None if i % 3 else float(i % 50), float("nan") if i % 10 == 0 else 2.0)
            for i in range(20000)]
    return spark.createDataFrame(rows, "part int, a double, b double, column double").cache()


def test_parts_merge_to_the_whole(values):
    parts = sk.sketch_rows(values, COLS, ["part"])
    assert parts.count() == 12
    merged = {r["column"]: r for r in sk.profile(sk.merge_sketches(parts)).collect()}
    whole = {r["column"]: r for r in sk.profile(sk.sketch_rows(values, COLS)).collect()}
    for c in COLS:
        for f in ("n_rows", "n_values", "min", "max"):
            assert merged[c][f] == whole[c][f]
        assert merged[c]["distinct"] == whole[c]["distinct"]
        assert abs(merged[c]["mean"] - whole[c]["mean"]) < 1e-9
    half = sk.merge_sketches(parts.where("part < 2"))
    assert {r["column"]: r["n_rows"] for r in half.collect()} == dict.fromkeys(COLS, 10000)
    kept = sk.profile(sk.merge_sketches(parts, ["part"]))
    assert kept.columns[:2] == ["part", "column"] and kept.count() == 12


def test_errors_against_the_exact_profile(values):
    got = {r["column"]: r for r in sk.profile(sk.merge_sketches(sk.sketch_rows(values, COLS, ["part"]))).collect()}
    exact = {r["column"]: r for r in quality.profile_describe(values.select("a", "b")).collect()}
    for c in ("a", "b"):
        assert (got[c]["n_values"], got[c]["min"], got[c]["max"]) == (exact[c]["count"], exact[c]["min"], exact[c]["max"])
        assert abs(got[c]["mean"] - exact[c]["mean"]) < 1e-9
        xs = np.sort(np.array([r[0] for r in values.select(c).where(F.col(c).isNotNull()).collect()]))
        assert abs(got[c]["distinct"] - len(np.unique(xs))) <= sk.DISTINCT_ERROR * len(np.unique(xs))
        for q in sk.QUANTILES:
            x = got[c][f"q{int(q * 100)}"]
            assert np.searchsorted(xs, x, "left") <= (q + sk.RANK_ERROR) * len(xs)
            assert np.searchsorted(xs, x, "right") >= (q - sk.RANK_ERROR) * len(xs)
    assert (got["column"]["n_rows"], got["column"]["n_values"], got["column"]["distinct"]) == (20000, 18000, 1)


def test_no_values_and_no_rows(spark):
    nulls = spark.createDataFrame([(1, None), (2, float("nan"))], "part int, a double")
    for df, rows in ((nulls, 2), (nulls.limit(0), 0)):
        r = sk.profile(sk.merge_sketches(sk.sketch_rows(df, ["a"]))).first()
        assert (r.n_rows, r.n_values, r["mean"], r["min"], r["max"], r.distinct, r.q50) == (rows, 0, None, None, None, 0, None)
    assert sk.sketch_rows(nulls.limit(0), ["a"], ["part"]).count() == 0
    signed = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert sk.profile(sk.sketch_rows(signed, ["a"])).first().distinct == 1
