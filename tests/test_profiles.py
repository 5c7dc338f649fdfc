"""Segment means, zero-filled top/bottom lists, matrix gates."""

import numpy as np
import pytest

from basketry.operators import matrix as mx
from basketry.operators import profiles as prof
from basketry.operators import quality as qual


def test_extremes_overlap_when_few_items(spark):
    means = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.2)], "cluster int, item string, mean double")
    universe = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item string")
    out = prof.ranked_items(means, universe, "item", 5, 5).collect()
    top = [r.item for r in sorted((r for r in out if r.end == "top"), key=lambda r: r.rank)]
    bottom = [r.item for r in sorted((r for r in out if r.end == "bottom"), key=lambda r: r.rank)]
    assert top == ["a", "b", "c", "d"]
    assert bottom == ["d", "c", "b", "a"]


def test_absent_items_fill_top_and_bottom(spark):
    universe = spark.createDataFrame([(f"p{i:02d}",) for i in range(30)], "item string")
    means = spark.createDataFrame([(0, "p07", 0.9), (0, "p20", 0.4), (1, "p00", 0.1)],
                                  "cluster int, item string, mean double")
    out = prof.ranked_items(means, universe, "item", 10, 5).collect()
    c0_top = [r.item for r in sorted((r for r in out if r.cluster == 0 and r.end == "top"), key=lambda r: r.rank)]
    assert c0_top == ["p07", "p20"] + [f"p{i:02d}" for i in range(9) if i != 7]
    c1_bottom = [r.item for r in sorted((r for r in out if r.cluster == 1 and r.end == "bottom"),
                                        key=lambda r: r.rank)]
    assert c1_bottom == ["p29", "p28", "p27", "p26", "p25"]


def test_segment_means_count_absent_as_zero(spark):
    values = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 2.0)],
                                   "user_id long, product_name string, value double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0)], "user_id long, cluster int")
    got = {r.product_name: r.mean for r in prof.segment_means(values, labels, "product_name").collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.5})


def test_duplicate_keys_found(spark):
    pairs = spark.createDataFrame([(1, "x", 10), (1, "x", 11), (2, "x", 10)],
                                  "user_id long, product_name string, product_id long")
    dup = mx.duplicate_keys(pairs).collect()
    assert [(r.user_id, r.n_items) for r in dup] == [(1, 2)]


def test_wide_pivot_fills_zero(spark):
    long = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "user_id long, product_name string, sticky double")
    wide = {r.user_id: r for r in mx.sticky_matrix(long).collect()}
    assert wide[1]["b"] == 0.0 and wide[2]["b"] == 0.25


def test_approximate_profiles_agree_on_small_data(spark):
    from basketry.operators import quality as qual
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(200)], "a long, b double")
    exact = {r.column: r.n_unique for r in qual.distinct_counts(df).collect()}
    approx = {r.column: r.n_unique for r in qual.distinct_counts(df, approx=True).collect()}
    assert exact == {"a": 7, "b": 200} and approx["a"] == 7
    ex = {r.column: (r.q25, r.q50, r.q75) for r in qual.profile_describe(df).collect()}
    ap = {r.column: (r.q25, r.q50, r.q75) for r in qual.profile_describe(df, approx=True).collect()}
    assert ex["b"] == pytest.approx((49.75, 99.5, 149.25))
    for e, a in zip(ex["b"], ap["b"]):
        assert abs(e - a) <= 1.0


def test_ranked_items_match_brute_force_on_random_inputs(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=8, deadline=None)
    @given(n_items=st.integers(1, 25), top=st.integers(1, 6), bottom=st.integers(0, 6),
           cells=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 24),
                                    st.floats(0.01, 1.0, allow_nan=False)), min_size=1, max_size=30))
    def check(n_items, top, bottom, cells):
        items = [f"i{j:02d}" for j in range(n_items)]
        means = {}
        for c, j, v in cells:
            means[(c, items[j % n_items])] = round(v, 4)
        mdf = spark.createDataFrame([(c, it, v) for (c, it), v in means.items()],
                                    "cluster int, item string, mean double")
        udf = spark.createDataFrame([(it,) for it in items], "item string")
        got = {(r.cluster, r.end, r.rank): (r.item, r.mean)
               for r in prof.ranked_items(mdf, udf, "item", top, bottom).collect()}
        want = {}
        for c in sorted({c for c, _ in means}):
            full = sorted(((means.get((c, it), 0.0), it) for it in items), key=lambda t: (-t[0], t[1]))
            for k, (m, it) in enumerate(full[:top], 1):
                want[(c, "top", k)] = (it, m)
            for k, (m, it) in enumerate(reversed(full[-bottom:] if bottom else []), 1):
                want[(c, "bottom", k)] = (it, m)
        assert got == want

    check()


def test_pivot_takes_any_name_and_refuses_duplicate_cells(spark):
    import pytest
    from basketry.operators import matrix as mx
    from basketry.plans.context import rounded
    long = spark.createDataFrame([(1, "Dr. Pepper", 0.5), (1, "a`b", 0.25), (2, None, 0.1), (3, "Dr. Pepper", 0.75)],
                                 "user_id long, product_name string, sticky double")
    rows = {r.user_id: r.asDict() for r in rounded(mx.sticky_matrix(long)).collect()}
    assert rows == {1: {"user_id": 1, "Dr. Pepper": 0.5, "a`b": 0.25}, 2: {"user_id": 2, "Dr. Pepper": 0.0, "a`b": 0.0},
                    3: {"user_id": 3, "Dr. Pepper": 0.75, "a`b": 0.0}}
    cells = mx.melt(mx.sticky_matrix(long), ["user_id"]).collect()
    assert len(cells) == 6 and sum(r.value for r in cells) == 1.5
    twice = long.union(spark.createDataFrame([(1, "Dr. Pepper", 0.9)], long.schema))
    with pytest.raises(Exception, match="duplicate"):
        mx.sticky_matrix(twice).collect()


def test_segment_without_cells_gets_its_zero_lists(spark):
    from basketry.operators import profiles as prof
    means = spark.createDataFrame([(0, "b", 0.5)], "cluster int, item string, mean double")
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    segments = spark.createDataFrame([(0,), (1,)], "cluster int")
    rows = prof.ranked_items(means, universe, "item", 2, 1, segments=segments).collect()
    got = {(r.cluster, r.end, r["rank"]): (r.item, r.mean) for r in rows}
    assert got == {(0, "top", 1): ("b", 0.5), (0, "top", 2): ("a", 0.0), (0, "bottom", 1): ("c", 0.0),
                   (1, "top", 1): ("a", 0.0), (1, "top", 2): ("b", 0.0), (1, "bottom", 1): ("c", 0.0)}


def test_quantiles_with_heavy_ties_and_few_bins(spark):
    import numpy as np
    import pytest
    from basketry.operators import quality as qual
    rng = np.random.default_rng(1)
    data = {"x": [5.0] * 300 + rng.normal(size=200).tolist(), "y": rng.random(101).tolist(), "z": [2.0], "w": [1.0, 1.0]}
    long = spark.createDataFrame([(c, v) for c, vs in data.items() for v in vs] + [("x", None)], "column string, value double")
    for bins in (1, 7, 4096):
        for r in qual.exact_quantiles(long, bins=bins).collect():
            assert r.q == pytest.approx(np.quantile(data[r.column], r.p)), (r, bins)


def test_describe_skips_nan_and_orders_infinities(spark):
    import pandas as pd
    inf, nan = float("inf"), float("nan")
    cols = {"a": [1.0, 2.0, 3.0, inf, nan, None], "b": [-inf, 4.0, nan, nan, None, 5.0], "c": [nan, nan, None, None, nan, nan],
            "d": [inf, inf, -inf, None, nan, 0.5]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    got = {r.column: r for r in qual.profile_describe(df).collect()}
    for c, v in cols.items():
        x = pd.Series(v, dtype="float64").dropna()
        assert got[c]["count"] == len(x)
        for q in (25, 50, 75):
            want, have = (x.quantile(q / 100, interpolation="linear") if len(x) else None), got[c][f"q{q}"]
            if len(x) and np.isfinite(want):
                assert have == want
    assert (got["a"].q25, got["a"].q50, got["a"].q75, got["a"].max) == (1.75, 2.5, inf, inf)
    assert (got["d"].min, got["d"].max, got["c"].q50, got["c"].max) == (-inf, inf, None, None)
