"""Block-sparse matrix against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import blocks as bk

SCHEMA = "user_id long, idx int, value double, rows string, vals int"


def dense_cells(rng, n, d, share=0.3):
    x = np.where(rng.random((n, d)) < share, rng.normal(size=(n, d)), 0.0)
    r, c = np.nonzero(x)
    return x, [(int(i), int(j), float(x[i, j]), "x", 1) for i, j in zip(r, c)]


def as_array(blocks, n, d):
    out = np.zeros((n, d))
    for r in bk.to_cells(blocks).collect():
        out[r.row, r.col] += r.val
    return out


def made(spark, cells, n_blocks=3, size=4):
    df = spark.createDataFrame(cells, SCHEMA).repartition(3)
    return bk.to_blocks(df, "user_id", "idx", "value", bk.hashed(F.col("user_id"), n_blocks), bk.ranged(F.col("idx"), size))


@pytest.fixture(scope="module")
def matrix(spark):
    x, cells = dense_cells(np.random.default_rng(3), 37, 11)
    return x, cells, made(spark, cells).cache()


def test_round_trip_transpose_and_sums(matrix):
    x, _, blocks = matrix
    assert blocks.count() == blocks.select("row_block", "col_block").distinct().count() <= 9
    assert np.array_equal(as_array(blocks, *x.shape), x)
    assert np.array_equal(as_array(bk.transpose(blocks), *x.T.shape), x.T)
    sums = {r.col: (r.total, r.n_cells) for r in bk.column_sums(blocks).collect()}
    assert {c: n for c, (_, n) in sums.items()} == {c: int((x[:, c] != 0).sum()) for c in range(11)}
    assert np.allclose([sums[c][0] for c in range(11)], x.sum(axis=0))


@pytest.mark.parametrize("kernel", [1, 1 << 21])
def test_products(spark, matrix, monkeypatch, kernel):
    monkeypatch.setattr(bk, "KERNEL_CELLS", kernel)
    x, _, blocks = matrix
    assert np.allclose(as_array(bk.multiply(bk.transpose(blocks), blocks), 11, 11), x.T @ x)
    w = np.random.default_rng(4).normal(size=(11, 5))
    assert np.allclose(as_array(bk.multiply(blocks, bk.weight_blocks(spark, w, 4)), 37, 5), x @ w)


def test_layer_covers_rows_that_only_have_zero_cells(spark, matrix):
    x, cells, _ = matrix
    x = np.vstack([x, np.zeros(11)])
    blocks = made(spark, cells + [(37, 2, 0.0, None, None)])
    w, b = np.random.default_rng(5).normal(size=(11, 3)), [0.1, -0.2, 0.3]
    got = {(r.row, r.col): r.val for r in bk.layer(blocks, bk.weight_blocks(spark, w, 4), b).collect()}
    rows = sorted({r for r, _ in got})
    assert 37 in rows and len(got) == 3 * len(rows)
    want = 1 / (1 + np.exp(-(x @ w + b)))
    assert all(abs(got[r, c] - want[r, c]) < 1e-12 for r, c in got)


def test_column_range_of_the_wide_matrix(matrix):
    x, cells, blocks = matrix
    got = bk.wide_range(blocks, 3, 9, cols_per_block=4)
    assert got.columns == ["user_id", *(f"c{i}" for i in range(3, 9))]
    rows = {r.user_id: list(r)[1:] for r in got.collect()}
    assert set(rows) == {c[0] for c in cells}
    assert all(np.allclose(v, x[u, 3:9]) for u, v in rows.items())


@pytest.mark.parametrize("fold", [2, 1 << 20])
def test_repeats_add_up_nulls_go_and_empty_stays_empty(spark, monkeypatch, fold):
    monkeypatch.setattr(bk, "FOLD_CELLS", fold)
    cells = [(1, 0, 1.0, "", 0)] * 9 + [(1, 1, 2.0, "", 0), (None, 1, 1.0, "", 0), (2, None, 1.0, "", 0), (2, 1, None, "", 0),
                                        (-5, 7, 4.0, "", 0)]
    got = sorted(map(tuple, bk.to_cells(made(spark, cells)).collect()))
    assert got == [(-5, 7, 4.0), (1, 0, 9.0), (1, 1, 2.0)]
    none = made(spark, [])
    assert none.count() == bk.to_cells(none).count() == bk.column_sums(none).count() == bk.multiply(none, none).count() == 0
    assert bk.blocks_for(spark.createDataFrame([], SCHEMA), "user_id") == 1


def test_cells_and_transpose_need_no_exchange(matrix):
    _, _, blocks = matrix
    assert "Exchange" not in bk.to_cells(bk.transpose(blocks))._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
