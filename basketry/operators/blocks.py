"""Block-sparse matrix (R3, R4, J12): rows of (row block, column block, CSR arrays).

A block lists the rows that have cells in it (``rows``), where each row's cells
start (``indptr``), and the cells' columns and values. No dense row and no
schema of matrix width exists anywhere: column sums, the transpose, products
and a network layer are grouped jobs over blocks.

Cells are packed into partial blocks where they are read, so the shuffle by
block moves packed arrays already added up; a task then folds the partial
blocks of one block after the other in a stream.

Cells of one position add up; null rows, columns and values are left out. Zero
cells may be stored or not, which changes no result. An empty table gives no
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "row_block int, col_block int, rows array<bigint>, indptr array<int>, cols array<bigint>, vals array<double>"
NAMES = ["row_block", "col_block", "rows", "indptr", "cols", "vals"]
ROWS_PER_BLOCK = 4096
COLS_PER_BLOCK = 512
#: cells that a fold holds before it adds equal positions up, and products that a kernel makes at a time
FOLD_CELLS = 1 << 20
KERNEL_CELLS = 1 << 21


def hashed(key: Column, n_blocks: int) -> Column:
    """Block of a key without an order, such as a user."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(n_blocks)).cast("int")


def ranged(index: Column, size: int = COLS_PER_BLOCK) -> Column:
    """Block of a dense index: ranges of ``size``."""
    return F.floor(index / F.lit(size)).cast("int")


def blocks_for(rows: DataFrame, key: str, per_block: int = ROWS_PER_BLOCK) -> int:
    """How many hashed blocks hold about ``per_block`` keys each; any number gives right results."""
    return max(1, -(-int(rows.agg(F.approx_count_distinct(key)).first()[0]) // per_block))


def _added(row: np.ndarray, col: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in (row, column) order, one per position."""
    order = np.lexsort((col, row))
    row, col, val = row[order], col[order], val[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1])
    at = np.flatnonzero(new)
    return row[at], col[at], np.add.reduceat(val, at) if len(at) else val


def _batch(row_block: int, col_block: int, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
    """One block of ordered cells."""
    rows, first = np.unique(row, return_index=True)
    indptr = np.append(first, len(row)).astype(np.int32)
    def one(values, kind):
        return pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays([
        pa.array([row_block], pa.int32()), pa.array([col_block], pa.int32()), one(rows, pa.int64()),
        one(indptr, pa.int32()), one(col, pa.int64()), one(val, pa.float64())], names=NAMES)


def _csr(batch: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, indptr, cols, vals) of row ``i`` of an Arrow batch of blocks."""
    return tuple(batch.column(prefix + n)[i].values.to_numpy(zero_copy_only=False) for n in NAMES[2:])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial blocks of a stream ordered by (row block, column block)."""
    at, held, size = None, [], 0

    def added():
        return _added(*(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        for i in range(batch.num_rows):
            key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if key != at and held:
                yield _batch(*at, *added())
                held, size = [], 0
            at = key
            rows, indptr, cols, vals = _csr(batch, i)
            held.append((np.repeat(rows, np.diff(indptr)), cols, vals))
            size += len(cols)
            if size > FOLD_CELLS:
                held = [added()]
                size = len(held[0][0]) // 2  # add up again when half as many have come
    if held:
        yield _batch(*at, *added())


def fold(partial: DataFrame) -> DataFrame:
    """One row per block from partial blocks."""
    return (partial.repartition("row_block", "col_block").sortWithinPartitions("row_block", "col_block")
            .mapInArrow(_folded, BLOCK))


def to_blocks(cells: DataFrame, row: str, col: str, value: str, row_block: Column, col_block: Column) -> DataFrame:
    """The blocks of ``(row, col, value)`` cells; ``row_block`` and ``col_block`` say where a cell belongs."""
    def pack(batches):
        for batch in batches:
            rb, cb, r, c, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            order = np.lexsort((cb, rb))
            cuts = np.flatnonzero((np.diff(rb[order]) != 0) | (np.diff(cb[order]) != 0)) + 1
            for idx in np.split(order, cuts) if len(order) else []:
                yield _batch(int(rb[idx[0]]), int(cb[idx[0]]), *_added(r[idx], c[idx], v[idx]))

    rows = cells.where(f"`{row}` is not null and `{col}` is not null and `{value}` is not null").select(
        row_block.alias("row_block"), col_block.alias("col_block"), F.col(row).cast("long").alias("row"),
        F.col(col).cast("long").alias("col"), F.col(value).cast("double").alias("val"))
    return fold(rows.mapInArrow(pack, BLOCK))


def to_cells(blocks: DataFrame) -> DataFrame:
    """``(row, col, val)`` of every stored cell, without a shuffle."""
    per_row = blocks.select("indptr", "cols", "vals", F.posexplode("rows").alias("i", "row"))
    start, end = F.get("indptr", F.col("i")), F.get("indptr", F.col("i") + 1)
    cut = per_row.select("row", F.arrays_zip(F.slice("cols", start + 1, end - start).alias("col"),
                                             F.slice("vals", start + 1, end - start).alias("val")).alias("cells"))
    return cut.select("row", F.inline("cells").alias("col", "val"))


def transpose(blocks: DataFrame) -> DataFrame:
    """Rows and columns exchanged, block by block, without a shuffle."""
    def turn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, indptr, cols, vals = _csr(batch, i)
                yield _batch(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(),
                             *_added(cols, np.repeat(rows, np.diff(indptr)), vals))

    return blocks.mapInArrow(turn, BLOCK)


def column_sums(blocks: DataFrame) -> DataFrame:
    """``(col, total, n_cells)`` of every column: summed inside each block, then over blocks."""
    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, cols, vals = _csr(batch, i)
                col, inverse, n = np.unique(cols, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(col, pa.int64()), pa.array(np.bincount(inverse, vals, len(col)), pa.float64()),
                    pa.array(n, pa.int64())], names=["col", "total", "n"])

    return (blocks.mapInArrow(sums, "col long, total double, n long").groupBy("col")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n_cells")))


def _product(left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero cells of the product of two CSR blocks."""
    rows, indptr, cols, vals = left
    mid, indptr2, cols2, vals2 = right
    wide, inverse = np.unique(cols2, return_inverse=True)
    dense = np.zeros((len(mid), len(wide)))
    dense[np.repeat(np.arange(len(mid)), np.diff(indptr2)), inverse] = vals2
    where = np.minimum(np.searchsorted(mid, cols), len(mid) - 1)
    meets = mid[where] == cols
    of, where, vals = np.repeat(np.arange(len(rows)), np.diff(indptr))[meets], where[meets], vals[meets]
    out = np.zeros((len(rows), len(wide)))
    step = max(1, KERNEL_CELLS // max(len(wide), 1))
    for lo in range(0, len(of), step):
        part = of[lo:lo + step]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out[part[first]] += np.add.reduceat(vals[lo:lo + step, None] * dense[where[lo:lo + step]], first)
    r, c = np.nonzero(out)
    return rows[r], wide[c], out[r, c]


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """The blocks of ``left @ right``; columns of the one and rows of the other must be dealt alike.

    Every pair of blocks that meet is one kernel call; partial products are
    added up by their block.
    """
    other = right.select(*(F.col(n).alias(f"r_{n}") for n in NAMES))

    def kernel(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, col, val = _product(_csr(batch, i), _csr(batch, i, "r_"))
                if len(row):
                    yield _batch(batch.column("row_block")[i].as_py(), batch.column("r_col_block")[i].as_py(),
                                 row, col, val)

    return fold(left.join(other, left["col_block"] == other["r_row_block"]).mapInArrow(kernel, BLOCK))


def layer(blocks: DataFrame, weights: DataFrame, bias: list[float]) -> DataFrame:
    """``sigmoid(X W + b)`` as cells ``(row, col, val)`` for every row of ``blocks``.

    ``weights``: the blocks of W, its rows dealt as the columns of ``blocks``.
    """
    got = to_cells(multiply(blocks, weights)).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("found"))  # one cell per output column
    rows = blocks.select(F.explode("rows").alias("row")).distinct()
    every = rows.join(got, "row", "left").select("row", "found", F.posexplode(F.lit([float(b) for b in bias])))
    z = F.col("col") + F.coalesce(F.try_element_at("found", F.col("pos").cast("long")), F.lit(0.0))
    return every.select("row", F.col("pos").cast("long").alias("col"), (1 / (1 + F.exp(-z))).alias("val"))


def weight_blocks(spark, kernel: np.ndarray, rows_per_block: int = COLS_PER_BLOCK) -> DataFrame:
    """The blocks of a dense weight array, its rows dealt by ``ranged``."""
    r, c = np.indices(kernel.shape)
    cells = spark.createDataFrame(pa.table({"row": r.ravel(), "col": c.ravel(), "val": kernel.ravel()}))
    return to_blocks(cells, "row", "col", "val", ranged(F.col("row"), rows_per_block), ranged(F.col("col")))


def wide_range(blocks: DataFrame, lo: int, hi: int, key: str = "user_id", cols_per_block: int = COLS_PER_BLOCK) -> DataFrame:
    """The wide matrix's columns ``lo <= idx < hi`` as ``c<idx>``, absent = 0, for every row (R3 over a range).

    Only the blocks of the range are opened; the schema is as wide as the range.
    """
    rows = blocks.select(F.explode("rows").alias("row")).distinct()
    held = blocks.where(F.col("col_block").between(lo // cols_per_block, (hi - 1) // cols_per_block))
    wide = to_cells(held).where((F.col("col") >= lo) & (F.col("col") < hi)).groupBy("row").agg(
        *(F.sum(F.when(F.col("col") == i, F.col("val"))).alias(f"c{i}") for i in range(lo, hi)))
    return rows.join(wide, "row", "left").select(
        F.col("row").alias(key), *(F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(lo, hi)))
