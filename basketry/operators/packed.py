"""Rows of a task packed into arrays, for loops that read the same rows many times.

A row of a packed table holds a chunk of up to ``CHUNK_ROWS`` consecutive rows of
its task: their keys, and either dense vectors of one length or sparse ones
(where each row starts, its indices and its values), as the bytes of NumPy
arrays. A pass over it makes no Python object per row. Training and validation
rows lie in chunks of their own, each in the task's order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

CHUNK_ROWS = 4096
CHUNK_CELLS = 1 << 17         # cells of a chunk (1 MB of values)
DENSE_CELLS = 4_000_000       # at most this many dense cells (32 MB) per NumPy block
PACKED = "train boolean, width int, keys binary, starts binary, indices binary, vals binary"
COLUMNS = ["train", "width", "keys", "starts", "indices", "vals"]


@dataclass
class Rows:
    """``values``: rows x width if ``starts`` is None, else the cells of all rows, row i's from ``starts[i]``."""

    keys: np.ndarray | None
    starts: np.ndarray | None
    indices: np.ndarray | None
    values: np.ndarray
    train: bool = True

    def __len__(self) -> int:
        return len(self.values) if self.starts is None else len(self.starts) - 1

    def part(self, lo: int, hi: int) -> Rows:
        hi = min(hi, len(self))
        keys = None if self.keys is None else self.keys[lo:hi]
        if self.starts is None:
            return Rows(keys, None, None, self.values[lo:hi], self.train)
        a, b = self.starts[lo], self.starts[hi]
        return Rows(keys, self.starts[lo:hi + 1] - a, self.indices[a:b], self.values[a:b], self.train)

    def dense(self, d: int) -> np.ndarray:
        if self.starts is None:
            return self.values
        x = np.zeros((len(self), d))
        x[np.repeat(np.arange(len(self)), np.diff(self.starts)), self.indices] = self.values
        return x

    def blocks(self, d: int) -> Iterator[np.ndarray]:
        """Dense blocks of at most ``DENSE_CELLS`` cells."""
        step = max(1, DENSE_CELLS // max(d, 1))
        for lo in range(0, len(self), step):
            yield self.part(lo, lo + step).dense(d)


def rows_of(pdf: pd.DataFrame, train: bool = True) -> Rows:
    """A frame with ``latent``, or ``indices`` and ``values`` (and perhaps ``user_id``), as arrays."""
    keys = pdf["user_id"].to_numpy().astype(np.int64) if "user_id" in pdf else None
    if "latent" in pdf:
        x = np.stack(pdf["latent"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))
        if x.ndim != 2:
            raise ValueError("a row without a vector")
        return Rows(keys, None, None, x, train)
    starts = np.append(0, np.cumsum(pdf["indices"].map(len).to_numpy(dtype=np.int64)))
    if not starts[-1]:
        return Rows(keys, starts, np.zeros(0, dtype=np.int32), np.zeros(0), train)
    return Rows(keys, starts, np.concatenate(pdf["indices"].to_numpy()).astype(np.int32),
                np.concatenate(pdf["values"].to_numpy()).astype(float), train)


def split_rows(pdf: pd.DataFrame) -> Iterator[Rows]:
    """The training and the validation rows of a frame with ``split``; without it all rows train."""
    if "split" not in pdf:
        if len(pdf):
            yield rows_of(pdf)
        return
    training = (pdf["split"] == "train").to_numpy()
    for train in (False, True):
        if (training == train).any():
            yield rows_of(pdf[training == train], train)


def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task as chunks (``PACKED``)."""
    for pdf in batches:
        for rows in split_rows(pdf):
            lo = 0
            while lo < len(rows):
                hi = _end(rows, lo)
                c = rows.part(lo, hi)
                none = c.starts is None
                yield pd.DataFrame({
                    "train": [c.train], "width": [c.values.shape[1] if none else -1],
                    "keys": [b"" if c.keys is None else c.keys.tobytes()],
                    "starts": [None if none else c.starts.tobytes()],
                    "indices": [None if none else c.indices.tobytes()], "vals": [c.values.tobytes()]})
                lo = hi


def _end(rows: Rows, lo: int) -> int:
    if rows.starts is None:
        return min(len(rows), lo + max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(rows.values.shape[1], 1))))
    full = int(np.searchsorted(rows.starts, rows.starts[lo] + CHUNK_CELLS, side="right")) - 1
    return min(len(rows), lo + CHUNK_ROWS, max(full, lo + 1))


def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[Rows]:
    """The chunks of a packed table's rows."""
    for pdf in batches:
        for train, width, keys, starts, indices, vals in zip(*(pdf[c] for c in COLUMNS)):
            values = np.frombuffer(vals)
            keys = np.frombuffer(keys, dtype=np.int64)
            if width >= 0:
                yield Rows(keys, None, None, values.reshape(-1, int(width)), bool(train))
            else:
                yield Rows(keys, np.frombuffer(starts, dtype=np.int64), np.frombuffer(indices, dtype=np.int32), values,
                           bool(train))


def joined(held: list[Rows]) -> Rows:
    """Chunks after one another; their keys are left out."""
    if len(held) == 1:
        return held[0]
    if held[0].starts is None:
        return Rows(None, None, None, np.concatenate([h.values for h in held]), held[0].train)
    sizes = np.concatenate([np.diff(h.starts) for h in held])
    return Rows(None, np.append(0, np.cumsum(sizes)), np.concatenate([h.indices for h in held]),
                np.concatenate([h.values for h in held]), held[0].train)


def minibatches(chunks: Iterator[Rows], n: int) -> Iterator[Rows]:
    """The rows of a task in mini-batches of ``n``, across chunks."""
    held: list[Rows] = []
    rows = 0
    for chunk in chunks:
        at = 0
        while at < len(chunk):
            take = chunk.part(at, at + n - rows)
            at += len(take)
            held.append(take)
            rows += len(take)
            if rows == n:
                yield joined(held)
                held, rows = [], 0
    if rows:
        yield joined(held)
