"""Texts as NumPy arrays: words, word hashes and rolling hashes.

A run of texts is laid out in one byte array; word borders come from a
256-entry table of separator bytes, and every word gets a 64-bit hash: its
blocks of eight bytes, each mixed with its number, are added up and mixed with
the length, so no Python code runs per word and no pair of words collides by
the form of the hash. All separators are ASCII, so UTF-8 bytes give the same words as
characters would.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
BLOCK_SALT = U64(0x9E3779B97F4A7C15)
WORD_BASE = 0xD1342543DE82EF95 | 1
CHECK_BASE = 0xAF251AF3B0F025B5 | 1
CHUNK_BYTES = 1 << 20


def _table(pattern_ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes that belong to words, False for the separator ranges given."""
    t = np.ones(256, dtype=bool)
    for lo, hi in pattern_ranges:
        t[lo:hi + 1] = False
    return t


#: words are runs without ASCII white space
SPACE_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)])
#: words are runs of digits, letters a-z and non-ASCII characters (after lower-casing)
ALNUM_WORDS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.random.RandomState(20240607).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(U64) | U64(1)
#: the bytes of a little-endian block that belong to a word of which so many are left
BLOCK_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept per process)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have[0]))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Words:
    """The words of several texts: byte borders in ``buf`` and, per text, the first word's index."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_texts + 1
    text_at: np.ndarray  # byte offset of each text in buf, n_texts + 1
    hash: np.ndarray | None

    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[bytes], table: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    """Words of ``texts`` (bytes each, no None). A space separates the texts in the buffer."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    low = LOWER[buf] if lower else buf
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=at[1:])
    inside = table[low]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]  # the buffer ends with a separator
    first = np.searchsorted(start, at)
    return Words(buf, start, end, first, at, word_hashes(low, start, end) if hashed else None)


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of every word (none is empty)."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    n = end - start
    blocks = (n + 7) >> 3
    if int(blocks.max()) == 1:
        at, left, number = start, n, U64(0)
    else:
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        at = np.repeat(start, blocks) + 8 * number
        left = np.minimum(np.repeat(end, blocks) - at, 8)
        number = number.astype(U64)
    padded = np.concatenate((low, np.zeros(8, dtype=np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
    value = np.ascontiguousarray(eight).view("<u8").ravel() & BLOCK_MASK[left]
    value = mix(value + (number + U64(1)) * BLOCK_SALT)
    if int(blocks.max()) > 1:
        value = np.add.reduceat(value, first)
    return mix(value ^ n.astype(U64) * U64(0xD6E8FEB86659FD93))


def rolling(values: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive values (len - k + 1 of them)."""
    n = len(values)
    if n < k:
        return np.zeros(0, dtype=U64)
    pw, inv = powers(base, n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * pw[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inv[:n - k + 1])


def runs_inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For every run start 0..n-k: does the run of ``k`` words stay inside one text?"""
    if n < k:
        return np.zeros(0, dtype=bool)
    last = np.repeat(first[1:], np.diff(first))[:n - k + 1]
    return np.arange(n - k + 1) + k <= last


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [v if v is not None else b"" for v in column.to_pylist()]


def chunked(sizes: Iterable[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to at most ``limit`` (a larger single item stands alone)."""
    lo = total = i = 0
    for i, s in enumerate(sizes, 1):
        if total and total + s > limit:
            yield lo, i - 1
            lo, total = i - 1, 0
        total += s + 1
    if i > lo:
        yield lo, i
