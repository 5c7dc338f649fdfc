"""Membership filters for key sets that are too large to broadcast.

A Bloom filter of the kept keys is built by aggregates (bits of each word or-ed
before the shuffle) into one array of bounded size and tested where the rows are
read, so most rows that a semi join would drop never reach its exchange; the
exact semi join follows. The result is that of the semi join alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 12              # about 0.5 % of the other keys pass
MAX_BITS = 1 << 26             # 8 MB: the most that is sent to every task


def bits_for(n_keys: int) -> int:
    """Bits of the filter: a power of two, 64 at least."""
    return max(64, 1 << (max(1, n_keys) * BITS_PER_KEY - 1).bit_length())


def _positions(key: Column, n_bits: int) -> list[Column]:
    """Bit positions of a key (text form, so that equal keys of any integer width agree)."""
    return [F.pmod(F.xxhash64(key.cast("string"), F.lit(i)), F.lit(n_bits)) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, n_bits: int) -> DataFrame:
    """One row with ``words``: the filter's bits as an array of 64-bit words."""
    bits = (keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), n_bits))).alias("at"))
            .select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    every = keys.sparkSession.range(n_bits // 64).withColumnRenamed("id", "word")
    return every.join(bits, "word", "left").agg(
        F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        .alias("cells")).select(F.col("cells.bits").alias("words"))  # n_bits / 64 words, whatever the input


def may_hold(words: Column, key: Column, n_bits: int) -> Column:
    """False only for keys that the filter's set does not hold."""
    test = F.lit(True)
    for at in _positions(key, n_bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, (at % 64).cast("int"))
        test = test & (bit.bitwiseAND(F.lit(1).cast("long")) == 1)
    return test


def rows_with_keys(rows: DataFrame, kept: DataFrame, key: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` whose key is in ``kept``: filtered as they are read, then by the exact semi join.

    Where the set needs more than ``max_bits``, the semi join stands alone. Null keys match nothing.
    """
    side = kept.select(key).distinct()
    n_bits = bits_for(int(kept.agg(F.approx_count_distinct(key)).first()[0]))
    if n_bits <= max_bits:
        words = bloom_filter(side, key, n_bits).scalar()
        rows = rows.where(may_hold(words, F.col(key), n_bits))
    return rows.join(side, key, "left_semi")
