"""Shared building blocks of the text operators.

*Slots.* Documents are dealt to slots by a hash of their id; a slot holds a
bounded amount of text, so a task can work on one slot at a time. The exchange
by slot is one shuffle of the text that Spark reuses for every branch of the
same query.

*Packed items.* Hashes are shuffled in packed binary rows (one row per slot and
bucket), not one row per hash: the shuffle then moves 8 to 20 bytes an item.
Each slot folds its own repeats first, so a hash that occurs everywhere
reaches its bucket once per slot at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: text bytes of a slot, and of a partition of the exchange
SLOT_BYTES = 1 << 20
PART_BYTES = 24 << 20
#: small tables are cut finer, into at most so many slots, so that dealing them by hash stays even
FINE_BYTES, FINE_SLOTS = 64 << 10, 1024


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder of the session."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = folder(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path) if not partition_by else \
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def parts_for(n_bytes: int, spark: SparkSession, part_bytes: int = PART_BYTES) -> int:
    """Partitions for so many bytes, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // part_bytes))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one aggregate over the whole column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()["b"] or 0)


def by_slot(docs: DataFrame, id_col: str, text_col: str, n_bytes: int,
            slot_bytes: int = SLOT_BYTES, fine_slots: int = FINE_SLOTS,
            null_by_text: bool = False) -> tuple[DataFrame, int, int]:
    """(slot, doc_id, text) dealt by slot, the number of partitions and of slots.

    ``null_by_text`` deals rows with a null id by their text, not all to one slot.
    """
    parts = parts_for(n_bytes, docs.sparkSession)
    slots = max(64, 2 * parts, -(-n_bytes // slot_bytes), min(fine_slots, n_bytes // FINE_BYTES))
    key = F.xxhash64(F.col(id_col))
    if null_by_text:
        key = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))).otherwise(key)
    dealt = docs.select(
        F.pmod(key, F.lit(slots)).cast("int").alias("slot"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return dealt.repartition(parts, "slot"), parts, slots


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash: its high bits, scaled."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cut_by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices into h) for every bucket that occurs; indices keep the order of ``h``'s sort by bucket."""
    b = bucket_of(h, buckets)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for idx in np.split(order, cuts) if len(order) else []:
        yield int(bucket_of(h[idx[:1]], buckets)[0]), idx


#: rows of one task's hash payloads: (bucket, slot, data)
PACKED = "bucket int, slot int, data binary"
MIN_BUCKETS = 512  # no more than there are slots
NULL_ID = np.iinfo(np.int64).max


def buckets_for(parts: int, slots: int) -> int:
    """Several buckets a partition, so that dealing them by hash stays even."""
    return max(min(MIN_BUCKETS, slots), 4 * parts)


def ids_of(column) -> np.ndarray:
    """Ids as int64; a null id orders after every other."""
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def slots_in(batch, id_index: int = 1):
    """(slot, row indices ordered by id) for every slot of an Arrow batch of (slot, doc_id, text)."""
    slot = batch.column(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids_of(batch.column(id_index)), slot))
    cuts = np.flatnonzero(np.diff(slot[order])) + 1
    for idx in np.split(order, cuts) if len(order) else []:
        yield int(slot[idx[0]]), idx


def packed_rows(batches_of):
    """An Arrow batch of PACKED rows from an iterable of (bucket, slot, bytes)."""
    import pyarrow as pa
    rows = list(batches_of)
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "slot", "data"])


def gather(batches, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All items of a partition of PACKED rows and the slot each came from."""
    items, slots = [], []
    for b in batches:
        data, slot = b.column(2).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        got = np.frombuffer(b"".join(data), dtype=dtype)
        items.append(got)
        slots.append(np.repeat(slot, [len(d) // dtype.itemsize for d in data]).astype(np.int32))
    if not items:
        return np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.int32)
    return np.concatenate(items), np.concatenate(slots)


def back_to_slots(slots: np.ndarray, values: np.ndarray, kind: int):
    """An Arrow batch (slot, kind, data) with the values of each slot packed together."""
    import pyarrow as pa
    order = np.argsort(slots, kind="stable")
    slots, values = slots[order], values[order]
    cuts = np.flatnonzero(np.diff(slots)) + 1
    groups = np.split(values, cuts) if len(values) else []
    firsts = slots[np.concatenate(([0], cuts))] if len(values) else slots[:0]
    return pa.RecordBatch.from_arrays([
        pa.array(firsts, pa.int32()), pa.array(np.full(len(firsts), kind), pa.int32()),
        pa.array([g.tobytes() for g in groups], pa.binary())], names=["slot", "kind", "data"])


RETURNED = "slot int, kind int, data binary"


def returned(table, kind: int, dtype) -> np.ndarray:
    """The values of one kind that came back to a slot (Arrow table of RETURNED rows)."""
    kinds = table.column("kind").to_pylist()
    data = table.column("data").to_pylist()
    return np.frombuffer(b"".join(d for k, d in zip(kinds, data) if k == kind), dtype=dtype)
