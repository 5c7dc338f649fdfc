"""Best-fit packing into bins of several permitted sequence lengths.

Each document is its words and one end token; a document longer than the
largest bin is cut into pieces of that length, so no token is dropped. Pieces
are dealt by a hash to shards of bounded size, and each shard packs its own:
longest first, into the open bin that it fills best. If none has room, a bin
of the least cost per token among the permitted lengths is opened. The lengths
are optimised jointly: a shard packs once for each largest length that it may
open, downsizes every bin to the smallest permitted length that holds its
contents, and keeps the packing of the least total cost.

Cost of a bin of length C: ``overhead + C + quadratic * C * C``.

Only ids and lengths are shuffled, never texts. Null or empty text is the end
token alone. Repeated rows are packed each; null ids too. An empty table gives
no bins. Other columns are not read, so they may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ids_of

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD, QUADRATIC = 64.0, 1 / 16384
#: documents of a shard on average, and the least number of shards
SHARD_DOCS, MIN_SHARDS = 32768, 32
PACKED = "doc_id long, piece int, start long, length int, bin_id long, bin_start int, capacity int"


def bin_cost(capacity: float, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + capacity + quadratic * capacity * capacity


def best_fit(lengths: Sequence[int], capacities: Sequence[int], cost, opened: Sequence[int] = (),
             filled: Sequence[int] = ()) -> tuple[list[int], list[int]]:
    """(bin of each length, opened capacity of each bin); ``lengths`` descending, none over the largest capacity.

    ``opened`` bins are open already, ``filled`` so far.
    """
    rooms = sorted((c - n, b) for b, (c, n) in enumerate(zip(opened, filled)) if c > n)  # (room left, bin)
    opened = list(opened)
    where = []
    per_token = sorted(capacities, key=lambda c: cost(c) / c)
    for n in lengths:
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room = next(c for c in per_token if c >= n)
            b = len(opened)
            opened.append(room)
        where.append(b)
        if room > n:
            insort(rooms, (room - n, b))
    return where, opened


def pack_shard(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost=bin_cost):
    """(bin, offset in the bin, final capacity) per piece, of the cheapest of the joint packings."""
    capacities = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    longest_first = lengths[order].tolist()
    best = None
    for top in range(len(capacities)):
        where = np.empty(len(lengths), dtype=np.int64)
        # lengths over this policy's largest bin open the smallest that holds them
        split = int(np.searchsorted(-lengths[order], -capacities[top]))
        own = [next(c for c in capacities if c >= n) for n in longest_first[:split]]
        w, opened = best_fit(longest_first[split:], capacities[:top + 1], cost, own, longest_first[:split])
        where[order[:split]] = np.arange(split)
        where[order[split:]] = w
        fill = np.bincount(where, weights=lengths, minlength=len(opened)).astype(np.int64)
        final = np.array([capacities[bisect_left(capacities, f)] for f in fill.tolist()], dtype=np.int64)
        total = sum(cost(c) for c in final.tolist())
        if best is None or total < best[0]:
            best = (total, where, final)
    _, where, final = best
    by_bin = np.lexsort((np.arange(len(lengths)), -lengths, where))
    ends = np.cumsum(lengths[by_bin])
    starts = ends - lengths[by_bin]
    b = where[by_bin]
    new = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, dtype=bool)
    base = np.maximum.accumulate(np.where(new, starts, 0)) if len(b) else starts
    offset = np.empty(len(lengths), dtype=np.int64)
    offset[by_bin] = starts - base
    return where, offset, final[where] if len(where) else where


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD,
                   quadratic: float = QUADRATIC) -> DataFrame:
    """PACKED rows: every piece of every document, its bin, its place in it, and the bin's final length."""
    top = max(capacities)
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1)
        .cast("long").alias("n"))
    shards = max(MIN_SHARDS, -(-docs.count() // SHARD_DOCS))
    pieces = (sizes.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"),
                                                               F.floor((F.col("n") - 1) / F.lit(top)))).alias("p"))
              .select("doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * top).alias("start"),
                      F.least(F.col("n") - F.col("p") * top, F.lit(top)).cast("int").alias("length"))
              .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")))

    def pack(table):
        import pyarrow as pa
        keys = [table.column("length").to_numpy(), table.column("piece").to_numpy(),
                ids_of(table.column("doc_id").combine_chunks())]
        table = table.take(pa.array(np.lexsort(keys)))  # the same packing whatever the arrival order
        length = table.column("length").to_numpy().astype(np.int64)
        where, offset, capacity = pack_shard(length, capacities, lambda c: bin_cost(c, overhead, quadratic))
        base = table.column("shard")[0].as_py() << 32 if table.num_rows else 0
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"),
                         "start": table.column("start"), "length": table.column("length"),
                         "bin_id": pa.array(where + base, pa.int64()), "bin_start": pa.array(offset, pa.int32()),
                         "capacity": pa.array(capacity, pa.int32())})

    return pieces.groupBy("shard").applyInArrow(pack, PACKED)
