"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold; the result has one row per document with its component.

*Order.* Shingles are ordered by an estimate of how many documents hold them
(a counter table of fixed size, summed over all documents), rarest first, ties
by hash. Any total order gives the same links; a good one keeps prefixes rare.

*Adaptive prefixes.* Sets that reach the threshold share at least ``l`` of
their first ``n - overlap + l`` shingles. Each document takes the ``l`` of
least estimated cost: longer prefixes meet more postings, but fewer documents
share ``l`` of them and need verification. A pair is verified only when it
shares the smaller ``l`` of the two, with the positions leaving room for the
required overlap.

*No pairs within a group.* Equal sets fold to one representative. Then each
document is first verified against one pivot only, the member of its posting
lists that stands earliest in them (the centre of a group of near copies has
no rare shingles of its own). Verified links give components, and candidate
pairs are formed only between different components, the postings of the
pivot's component standing on one side. Links within a component can no longer
change it, so no link between different texts is lost.

Null text, or text without words: an empty set, linked with nothing. Texts of
fewer words than a shingle form one shingle. Repeated rows of one id give one
row each. Rows are told apart by their sets, not their ids: unequal texts of
one id, or of rows without an id, each have the class of what they hold. A
class whose ids are all null has a null component. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import bucket_of, buckets_for, cut_by_bucket, parts_for, stored, text_bytes
from .text import SPACE_WORDS, U64, as_bytes, chunked, rolling, words_of

#: counters of the frequency estimate (2**SKETCH_BITS of four bytes), whatever the input's size
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
MAX_MATCHES = 8
#: cost of verifying a candidate, per shingle, against one posting met
VERIFY_COST = 0.02
#: estimated holders from which a shingle's postings are dealt by document as well
HOT_POSTINGS = 4096
#: ``doc``: the first half of the set's digest
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("need", "<i4")])
LIVE = "token long, doc long, n int, pos int, need int"


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z lower-cased)."""
    out: list[np.ndarray] = []
    for lo, hi in chunked(map(len, texts)):
        w = words_of(texts[lo:hi], SPACE_WORDS, lower=True)
        grams = rolling(w.hash, k)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= k:
                out.append(np.unique(grams[a:b - k + 1]))
            elif b > a:
                out.append(rolling(w.hash[a:b], int(b - a)) ^ U64(0x5851F42D4C957F2D * int(b - a) % 2**64))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out


def _overlap(pct: int, n: int, m: int) -> int:
    """Least intersection of sets of n and m at pct per cent similarity."""
    return -(-pct * (n + m) // (100 + pct))


def choose_prefix(cost_of: np.ndarray, n: int, pct: int) -> tuple[int, int]:
    """(prefix length, matches needed) of least estimated cost; ``cost_of``: estimated other holders, in order.

    Postings are counted in the prefix against sets of the same size: what
    stands after it can only match smaller sets.
    """
    least = -(-pct * n // 100)
    base, short = n - least, n - _overlap(pct, n, n)
    sums = np.cumsum(cost_of)
    best, need = None, 1
    for l in range(1, min(MAX_MATCHES, least) + 1):
        met = float(sums[short + l - 1])
        cost = met + VERIFY_COST * n * met / l
        if best is None or cost < best:
            best, need = cost, l
    return base + need, need


def sketch(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many documents hold the shingles of each counter, over all documents."""
    size = 1 << SKETCH_BITS

    def count(batches):
        import pyarrow as pa
        total = np.zeros(size, dtype=np.int32)
        for batch in batches:
            for s in _sliced(batch.column(0)):
                sets = shingle_sets(s, k)
                if sets:
                    total += np.bincount((np.concatenate(sets) >> U64(64 - SKETCH_BITS)).astype(np.int64),
                                         minlength=size).astype(np.int32)
        blocks = total.reshape(-1, SKETCH_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()),
                                          pa.array([b.tobytes() for b in blocks], pa.binary())],
                                         names=["block", "data"])

    def add(batches):
        import pyarrow as pa
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data, dtype=np.int64 if len(data) == 8 * SKETCH_BLOCK else np.int32)
                total[block] = total[block] + part if block in total else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([t.tobytes() for t in total.values()], pa.binary())],
                                         names=["block", "data"])

    blocks = size // SKETCH_BLOCK
    rows = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "block int, data binary")
            .repartition(blocks, "block").mapInArrow(add, "block int, data binary").collect())
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["block"] * SKETCH_BLOCK:(r["block"] + 1) * SKETCH_BLOCK] += np.frombuffer(r["data"], dtype=np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _sliced(column, limit: int = 8 << 20):
    """A text column as lists of bytes of bounded size."""
    texts = as_bytes(column)
    for lo, hi in chunked(map(len, texts), limit):
        yield texts[lo:hi]


def _postings(docs: DataFrame, counts, background: int, pct: int, k: int, buckets: int, parts: int) -> DataFrame:
    """Prefix postings of all documents whose shingle some other set holds too: LIVE rows."""

    def emit(batches):
        import pyarrow as pa
        table = counts.value
        for batch in batches:
            texts = as_bytes(batch.column(0))
            out = []
            seen: set[bytes] = set()
            for lo, hi in chunked(map(len, texts), 8 << 20):
                for s in shingle_sets(texts[lo:hi], k):
                    sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if not len(s) or sig in seen:  # equal sets of a batch fold to the first
                        continue
                    seen.add(sig)
                    held = table[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((s, held))
                    s, held = s[order], held[order]
                    length, need = choose_prefix(np.maximum(held - background, 0), len(s), pct)
                    p = np.empty(length, dtype=POSTING)
                    p["token"], p["doc"], p["n"] = s[:length], int.from_bytes(sig[:8], "little", signed=True), len(s)
                    p["pos"], p["need"] = np.arange(length), need
                    out.append((p, held[:length] - background >= HOT_POSTINGS))
            rows = []
            if out:
                p, hot = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                cold, h = p[~hot], p[hot]
                for bucket, i in cut_by_bucket(cold["token"], buckets):
                    rows.append((bucket, 0, cold[i].tobytes()))
                salt = bucket_of(h["doc"].astype(U64) * U64(0x9E3779B97F4A7C15), buckets)
                for bucket in np.unique(salt):
                    rows.append((int(bucket), 1, h[salt == bucket].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.binary())],
                                             names=["bucket", "hot", "data"])

    def shared(batches):
        import pyarrow as pa
        cold = [np.zeros(0, dtype=POSTING)]
        for batch in batches:
            hot = batch.column(1).to_numpy(zero_copy_only=False)
            for h, d in zip(hot, batch.column(2).to_pylist()):
                p = np.frombuffer(d, dtype=POSTING)
                if h:
                    yield _posting_rows(p, pa)
                else:
                    cold.append(p)
        p = np.concatenate(cold)
        p = p[np.argsort(p["token"], kind="stable")]
        live = np.zeros(len(p), dtype=bool)
        same = p["token"][1:] == p["token"][:-1]
        live[1:] |= same
        live[:-1] |= same
        yield _posting_rows(p[live], pa)

    return (docs.mapInArrow(emit, "bucket int, hot int, data binary").repartition(parts, "bucket")
            .mapInArrow(shared, LIVE))


def _posting_rows(p, pa):
    return pa.RecordBatch.from_arrays([
        pa.array(np.ascontiguousarray(p["token"]).view("<i8"), pa.int64()),
        pa.array(p["doc"], pa.int64()), pa.array(p["n"], pa.int32()), pa.array(p["pos"], pa.int32()),
        pa.array(p["need"], pa.int32())], names=["token", "doc", "n", "pos", "need"])


def _set_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc, content, n, half, sig) of every row: size, first half and whole of the 128-bit digest of its set.

    ``content`` is a hash of the text, by which a set's text is found again.
    """

    def info(batches):
        import pyarrow as pa
        for batch in batches:
            texts = as_bytes(batch.column(2))
            n, sig = [], []
            for lo, hi in chunked(map(len, texts), 8 << 20):
                for s in shingle_sets(texts[lo:hi], k):
                    n.append(len(s))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            half = np.frombuffer(b"".join(sig), dtype="<i8")[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                                              pa.array(half, pa.int64()), pa.array(sig, pa.binary())],
                                             names=["doc", "content", "n", "half", "sig"])

    return (docs.select("doc", F.xxhash64("text").alias("content"), "text")
            .mapInArrow(info, "doc long, content long, n long, half long, sig binary"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, pct: int, k: int, name: str) -> DataFrame:
    """The pairs (u, v) of sets that reach the threshold, by comparing the sets of their whole texts."""
    nodes = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    wanted = reps.join(nodes, "rep").select("rep", F.col("row.content").alias("content"), F.col("row.doc").alias("id"))
    # merged whatever the size of ``wanted``: the texts move once at every size, so the plan grows evenly
    hashed = docs.select(F.col("doc").alias("of"), F.xxhash64("text").alias("hash"), "text")
    same = (F.col("hash") == F.col("content")) & F.col("of").eqNullSafe(F.col("id"))
    texts = stored(hashed.join(wanted.hint("merge"), same)
                   .groupBy(F.col("rep").alias("doc")).agg(F.first("text").alias("text")), f"{name}-texts")
    both = (pairs.select("u", "v")
            .join(texts.select(F.col("doc").alias("u"), F.col("text").alias("a")), "u")
            .join(texts.select(F.col("doc").alias("v"), F.col("text").alias("b")), "v"))

    def verify(batches):
        import pyarrow as pa
        for batch in batches:
            a, b = as_bytes(batch.column("a")), as_bytes(batch.column("b"))
            keep = []
            for lo, hi in chunked((len(x) + len(y) for x, y in zip(a, b)), 8 << 20):
                for i, (x, y) in enumerate(zip(shingle_sets(a[lo:hi], k), shingle_sets(b[lo:hi], k)), lo):
                    if len(x) and len(y):
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * shared >= pct * (len(x) + len(y) - shared):
                            keep.append(i)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("u"), kept.column("v")], names=["u", "v"])

    return stored(both.mapInArrow(verify, "u long, v long"), f"{name}-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest linked doc_id."""
    spark = docs.sparkSession
    pct, k = percent, shingle
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = parts_for(text_bytes(rows), spark)
    buckets = buckets_for(parts, 512)
    held = sketch(rows, "text", k)
    counts = spark.sparkContext.broadcast(held)  # SKETCH_BITS bound its size
    background = int(np.median(held))

    sets = stored(_set_rows(rows, k), "jaccard-sets")
    # a number of its own for every set, fixed by writing it; ids come back in the last step
    reps = stored(sets.where("n > 0").groupBy("sig", "half", "n")
                  .agg(F.min("doc").alias("low"), F.min(F.struct(F.col("doc").isNull(), "content", "doc")).alias("row"))
                  .withColumn("rep", F.monotonically_increasing_id()), "jaccard-reps")

    live = _postings(rows.select("text"), counts, background, pct, k, buckets, parts)
    # sets that agree in half of their digest and in size share postings; their texts tell them apart
    postings = stored(
        live.join(reps.select(F.col("half").alias("doc"), "n", "rep"), ["doc", "n"])
        .groupBy("token", F.col("rep").alias("doc")).agg(F.first("n").alias("n"), F.min("pos").alias("pos"),
                                                         F.first("need").alias("need")), "jaccard-postings")
    counts.unpersist()

    # one pivot per posting list: the member that stands earliest in it
    pivots = stored(postings.groupBy("token").agg(F.min(F.struct("pos", "doc", "n", "need")).alias("p"),
                                                  F.count("*").alias("size")).where("size > 1")
                    .select("token", F.col("p.doc").alias("pivot"), F.col("p.pos").alias("pivot_pos"),
                            F.col("p.n").alias("pivot_n"), F.col("p.need").alias("pivot_need")), "jaccard-pivots")
    met = (postings.join(pivots, "token").where("doc != pivot")
           .where(_may_match(pct, "n", "pos", "need", "doc", "pivot_n", "pivot_pos", "pivot_need", "pivot"))
           .groupBy("doc", "pivot").agg(F.count("*").alias("met"), F.first(F.least("need", "pivot_need")).alias("need"))
           .where("met >= need"))
    best = (met.groupBy("doc").agg(F.max(F.struct("met", "pivot")).alias("b"))
            .select(F.col("doc").alias("u"), F.col("b.pivot").alias("v")))
    stars = _verified(stored(best, "jaccard-stars"), rows, reps, pct, k, "jaccard-star")
    first = components(stars, "jaccard-components")

    # candidate pairs between different components only
    placed = (postings.join(first.withColumnRenamed("node", "doc"), "doc", "left")
              .withColumn("component", F.coalesce("component", "doc")))
    main = (pivots.select("token", F.col("pivot").alias("doc"))
            .join(first.withColumnRenamed("node", "doc"), "doc", "left")
            .select("token", F.coalesce("component", "doc").alias("main")))
    split = stored(placed.join(main, "token").withColumn("aside", F.col("component") != F.col("main")),
                   "jaccard-split")
    busy = split.where("aside").select("token").distinct()
    other = split.join(busy, "token", "left_semi").select(
        "token", *(F.col(c).alias(f"o_{c}") for c in ("doc", "n", "pos", "need", "component", "aside")))
    pairs = (split.where("aside").join(other, "token")
             .where("component != o_component").where("not o_aside or doc < o_doc")
             .where(_may_match(pct, "n", "pos", "need", "doc", "o_n", "o_pos", "o_need", "o_doc"))
             .groupBy(F.least("doc", "o_doc").alias("u"), F.greatest("doc", "o_doc").alias("v"))
             .agg(F.count("*").alias("met"), F.first(F.least("need", "o_need")).alias("need"),
                  F.min(F.least(F.col("n") - F.col("pos"), F.col("o_n") - F.col("o_pos"))).alias("rest"),
                  F.first(F.col("n") + F.col("o_n")).alias("total"))
             .where("met >= need")
             .where(f"met + rest - 1 >= {_overlap_sql(pct, 'total')}"))
    links = _verified(stored(pairs.select("u", "v"), "jaccard-pairs"), rows, reps, pct, k, "jaccard-pair")
    linked = components(stars.union(links), "jaccard-components")

    placed = (reps.select("sig", "rep", "low").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    lowest = placed.groupBy("component").agg(F.min("low").alias("lowest"))
    named = placed.join(lowest, "component").select("sig", "lowest")
    return (sets.join(named, "sig", "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc")).alias("component_id")))


def _overlap_sql(pct: int, total: str) -> str:
    return f"(({pct} * {total} + {99 + pct}) div {100 + pct})"


def _may_match(pct: int, n: str, pos: str, need: str, doc: str, m: str, pos2: str, need2: str, doc2: str) -> str:
    """One of the first matches of a pair that may reach the threshold, by sizes and positions.

    The smaller set (ties: the smaller id) needs the shorter prefix of its
    overlap with a set of its own size or more.
    """
    def short(a, p, l):
        return f"{p} < {a} - {_overlap_sql(pct, f'(2 * {a})')} + {l}"
    small_first = f"({n} < {m} or ({n} = {m} and {doc} < {doc2}))"
    return (f"100 * least({n}, {m}) >= {pct} * greatest({n}, {m})"
            f" and case when {small_first} then {short(n, pos, need)} else {short(m, pos2, need2)} end"
            f" and least({n} - {pos}, {m} - {pos2}) >= {_overlap_sql(pct, f'({n} + {m})')}"
            f" - least({need}, {need2}, {pos} + 1, {pos2} + 1) + 1")
