"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizations A and B of the same bytes are two ascending lists of token
ends. Merging them gives every pair of overlapping tokens (at each distinct
end, the A token and the B token that hold the byte before it) and the groups
(cut wherever both have an end). *Merge path*: on the grid of both lists the
cell where a merge stands after ``d`` steps lies on diagonal ``d`` and is found
by a binary search there, so the merge of any texts, however long, is cut into
pieces of equal work that need nothing from each other. A piece emits its
overlaps; a group open at a piece's border is closed by the next piece.

*Corpus counts.* Texts are tokenized and aligned in chunks of about
``CHUNK_BYTES``; a chunk folds its id pairs to distinct ones with their
counts. These go packed to buckets of the pair's hash, which add them up and
answer each chunk; the highest count of each B id, at most one number per entry
of B's vocabulary, is the only thing that is broadcast. No text is shuffled.

Results for odd input: a null or empty text, or one whose joined A or B bytes
differ from a space and the text (a text with U+2581), has no tokens: zeros and
an empty ``groups`` digest. Null ids stay null. Repeated rows are aligned each
for itself and count each. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import parts_for, stored
from .text import chunked, mix

CHUNK_BYTES = 2 << 20
#: merge steps of a piece
PIECE = 1 << 15
MIN_BUCKETS = 64
PAIR = np.dtype([("pair", "<u8"), ("n", "<u4")])
ANSWER = np.dtype([("b_id", "<u4"), ("total", "<i8")])
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


# ------------------------------------------------------------ merge path --

def diagonal_cuts(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal ``d``, how many of the first ``d`` merged elements come from ``a`` (ties: ``a`` first)."""
    d = np.asarray(diagonals, dtype=np.int64)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        first = a[mid] <= b[d[open_] - 1 - mid]
        lo[open_] = np.where(first, mid + 1, lo[open_])
        hi[open_] = np.where(first, hi[open_], mid)


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """The merge of ``a[i0:i1]`` and ``b[j0:j1]``: overlapping (A, B) indices in order, and the closed group ends.

    Each end that occurs gives one overlap: the tokens that hold the byte
    before it. Returns (A indices, B indices, A indices of the tokens that end
    where a B token ends).
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    other_b = j0 + np.searchsorted(own_b, own_a, "left")
    tied = b[np.minimum(other_b, len(b) - 1)] == own_a
    other_a = i0 + np.searchsorted(own_a, own_b, "right")
    alone = (other_a == 0) | (a[np.maximum(other_a - 1, 0)] != own_b)  # else the A end just before has emitted it
    at = np.concatenate((own_a, own_b[alone]))
    order = np.argsort(at, kind="stable")
    ia = np.concatenate((np.arange(i0, i1), other_a[alone]))[order]
    ib = np.concatenate((other_b, np.arange(j0, j1)[alone]))[order]
    return ia, ib, np.arange(i0, i1)[tied]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """All overlapping (A, B) token indices of two lists of ends with the same last end, and the groups' A ends.

    The merge is cut at every ``piece``-th diagonal; pieces run on their own
    and their outputs are put together, which stitches the groups that reach
    over a border, since a group is told by its end alone.
    """
    total = len(a) + len(b)
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    cuts = np.append(np.arange(0, total, piece), total)
    i = diagonal_cuts(a, b, cuts)
    j = cuts - i
    parts = [piece_overlaps(a, b, i[p], i[p + 1], j[p], j[p + 1]) for p in range(len(cuts) - 1)]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


# ------------------------------------------------------------ tokenizers --

def byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in [*zip(plain, plain), *((256 + k, b) for k, b in enumerate(rest))]}


class Tokenizers:
    """A (byte-level BPE) and B (BPE pieces) with the bytes of every id.

    Characters up to U+024F have been letters, digits or marks in the same way
    in every version of Unicode since 5.0, so for texts of these (without very
    long runs of white space) the faster library splits as the first one does;
    all other texts take the first one.
    """

    EXOTIC = re.compile(r"[^\x00-\u024f]|\s{1000}")

    def __init__(self, a_json: str, b_model: str, a_ranks: str | None = None, pattern: str | None = None) -> None:
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_json)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = [bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
                        for token, _ in vocabulary]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.fast = None
        if a_ranks:
            import base64

            import tiktoken
            with open(a_ranks, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            if all(self.a_bytes[r] == t for t, r in ranks.items()):
                self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        #: texts of ids with what follows them in a group: A then `,`, A then `|`, B then `,`, B then `;`
        self.shown = [f"{i},".encode() for i in range(n_a)] + [f"{i}|".encode() for i in range(n_a)] + \
            [f"{i},".encode() for i in range(n_b)] + [f"{i};".encode() for i in range(n_b)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        if self.fast:
            for k, t in enumerate(texts):
                if not self.EXOTIC.search(t):
                    out[k] = self.fast.encode_ordinary(t)
        slow = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(slow, self.a.encode_batch([texts[k] for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; no ids where one does not give a space and the text."""
        told = [k for k, t in enumerate(texts) if t]
        a, b = [[] for _ in texts], [[] for _ in texts]
        spaced = [" " + texts[k] for k in told]
        for k, text, x, y in zip(told, spaced, self.encode_a(spaced),
                                 self.b.encode([texts[k] for k in told], num_threads=1)):
            raw = text.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y)):
                a[k], b[k] = x, y
        return a, b


_LOADED: dict[tuple, Tokenizers] = {}


def loaded(*files) -> Tokenizers:
    """The tokenizers, once per Python worker."""
    if files not in _LOADED:
        _LOADED[files] = Tokenizers(*files)
    return _LOADED[files]


# ----------------------------------------------------------------- chunks --

def align_texts(tok: Tokenizers, texts: list[str], piece: int = PIECE):
    """Alignment of several texts at once, as if they were one.

    Returns per text (n_a, n_b, n_groups, n_links, digest), and for all links
    in order the pairs of ids (B id in the high half).
    """
    ids_a, ids_b = tok.encode(texts)
    n_a = np.array([len(x) for x in ids_a], dtype=np.int64)
    n_b = np.array([len(x) for x in ids_b], dtype=np.int64)
    flat_a = np.fromiter((i for x in ids_a for i in x), dtype=np.int64, count=int(n_a.sum()))
    flat_b = np.fromiter((i for x in ids_b for i in x), dtype=np.int64, count=int(n_b.sum()))
    ends_a, ends_b = np.cumsum(tok.a_size[flat_a]), np.cumsum(tok.b_size[flat_b])
    ia, ib, closed = overlaps(ends_a, ends_b, piece)
    pairs = flat_b[ib].astype(np.uint64) << np.uint64(32) | flat_a[ia].astype(np.uint64)
    first_a, first_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
    group_a = np.searchsorted(closed, np.arange(len(flat_a)))  # the group of each token
    group_ends_b = np.searchsorted(ends_b, ends_a[closed]) + 1
    group_b = np.searchsorted(group_ends_b, np.arange(len(flat_b)), "right")
    n_links = np.diff(np.searchsorted(ia, first_a))
    n_groups = np.diff(np.searchsorted(closed, first_a))
    # both token lists interleaved by group, each id with the sign that follows it
    k_a, k_b = len(tok.a_size), len(tok.b_size)
    last_a = np.zeros(len(flat_a), dtype=np.int64)
    last_a[closed] = 1
    last_b = np.zeros(len(flat_b), dtype=np.int64)
    last_b[group_ends_b - 1] = 1
    text = np.zeros(len(flat_a) + len(flat_b), dtype=np.int64)
    before_b = np.concatenate(([0], group_ends_b))
    before_a = np.concatenate(([0], closed + 1))
    text[np.arange(len(flat_a)) + before_b[group_a]] = flat_a + k_a * last_a
    text[np.arange(len(flat_b)) + before_a[group_b + 1]] = 2 * k_a + flat_b + k_b * last_b
    shown = text.tolist()
    digests = []
    for k in range(len(texts)):
        part = shown[first_a[k] + first_b[k]:first_a[k + 1] + first_b[k + 1]]
        said = b"".join(map(tok.shown.__getitem__, part))[:-1]
        digests.append(hashlib.sha256(said).hexdigest() if part else "")
    return n_a, n_b, n_groups, n_links, digests, pairs


#: a chunk's rows: its texts (kind 0; data: index of each link's pair) and its distinct pairs by bucket (kind 1)
CHUNK = ("kind int, chunk long, bucket int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
         "digest string, data binary")


def pair_bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(pair.copy()) % np.uint64(buckets)).astype(np.int64)


def _chunk_rows(chunk: int, ids: list, texts: list[str], tok: Tokenizers, buckets: int):
    import pyarrow as pa
    n_a, n_b, n_groups, n_links, digests, pairs = align_texts(tok, texts)
    distinct, at, count = np.unique(pairs, return_inverse=True, return_counts=True)
    bucket = pair_bucket(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    link = place[at]
    cut = np.concatenate(([0], np.cumsum(n_links)))
    packed = np.zeros(len(distinct), dtype=PAIR)
    packed["pair"], packed["n"] = distinct[order], count[order]
    used, start = np.unique(bucket[order], return_index=True)
    stop = np.append(start[1:], len(packed))
    n, m = len(ids), len(used)
    none = [None] * m
    yield pa.RecordBatch.from_arrays([
        pa.array([0] * n + [1] * m, pa.int32()), pa.array([chunk] * (n + m), pa.int64()),
        pa.array([None] * n + used.tolist(), pa.int32()), pa.array(ids + none, pa.int64()),
        *(pa.array(x.tolist() + none, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
        pa.array(digests + none, pa.string()),
        pa.array([link[cut[k]:cut[k + 1]].tobytes() for k in range(n)]
                 + [packed[s:e].tobytes() for s, e in zip(start, stop)], pa.binary())],
        names=[c.split()[0] for c in CHUNK.split(", ")])


def _total_rows(batches) -> Iterator:
    """Buckets: the sum of each pair's counts, sent to every chunk that asked; and each B id's highest sum."""
    import pyarrow as pa
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
    if not rows:
        return
    asked = np.frombuffer(b"".join(r[2] for r in rows), dtype=PAIR)
    pair, at = np.unique(asked["pair"], return_inverse=True)
    total = np.bincount(at, weights=asked["n"]).astype(np.int64)
    b_id = (pair >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(b_id, prepend=-1))
    top = np.column_stack((b_id[first], np.maximum.reduceat(total, first)))
    cut = np.concatenate(([0], np.cumsum([len(r[2]) // PAIR.itemsize for r in rows])))
    back = np.zeros(len(asked), dtype=ANSWER)
    back["b_id"], back["total"] = b_id[at], total[at]
    answers = [back[cut[k]:cut[k + 1]].tobytes() for k in range(len(rows))]
    yield pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows] + [-1], pa.int32()), pa.array([r[1] for r in rows] + [-1], pa.int64()),
        pa.array(answers + [top.astype("<i8").tobytes()], pa.binary())], names=["bucket", "chunk", "data"])


def _tops(batches) -> Iterator:
    import pyarrow as pa
    for b in batches:
        for data in b.column(2).to_pylist():
            top = np.frombuffer(data, dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(top[:, 0]), pa.array(top[:, 1])], names=["b_id", "most"])


def align(docs: DataFrame, a_json: str, b_model: str, a_ranks: str | None = None, pattern: str | None = None,
          id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Groups, links and their corpus-wide counts of every text under tokenizers A and B.

    ``a_ranks`` and ``pattern`` name the same vocabulary as A in the faster
    library's form, if there is one. Returns RESULT columns: ``n_links`` is
    the number of overlapping token pairs, ``count_sum`` the sum over them of
    how often their id pair is linked in all texts, ``n_best`` those whose
    count is the highest of their B id.
    """
    files = (a_json, b_model, a_ranks, pattern)
    spark = docs.sparkSession
    buckets = max(MIN_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def chunks(batches):
        import pyarrow.compute as pc
        tok, task, number = loaded(*files), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunked(sizes, chunk_bytes):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield from _chunk_rows((task << 32) + number, ids, texts, tok, buckets)
                number += 1

    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(told.mapInArrow(chunks, CHUNK), "align-chunks", "kind")
    asked = rows.where("kind = 1").select("bucket", "chunk", "data")
    n_bytes = asked.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    totals = stored(asked.repartition(parts_for(n_bytes, spark), "bucket")
                    .mapInArrow(_total_rows, "bucket int, chunk long, data binary"), "align-totals")
    tops = totals.where("chunk < 0").mapInArrow(_tops, "b_id long, most long") \
        .groupBy("b_id").agg(F.max("most").alias("most")).collect()  # an entry of B's vocabulary each, at most
    most = np.zeros(max((r["b_id"] for r in tops), default=0) + 1, dtype=np.int64)
    for r in tops:
        most[r["b_id"]] = r["most"]
    shared = spark.sparkContext.broadcast(most)

    def finish(key, left, right):
        import pyarrow as pa
        got = sorted(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
        answer = np.frombuffer(b"".join(g[1] for g in got), dtype=ANSWER)
        total = answer["total"]
        best = (total == shared.value[answer["b_id"]]).astype(np.int64)
        sums = np.zeros((2, left.num_rows), dtype=np.int64)
        for k, data in enumerate(left.column("data").to_pylist()):
            link = np.frombuffer(data, dtype=np.uint32)
            sums[:, k] = best[link].sum(), total[link].sum()
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(c) for c in names), pa.array(sums[0]), pa.array(sums[1]),
                         left.column("digest")], names=[c.split()[0] for c in RESULT.split(", ")])

    answers = totals.where("chunk >= 0")
    texts = rows.where("kind = 0").drop("kind", "bucket")
    parts = parts_for(texts.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0, spark)
    return (texts.repartition(parts, "chunk").groupBy("chunk")
            .cogroup(answers.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(finish, RESULT))
