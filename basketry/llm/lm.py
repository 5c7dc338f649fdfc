"""Language-model scores by deleted interpolation.

The model mixes n-gram maximum-likelihood estimates of every order with a
uniform one: P(w | h) = sum_k weight[b][k] * c(h_k w) / c(h_k) + weight[b][0] / (V + 1),
where b is the frequency bucket (a power of two) of the longest context. The
weights of every bucket are learned by expectation-maximisation on *held-out
counts*: one fold of the training documents is deleted from the counts, and
its tokens are predicted from the rest.

Counts are exact and cover all training documents. A slot of documents sends
its distinct n-grams (64-bit hashes, sorted, as packed bytes) with their
counts to hash buckets and gets the corpus counts back in the order of its
request, so no count table is broadcast and a frequent n-gram arrives once per
slot. Orders of two and more keep 48 bits of their hash besides the bucket
(57 bits or more in all); first-order counts are exact to 64 bits. The EM
statistics are a histogram over context bucket and quarter-octave estimates,
bounded by its bins; the weights fitted to it are a scalar subquery of the
scoring plan, which shares the exchanges of texts and counts.

Tokens are the words of the text (A-Z lower-cased), then one end token.
Null text is empty and has the end token alone. A null id counts as text ''
for the folds. Repeated rows are counted and scored each. An empty table gives
an empty table; without training documents the estimate is uniform. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NULL_ID, by_slot, ids_of, stored, slots_in, text_bytes
from .text import SPACE_WORDS, U64, as_bytes, chunked, mix, words_of

BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
STEPS = 4  # bins an octave of the EM statistics
EM_ROUNDS = 60
SLOT_BYTES = 2 << 20  # larger slots send fewer repeated n-grams, and take more memory
EM_TOLERANCE = 1e-7
SENT = "bucket int, slot int, k int, n int, data binary"
BACK = "slot int, k int, bucket int, data binary"
STATS = ("doc_id long, held_out boolean, fold boolean, n_tokens long, n_known long, counts binary, "
         "fold_counts binary, vocabulary long, tokens long, docs long")


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None or doc_id == NULL_ID else str(int(doc_id)).encode()) % folds


def _planes(*columns: np.ndarray) -> bytes:
    """Unsigned 32-bit columns as byte planes (small numbers leave planes of zeros)."""
    return b"".join(np.ascontiguousarray(c.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)


def _columns(data: bytes, n: int, count: int) -> list[np.ndarray]:
    a = np.frombuffer(data, dtype=np.uint8).reshape(count, 4, n)
    return [np.ascontiguousarray(x.T).reshape(-1).view("<u4").astype(np.int64) for x in a]


def _key_planes(k: int) -> int:
    """Bytes kept of a key besides its bucket: a whole hash for single words, 48 bits for longer grams."""
    return 7 if k == 1 else 6


def _packed_keys(sorted_keys: np.ndarray, k: int) -> bytes:
    """Sorted keys of one bucket as byte planes of their differences."""
    low = (sorted_keys & U64((1 << 56) - 1)) >> U64(0 if k == 1 else 8)
    low[1:] -= low[:-1].copy()
    return low.view(np.uint8).reshape(-1, 8).T[:_key_planes(k)].tobytes()


def _unpacked_keys(data: bytes, n: int, k: int, bucket: int, shift: int) -> np.ndarray:
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[:, :_key_planes(k)] = np.frombuffer(data, dtype=np.uint8, count=_key_planes(k) * n).reshape(-1, n).T
    return (np.cumsum(raw.reshape(-1).view("<u8"), dtype=U64) << U64(0 if k == 1 else 8)) | (U64(bucket) << U64(shift))


class _Grams:
    """The n-grams of a slot's documents, one per token and order."""

    def __init__(self, texts: list[bytes], order: int):
        hashes, counts = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
        for a, b in chunked(map(len, texts)):
            w = words_of(texts[a:b], SPACE_WORDS, lower=True)
            hashes.append(w.hash)
            counts.append(w.n_words())
        n = np.concatenate(counts)
        self.first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(n + 1, out=self.first[1:])
        token = np.empty(int(self.first[-1]), dtype=U64)
        is_word = np.ones(len(token), dtype=bool)
        is_word[self.first[1:] - 1] = False
        token[is_word], token[~is_word] = np.concatenate(hashes), END
        self.text = np.repeat(np.arange(len(texts)), n + 1)
        place = np.arange(len(token)) - self.first[:-1][self.text]
        self.keys = [mix(token ^ U64(0x9E3779B97F4A7C15))]
        for k in range(2, order + 1):  # one context word more to the left
            back = np.full(len(token), BEGIN, dtype=U64)
            ok = place >= k - 1
            back[ok] = token[np.flatnonzero(ok) - (k - 1)]
            self.keys.append(mix(self.keys[-1] * U64(0xBF58476D1CE4E5B9) + mix(back + U64(k))))
        for k in range(1, order):
            self.keys[k] &= ~U64(255)


def _answers(rows: list, pa):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[j] for r in rows], kind) for j, kind in
         enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["slot", "k", "bucket", "data"])


def lm_counts(docs: DataFrame, id_col: str, text_col: str, order: int, folds: int, test_fold: int,
              em_fold: int) -> Callable[..., DataFrame]:
    """A function that gives STATS rows, or what ``then`` makes of those of a slot (an Arrow table).

    STATS: per document the corpus counts of its tokens' n-grams; rows without
    counts hold totals. Calls share their exchanges within a query.
    """
    dealt, parts, _ = by_slot(docs, id_col, text_col, text_bytes(docs, text_col), SLOT_BYTES, 64)
    buckets = 1 << max(8, (parts - 1).bit_length())  # a power of two: a key's high bits
    shift = 64 - (buckets.bit_length() - 1)  # at most 56, so the low 56 bits and the bucket are the whole key

    def request(batches):
        import pyarrow as pa
        for batch in batches:
            texts, ids = as_bytes(batch.column(2)), ids_of(batch.column(1))
            for slot, idx in slots_in(batch):
                rows = []
                g = _Grams([texts[i] for i in idx], order)
                fold = np.array([fold_of(i, folds) for i in ids[idx]])[g.text]
                train, em = fold != test_fold, fold == em_fold
                for k, keys in enumerate(g.keys, 1):
                    own, inv = np.unique(keys, return_inverse=True)
                    c = np.bincount(inv, weights=train, minlength=len(own))
                    f = np.bincount(inv, weights=em, minlength=len(own))
                    cut = np.searchsorted(own >> U64(shift), np.arange(buckets + 1, dtype=U64))
                    for b in np.flatnonzero(np.diff(cut)):
                        i = slice(cut[b], cut[b + 1])
                        rows.append((int(b), slot, k, int(cut[b + 1] - cut[b]),
                                     _packed_keys(own[i].copy(), k) + _planes(c[i], f[i])))
                del g, own, inv, c, f
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], kind) for j, kind in
                     enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["bucket", "slot", "k", "n", "data"])

    def answer(batches):
        import pyarrow as pa
        totals = np.zeros(2, dtype="<i8")

        def answered(bucket, own_rows):
            out = []
            for k in range(1, order + 1):
                asked = [(slot, n, data) for slot, kk, n, data in own_rows if kk == k]
                if not asked:
                    continue
                n = np.array([r[1] for r in asked])
                keys = np.concatenate([_unpacked_keys(d, m, k, bucket, shift) for _, m, d in asked])
                c, f = (np.concatenate(x) for x in zip(*(_columns(d[_key_planes(k) * m:], m, 2) for _, m, d in asked)))
                own, inv = np.unique(keys, return_inverse=True)
                c, f = np.bincount(inv, weights=c), np.bincount(inv, weights=f)
                if k == 1:
                    totals[:] += np.array([(c > 0).sum(), c.sum()]).astype("<i8")
                ends = np.cumsum(n)
                out += [(slot, k, bucket, _planes(c[inv[x:y]], f[inv[x:y]]))
                        for (slot, _, _), x, y in zip(asked, ends - n, ends)]
            return _answers(out, pa)

        held, now = [], None  # the requests come sorted by bucket: one bucket at a time
        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if held and bucket != now:
                    yield answered(now, held)
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield answered(now, held)
        yield _answers([(-1, 0, 0, totals.tobytes())], pa)

    def join(left, right):
        import pyarrow as pa
        rows = []
        ks, bs, data = (right.column(c).to_pylist() for c in ("k", "bucket", "data"))
        if not left.num_rows:
            total = np.sum([np.frombuffer(d, dtype="<i8") for d in data], axis=0)
            rows.append((None, None, None, None, None, None, None, int(total[0]), int(total[1]), None))
        else:
            ids = ids_of(left.column("doc_id").combine_chunks())
            order_ = np.argsort(ids, kind="stable")
            texts = as_bytes(left.column("text"))
            given = left.column("doc_id").to_pylist()
            g = _Grams([texts[i] for i in order_], order)
            train, fold = [], []
            for k, keys in enumerate(g.keys, 1):
                own, inv = np.unique(keys, return_inverse=True)
                got = sorted((b, d) for kk, b, d in zip(ks, bs, data) if kk == k)
                c, f = (np.concatenate(x) for x in zip(*(_columns(d, len(d) // 8, 2) for _, d in got)))
                train.append(c[inv])
                fold.append(f[inv])
            for j, i in enumerate(order_):
                a, b = g.first[j], g.first[j + 1]
                part = fold_of(ids[i], folds)
                rows.append((given[i], part == test_fold, part == em_fold, int(b - a),
                             int((train[0][a:b] > 0).sum()), _planes(*(t[a:b] for t in train)),
                             _planes(*(x[a:b] for x in fold)) if part == em_fold else b"", None, None,
                             int(part != test_fold)))
        names = ["doc_id", "held_out", "fold", "n_tokens", "n_known", "counts", "fold_counts", "vocabulary", "tokens",
                 "docs"]
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(),
                 pa.int64(), pa.int64()]
        return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(zip(names, kinds))})

    back = (dealt.mapInArrow(request, SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(answer, BACK))
    back = back.repartition(parts, "slot")

    def counted(then=lambda table: table, schema: str = STATS) -> DataFrame:
        def work(left, right):
            return then(join(left, right))
        return dealt.groupBy("slot").cogroup(back.groupBy("slot")).applyInArrow(work, schema)

    return counted


def _estimates(counts: list[np.ndarray], tokens: float, docs: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(context bucket per token, maximum-likelihood estimates of order 1 and up per token).

    The first token's context is the begin of a text, seen ``docs`` times;
    without ``docs`` its bucket is -2 and its estimates are its counts.
    """
    p = np.zeros((len(counts), len(counts[0])))
    if tokens > 0:
        p[0] = counts[0] / tokens
    context = np.empty(len(counts[0]))
    for k in range(1, len(counts)):
        context[0] = 1.0 if docs is None else docs
        context[1:] = counts[k - 1][:-1]
        np.divide(counts[k], context, out=p[k], where=context > 0)
    bucket = np.zeros(len(context), dtype=np.int64)
    seen = context > 0
    bucket[seen] = np.floor(np.log2(context[seen])).astype(np.int64) + 1
    if docs is None:
        bucket[0] = -2
    return bucket, p


def em_weights(bucket: np.ndarray, ratio: np.ndarray, events: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Mixture weights per bucket, and over all buckets.

    ``ratio`` holds each order's estimate over the uniform one (rows: order 0,
    which is 1, and up). Every weight keeps half an event of prior, so none is 0.
    """
    def fit(r: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(len(r), 1.0 / len(r))
        for _ in range(EM_ROUNDS):
            share = w[:, None] * r
            share /= share.sum(axis=0)
            new = (share * n).sum(axis=1) + 0.5
            new /= new.sum()
            if np.abs(new - w).max() < EM_TOLERANCE:
                return new
            w = new
        return w

    pooled = fit(ratio, events) if len(events) else np.full(len(ratio), 1.0 / len(ratio))
    return {int(b): fit(ratio[:, bucket == b], events[bucket == b]) for b in np.unique(bucket)}, pooled


def estimate_bins(x: np.ndarray) -> np.ndarray:
    """Quarter-octave bin of each number; 0 where it is 0."""
    out = np.zeros(x.shape, dtype=np.int64)
    some = x > 0
    out[some] = np.clip(np.rint(np.log2(x[some]) * STEPS), -200, 300).astype(np.int64) + 201
    return out


def bin_estimate(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** ((b - 201) / STEPS), 0.0)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, folds: int = 7,
              test_fold: int = 2, em_fold: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents of ``test_fold`` (crc32 of the id's text modulo ``folds``) are not
    learned from; those of ``em_fold`` are deleted from the counts while the
    weights are learned.
    """
    if order < 2:
        raise ValueError("the model needs an order of two or more")
    counted = lm_counts(docs, id_col, text_col, order, folds, test_fold, em_fold)

    def events(table):
        import pyarrow as pa
        total: dict[tuple, int] = {}
        heads = [0] * 5
        rows = zip(*(table.column(c).to_pylist() for c in
                     ("n_tokens", "counts", "fold_counts", "vocabulary", "tokens", "docs", "fold")))
        for t, c, f, v, n, d, fold in rows:
            for i, x in enumerate((v, n, d, t if fold else 0, int(bool(fold)))):
                heads[i] += x or 0
            if fold:
                left = [x - y for x, y in zip(_columns(c, t, order), _columns(f, t, order))]
                bucket, p = _estimates(left, 1.0, None)  # the totals are only known with all texts
                found, k = np.unique(np.vstack((bucket, estimate_bins(p))), axis=1, return_counts=True)
                for key, m in zip(map(tuple, found.T.tolist()), k.tolist()):
                    total[key] = total.get(key, 0) + m
        keys = [[-1, i] for i in range(5)] + [list(x) for x in total]
        return pa.table({"bins": pa.array(keys, pa.list_(pa.int64())),
                         "events": pa.array(heads + list(total.values()), pa.int64())})

    def fit(batches):
        import pyarrow as pa
        bins, count, heads = [], [], [0] * 5
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b[0] == -1:
                    heads[b[1]] += n
                else:
                    bins.append(b)
                    count.append(n)
        yield pa.RecordBatch.from_arrays([pa.array([fitted(bins, count, heads, order)], pa.binary())], names=["model"])

    seen = counted(events, "bins array<long>, events long").groupBy("bins").agg(F.sum("events").alias("events"))
    # one row per bin at most: a bounded table, fitted in one place
    model = seen.coalesce(1).mapInArrow(fit, "model binary")

    def score(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.frombuffer(batch.column(5)[0].as_py(), dtype=np.float64)
            n, v, d, table = head[0], head[1], head[2], head[3:].reshape(-1, order + 1)
            base, full = [], []
            for t, c in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                counts = _columns(c, t, order)
                base.append(float(np.log10((counts[0] + 1.0) / (n + (v + 1.0))).sum()))
                bucket, p = _estimates(counts, n, d)
                w = table[bucket]
                full.append(float(np.log10(w[:, 0] / (v + 1.0) + (w[:, 1:] * p.T).sum(axis=1)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                 pa.array([int(n)] * len(base), pa.int64()), pa.array(base, pa.float64()),
                 pa.array(full, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (counted().where(F.col("counts").isNotNull())
            .select("doc_id", "held_out", "n_tokens", "n_known", "counts", model.scalar().alias("model"))
            .mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double"))


def fitted(bins: list, count: list, heads: list, order: int) -> bytes:
    """(train tokens, vocabulary, train documents, weights by bucket 0 to 64) as doubles.

    A histogram bin is (bucket, bin of the count of order 1, bins of the
    estimates of the orders above); a begin context has bucket -2.
    """
    v, n, d, fold_n, fold_d = (float(x) for x in heads)
    uniform = 1.0 / (v + 1.0)
    b = np.array(bins, dtype=np.int64).reshape(len(bins), order + 1)
    ratio = np.vstack((np.ones(len(b)), bin_estimate(b[:, 1:]).T / uniform))
    ratio[1] = ratio[1] / (n - fold_n) if n > fold_n else 0.0
    bucket = b[:, 0].copy()
    begin = bucket == -2
    left = d - fold_d
    ratio[2:, begin] = ratio[2:, begin] / left if left > 0 else 0.0  # counts there
    bucket[begin] = int(np.floor(np.log2(left))) + 1 if left > 0 else 0
    weights, pooled = em_weights(bucket, ratio, np.array(count, dtype=np.float64))
    table = np.array([weights.get(i, pooled) for i in range(65)])
    return np.concatenate(([n, v, d], table.ravel())).tobytes()
