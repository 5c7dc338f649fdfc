"""Suffix-array dedup over bytes, by induced sorting.

A string of ``min_bytes`` bytes that also starts earlier (in a smaller
document, or earlier in the same one) is removed. Matches never cross
documents; strings are judged on the input.

*Shards.* Every ``min_bytes`` window selects an anchor by winnowing (the
smallest hash among its ``seed_bytes``-byte grams; equal windows select equal
anchors). Slots of documents send their distinct anchors to hash buckets and
learn which occur more than once. The text around such an anchor (all windows
that it governs, one *piece*) goes to the shard of the anchor, so all copies
of a window meet in one shard. A slot sends equal pieces once.

*Shard arrays.* A shard joins its pieces with separators and builds their
suffix array by induced sorting: suffixes are classified, the leftmost-smaller
(LMS) substrings are sorted and named, equal names are resolved on the reduced
string, and the array is induced from the sorted LMS suffixes in two passes
over the byte buckets. The reduced string is sorted by rank doubling instead
of by another induced level: with its large alphabet the bucket passes would
run per symbol in Python. The permuted longest-common-prefix array follows
from the irreducible positions; neighbours with ``min_bytes`` in common form a
class, and all but its earliest window are repeats.

*Hot anchors.* An anchor that governs over ``HOT`` windows (a phrase of very
many documents, or of a long text that repeats itself) would put all its
pieces into one shard. Its windows go out
one by one, under a 128-bit fingerprint of the whole window, dealt by that
fingerprint; a slot sends equal windows once.

Null text is empty. Repeated rows of one id: a window counts as repeated only
if its (id, start) is strictly larger than the first one's, in every row alike.
Rows equal in id and text share one verdict; of other rows of one id, each sends
the pieces that it holds at the same place, and a hot window's verdict goes to
all rows of its slot that hold it at that place. A null id orders last; such
rows are dealt to slots by their text. An empty table gives an empty table. Only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .exchange import (MIN_BUCKETS, back_to_slots, by_slot, cut_by_bucket, ids_of, slots_in, text_bytes)
from .substring import _sliding_min
from .text import BYTE_VALUE, CHECK_BASE, U64, as_bytes, rolling

SEED_BYTES = 32
HOT = 1 << 17
#: small tables are cut into at most so many slots
FINE_SLOTS = 256
#: bytes of pieces that one suffix array takes; an anchor's pieces stay together
SHARD_BYTES = 2 << 20
#: text bytes a bucket: a task holds one bucket at a time, in pieces up to 4 times, in single windows up to 32 times as much
BUCKET_BYTES = 6 << 20

ANCHOR = np.dtype([("h", "<u8"), ("n", "<i4"), ("windows", "<i4")])
KNOWN = np.dtype([("h", "<u8"), ("hot", "i1")])
# row: rank among the different texts of one id in its slot
PIECE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<i4"), ("len", "<i4")])
WINDOW = np.dtype([("run", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<i4")])
RANGE = np.dtype([("doc", "<i8"), ("row", "<i4"), ("lo", "<i4"), ("hi", "<i4")])
SENT = "bucket int, slot int, kind int, data binary, extra binary"
BACK = "slot int, kind int, data binary"
RESULT = "doc_id long, text binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>"


# ------------------------------------------------------------ suffix array --

def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than their right neighbour); the last one is S."""
    n = len(t)
    less, differs = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    less[:-1] = t[:-1] < t[1:]
    differs[:-1] = t[:-1] != t[1:]
    less[-1] = differs[-1] = True
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return less[nxt]


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _lms_names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order-preserving names of the LMS substrings (each up to and with the next LMS position).

    Seven characters of nine bits at a time; past its end a substring has a
    filler larger than any character, because at equal characters the S
    suffix (the end) is the larger one.
    """
    m = len(lms)
    end = np.append(lms[1:], len(t) - 1)
    name = np.zeros(m, dtype=np.int64)
    left = np.arange(m)
    shift = 0
    while len(left):
        key = np.zeros(len(left), dtype=U64)
        for k in range(7):
            p = lms[left] + shift + k
            c = np.where(p <= end[left], t[np.minimum(p, len(t) - 1)], 511).astype(U64)
            key = (key << U64(9)) | c
        if shift == 0:
            name[left] = _dense(key)
        else:
            order = np.lexsort((key, name[left]))
            g, k2 = name[left][order], key[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (k2[1:] != k2[:-1])
            start = np.ones(len(order), dtype=bool)
            start[1:] = g[1:] != g[:-1]
            sub = np.cumsum(new)
            sub = sub - np.maximum.accumulate(np.where(start, sub, 0))
            fine = np.zeros(m, dtype=np.int64)
            fine[left[order]] = sub
            name = _dense(name * np.int64(m + 1) + fine)
        shift += 7
        count = np.bincount(name)
        left = left[(count[name[left]] > 1) & (lms[left] + shift <= end[left])]
    return name


def _rank_names(name: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of the reduced string (its last symbol is its unique smallest)."""
    m, h = len(name), 1
    rank = name
    while True:
        count = np.bincount(rank)
        tied = np.flatnonzero(count[rank] > 1)
        if not len(tied):
            return rank
        second = np.where(tied + h < m, rank[np.minimum(tied + h, m - 1)] + 1, 0)
        base = np.cumsum(count) - count  # rank of a group: how many suffixes are smaller
        order = np.lexsort((second, rank[tied]))
        g, s = rank[tied][order], second[order]
        pos = np.arange(len(order))
        start = np.ones(len(order), dtype=bool)
        start[1:] = g[1:] != g[:-1]
        new = start.copy()
        new[1:] |= s[1:] != s[:-1]
        first = np.maximum.accumulate(np.where(start, pos, 0))
        at = np.maximum.accumulate(np.where(new, pos, 0))
        out = base[rank]
        out[tied[order]] = base[g] + at - first
        rank = out
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t`` (integers below 510, the last one the unique smallest)."""
    n = len(t)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return np.argsort(t, kind="stable")[::1] if n < 2 else np.lexsort((np.arange(n)[::-1], t))
    rank = _rank_names(_lms_names(t, lms))
    lms = lms[np.argsort(rank, kind="stable")]
    top = int(t.max()) + 1
    lms_char = t[lms]
    lms_cut = np.searchsorted(lms_char, np.arange(top + 1))
    pending: list[list[np.ndarray]] = [[] for _ in range(top)]
    l_part: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.int64)

    def pass_on(entries: np.ndarray, keep) -> None:
        p = entries - 1
        p = p[p >= 0]
        ch = t[p]
        sel = keep(ch)
        p, ch = p[sel], ch[sel]
        order = np.argsort(ch, kind="stable")
        p, ch = p[order], ch[order]
        cuts = np.flatnonzero(ch[1:] != ch[:-1]) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(p))):
            if b > a:
                pending[int(ch[a])].append(p[a:b])

    def with_runs(entries: np.ndarray, c: int) -> np.ndarray:
        parts, now = [entries], entries
        while len(now):
            now = now[now > 0] - 1
            now = now[t[now] == c]
            parts.append(now)
        return np.concatenate(parts)

    for c in range(top):  # L suffixes, ascending
        own = with_runs(np.concatenate(pending[c]) if pending[c] else none, c)
        l_part.append(own)
        pass_on(np.concatenate((own, lms[lms_cut[c]:lms_cut[c + 1]])), lambda ch, c=c: ch > c)
    pending = [[] for _ in range(top)]
    s_part: list[np.ndarray] = [none] * top
    for c in range(top - 1, -1, -1):  # S suffixes, descending
        own = with_runs(np.concatenate(pending[c]) if pending[c] else none, c)
        if c == t[n - 1]:
            own = np.append(own, n - 1)  # the last suffix has nothing to be induced from
        s_part[c] = own
        pass_on(np.concatenate((own, l_part[c][::-1])), lambda ch, c=c: ch < c)
    return np.concatenate([x for c in range(top) for x in (l_part[c], s_part[c][::-1])])


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): per position the prefix it shares with its predecessor in the suffix array."""
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    prev_differs = np.ones(n, dtype=bool)
    both = (pos > 0) & (phi > 0)
    i = pos[both]
    prev_differs[both] = t[i - 1] != t[phi[both] - 1]
    start = pos[prev_differs & (phi >= 0)]
    wide = np.zeros(n + 8, dtype=np.uint16)
    wide[:n] = t
    four = np.zeros(n + 4, dtype=U64)
    for k in range(4):
        four |= wide[k:n + 4 + k].astype(U64) << U64(16 * k)
    length = np.zeros(len(start), dtype=np.int64)
    live = np.arange(len(start))
    a, b = start.copy(), phi[start]
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        ok = (x < n) & (y < n)
        diff = np.where(ok, four[np.minimum(x, n)] ^ four[np.minimum(y, n)], U64(1))
        more = diff == 0
        low = diff & (~diff + U64(1))
        length[live] += np.where(more, 4, (low >= U64(1 << 16)).astype(np.int64) + (low >= U64(1 << 32))
                                 + (low >= U64(1 << 48)))
        live = live[more]
    plcp = np.zeros(n, dtype=np.int64)
    plcp[start] = length
    known = np.zeros(n, dtype=np.int64)
    known[start] = start
    has = np.zeros(n, dtype=bool)
    has[start] = True
    has[phi < 0] = True
    known[phi < 0] = pos[phi < 0]
    src = np.maximum.accumulate(np.where(has, known, 0))
    return np.maximum(plcp[src] - (pos - src), 0), phi


def repeated_windows(pieces: list[bytes], doc: np.ndarray, row: np.ndarray, at: np.ndarray,
                     size: int) -> np.ndarray:
    """RANGEs of the bytes in windows of ``size`` that also start earlier among the pieces."""
    lens = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
    first = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=first[1:])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    t = raw.astype(np.int16) + 2
    t[first[1:] - 1] = 1
    t[-1] = 0
    sa = suffix_array(t)
    plcp, phi = permuted_lcp(t, sa)
    piece = np.repeat(np.arange(len(pieces)), lens + 1)
    left = first[piece + 1] - 1 - np.arange(len(t))
    shared = np.minimum(plcp, left)
    shared = np.where(phi >= 0, np.minimum(shared, left[np.maximum(phi, 0)]), 0)
    join = shared[sa] >= size  # same class as the one before
    klass = np.cumsum(~join)
    member = join.copy()
    member[:-1] |= join[1:]
    p, k = sa[member], klass[member]
    d, a, r = doc[piece[p]], at[piece[p]] + (p - first[piece[p]]), row[piece[p]]
    order = np.lexsort((a, d, k))
    p, k, d, a, r = p[order], k[order], d[order], a[order], r[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    late = (d > d[lead]) | (a > a[lead])
    return merged(ranges_of(d[late], r[late], a[late], a[late] + size))


def ranges_of(doc, row, lo, hi) -> np.ndarray:
    out = np.empty(len(doc), dtype=RANGE)
    out["doc"], out["row"], out["lo"], out["hi"] = doc, row, lo, hi
    return out


def by_id_and_text(ids: np.ndarray, texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(indices ordered by id, then text; rank of each of these among the texts of its id; is it the text's first)."""
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    own = ids[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    first = new.copy()
    first[1:] |= np.array([texts[i] != texts[j] for i, j in zip(order[1:], order[:-1])], dtype=bool)
    at = np.cumsum(first) - 1
    return order, at - np.maximum.accumulate(np.where(new, at, 0)), first


# ------------------------------------------------------------------- slots --

class _Slot:
    """The documents of a slot as one byte array, with the governing anchor of every window."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, size: int, seed: int, rows: np.ndarray | None = None):
        lens = np.fromiter((len(x) for x in texts), dtype=np.int64, count=len(texts))
        self.first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lens, out=self.first[1:])
        self.raw = b"".join(texts)
        n = len(self.raw)
        value = BYTE_VALUE[np.frombuffer(self.raw, dtype=np.uint8)]
        self.value, self.ids, self.size, self.rows = value, ids, size, rows
        width = size - seed + 1
        if n < size:
            self.at = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=U64)
            self.own, self.count = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
            self.governed = self.count
            return
        gram = rolling(value, seed)
        low = _sliding_min(gram, width)
        last = np.repeat(self.first[1:], lens)[:n - size + 1]
        inside = np.arange(n - size + 1) + size <= last
        self.at = np.flatnonzero(inside)
        self.anchor = low[self.at]
        top = np.where(inside, low, U64(0))
        pad = np.zeros(width - 1, dtype=U64)
        chosen = ~_sliding_min(~np.concatenate((pad, top, pad)), width) == gram
        self.own, self.count = np.unique(gram[chosen], return_counts=True)
        self.governed = np.bincount(np.searchsorted(self.own, self.anchor), minlength=len(self.own))

    def text_no(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100,
                 seed_bytes: int = SEED_BYTES, hot: int = HOT) -> DataFrame:
    """Documents without the bytes of repeated strings: doc_id, text (the bytes left), n_bytes, n_removed, spans."""
    seed, size = min(seed_bytes, min_bytes), min_bytes
    # a row goes out per slot, bucket and kind: no more slots and buckets than the partitions need
    n_bytes = text_bytes(docs, text_col)
    dealt, parts, slots = by_slot(docs, id_col, text_col, n_bytes, fine_slots=FINE_SLOTS, null_by_text=True)
    buckets = max(min(MIN_BUCKETS, slots), parts, -(-n_bytes // BUCKET_BYTES))

    def sent(rows):
        import pyarrow as pa
        rows = list(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in
             enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
            names=["bucket", "slot", "kind", "data", "extra"])

    def anchors(batches):
        for batch in batches:
            texts, ids = as_bytes(batch.column(2)), ids_of(batch.column(1))
            def rows():
                for slot, idx in slots_in(batch):
                    s = _Slot([texts[i] for i in idx], ids[idx], size, seed)
                    out = np.empty(len(s.own), dtype=ANCHOR)
                    out["h"], out["n"], out["windows"] = s.own, s.count, s.governed
                    for b, k in cut_by_bucket(s.own, buckets):
                        yield b, slot, 0, out[k].tobytes(), b""
            yield sent(rows())

    def known_anchors(batches):
        known, slots = [np.zeros(0, dtype=KNOWN)], [np.zeros(0, dtype=np.int32)]
        for rows in _by_bucket(batches):
            data = np.frombuffer(b"".join(r[3] for r in rows), dtype=ANCHOR)
            slot = np.repeat(np.array([r[1] for r in rows], dtype=np.int32), [len(r[3]) // ANCHOR.itemsize for r in rows])
            order = np.argsort(data["h"], kind="stable")
            data, slot = data[order], slot[order]
            new = np.ones(len(data), dtype=bool)
            new[1:] = data["h"][1:] != data["h"][:-1]
            group = np.cumsum(new) - 1
            total, windows = (np.bincount(group, weights=data[c]) for c in ("n", "windows"))
            keep = total[group] > 1
            out = np.empty(int(keep.sum()), dtype=KNOWN)
            out["h"], out["hot"] = data["h"][keep], windows[group[keep]] > hot
            known.append(out)
            slots.append(slot[keep])
        yield back_to_slots(np.concatenate(slots), np.concatenate(known), 0)

    def send(left, right):
        import pyarrow as pa
        if not left.num_rows:
            return pa.Table.from_batches([sent(())])
        slot = left.column("slot")[0].as_py()
        ids = ids_of(left.column("doc_id").combine_chunks())
        texts = as_bytes(left.column("text"))
        order, rank, first = by_id_and_text(ids, texts)
        order = np.array(order, dtype=np.int64)[first]
        s = _Slot([texts[i] for i in order], ids[order], size, seed, rank[first])
        known = _back(right, 0, KNOWN)
        known = known[np.argsort(known["h"], kind="stable")]
        if len(known):
            hit = np.minimum(np.searchsorted(known["h"], s.anchor), len(known) - 1)
            has = known["h"][hit] == s.anchor
            is_hot = has & (known["hot"][hit] > 0)
        else:
            has = is_hot = np.zeros(len(s.anchor), dtype=bool)
        return pa.Table.from_batches([sent(_rows_of(s, has & ~is_hot, is_hot, slot, buckets))])

    def find(batches):
        for rows in _by_bucket(batches):  # all copies of a window are in one bucket
            passed = [(r[1], np.frombuffer(r[3], dtype=RANGE)) for r in rows if r[2] == 0]
            pieces = [(r[1], np.frombuffer(r[3], dtype=PIECE)) for r in rows if r[2] == 1]
            texts = [r[4] for r in rows if r[2] == 1]
            windows = [np.frombuffer(r[3], dtype=WINDOW) for r in rows if r[2] == 2]
            wslots = [np.full(len(w), r[1], dtype=np.int32) for r, w in zip((r for r in rows if r[2] == 2), windows)]
            rows.clear()
            if passed:
                yield back_to_slots(np.concatenate([np.full(len(r), sl, dtype=np.int32) for sl, r in passed]),
                                    np.concatenate([r for _, r in passed]), 0)
            if windows:
                held, hslots = np.concatenate(windows), np.concatenate(wslots)
                windows.clear()
                yield _late_windows(held, hslots, size)
                del held, hslots
            if pieces:
                yield from _shards(pieces, texts, size)

    def remove(left, right):
        return _result(left, _back(right, 0, RANGE), size)

    def bucketed(sent_rows):
        return sent_rows.repartition(parts, "bucket").sortWithinPartitions("bucket")

    seeds = bucketed(dealt.mapInArrow(anchors, SENT)).mapInArrow(known_anchors, BACK)
    ranges = bucketed(dealt.groupBy("slot").cogroup(seeds.repartition(parts, "slot").groupBy("slot"))
                      .applyInArrow(send, SENT)).mapInArrow(find, BACK)
    return (dealt.groupBy("slot").cogroup(ranges.repartition(parts, "slot").groupBy("slot"))
            .applyInArrow(remove, RESULT))


def _by_bucket(batches):
    """The rows (SENT) of each bucket of a partition that is sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):  # so that a batch is not held twice
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                if row[0] != now:
                    if held:
                        yield held
                    now, held = row[0], []
                held.append(row)
    if held:
        yield held


def _back(table, kind: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("data").to_pylist()), dtype=dtype)


def _rows_of(s: _Slot, piece_ok: np.ndarray, hot_ok: np.ndarray, slot: int, buckets: int):
    """What a slot sends: pieces (kind 1), windows of hot anchors (kind 2), repeats it found itself (kind 0)."""
    late = [np.zeros(0, dtype=RANGE)]
    at, anchor = s.at[piece_ok], s.anchor[piece_ok]
    if len(at):
        text = s.text_no(at)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        lo = np.flatnonzero(new)
        hi = at[np.append(lo[1:], len(at)) - 1] + s.size
        lo, h, no = at[lo], anchor[lo], text[lo]
        content = [s.raw[a:b] for a, b in zip(lo, hi)]
        doc, row, pos = s.ids[no], s.rows[no], lo - s.first[no]
        seen: dict[bytes, int] = {}
        lead = np.zeros(len(lo), dtype=np.int64)
        for i in np.lexsort((pos, doc)).tolist():  # the earliest of equal pieces first
            lead[i] = seen.setdefault(content[i], i)
        again = (doc > doc[lead]) | (pos > pos[lead])
        late.append(ranges_of(doc[again], row[again], pos[again], pos[again] + (hi - lo)[again]))
        keep = np.flatnonzero(~again)  # the first, and equal pieces at its place in other rows of its id
        out = np.empty(len(keep), dtype=PIECE)
        out["h"], out["doc"], out["row"], out["at"], out["len"] = h[keep], doc[keep], row[keep], pos[keep], (hi - lo)[keep]
        for b, k in cut_by_bucket(out["h"], buckets):
            yield b, slot, 1, out[k].tobytes(), b"".join(content[keep[i]] for i in k)
    at = s.at[hot_ok]
    if len(at):
        run, check = rolling(s.value, s.size)[at], rolling(s.value, s.size, CHECK_BASE)[at]
        no = s.text_no(at)
        doc, row, pos = s.ids[no], s.rows[no], at - s.first[no]
        order = np.lexsort((pos, doc, check, run))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (run[order][1:] != run[order][:-1]) | (check[order][1:] != check[order][:-1])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = order[(doc[order] > doc[lead]) | (pos[order] > pos[lead])]
        late.append(merged(ranges_of(doc[again], row[again], pos[again], pos[again] + s.size)))
        k = order[new]
        out = np.empty(len(k), dtype=WINDOW)
        out["run"], out["check"], out["doc"], out["row"], out["at"] = run[k], check[k], doc[k], row[k], pos[k]
        for b, i in cut_by_bucket(out["run"], buckets):
            yield b, slot, 2, out[i].tobytes(), b""
    out = merged(np.concatenate(late))
    if len(out):
        yield slot % buckets, slot, 0, out.tobytes(), b""


def merged(r: np.ndarray) -> np.ndarray:
    """Ranges of one row that overlap or touch become one."""
    r = r[np.lexsort((r["lo"], r["row"], r["doc"]))]
    if not len(r):
        return r
    hi = r["hi"].astype(np.int64)
    group = np.cumsum(np.append(True, (r["doc"][1:] != r["doc"][:-1]) | (r["row"][1:] != r["row"][:-1]))) - 1
    span = np.int64(1) << np.int64(33)
    reach = np.maximum.accumulate(hi + group * span) - group * span
    new = np.ones(len(r), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (r["lo"][1:] > reach[:-1])
    lo = np.flatnonzero(new)
    out = r[lo].copy()
    out["hi"] = reach[np.append(lo[1:], len(r)) - 1]
    return out


def _late_windows(w: np.ndarray, slots: np.ndarray, size: int):
    order = np.lexsort((w["at"], w["doc"], w["check"], w["run"]))
    w, slots = w[order], slots[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w["run"][1:] != w["run"][:-1]) | (w["check"][1:] != w["check"][:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    late = (w["doc"] > w["doc"][lead]) | (w["at"] > w["at"][lead])
    w = w[late]
    return back_to_slots(slots[late], ranges_of(w["doc"], w["row"], w["at"], w["at"] + size), 0)


def _shards(pieces, texts, size: int):
    """Suffix arrays over the pieces of a partition, whole anchors together, SHARD_BYTES each."""
    slot = np.concatenate([np.full(len(p), s, dtype=np.int32) for s, p in pieces])
    content = []
    for (_, p), x in zip(pieces, texts):
        cut = np.append(0, np.cumsum(p["len"]))
        content += [x[a:b] for a, b in zip(cut[:-1], cut[1:])]
    info = np.concatenate([p for _, p in pieces])
    pieces.clear()  # the caller holds these lists too
    texts.clear()
    order = np.lexsort((info["at"], info["doc"], info["h"]))
    new = np.append(True, info["h"][order][1:] != info["h"][order][:-1])
    starts = np.append(np.flatnonzero(new), len(order))
    a = 0
    while a < len(starts) - 1:
        b, total = a, 0
        while b < len(starts) - 1 and (b == a or total < SHARD_BYTES):
            total += int(info["len"][order[starts[b]:starts[b + 1]]].sum())
            b += 1
        idx = order[starts[a]:starts[b]]
        a = b
        seen: dict[bytes, int] = {}
        late, keep = [], []
        for i in idx:  # ordered by (anchor, doc, at), so the first of equal pieces is the earliest
            j = seen.setdefault(content[i], i)
            if j == i:
                keep.append(i)
            elif info["doc"][i] > info["doc"][j] or info["at"][i] > info["at"][j]:
                late.append(i)
            else:  # at the same place in another row of the id
                keep.append(i)
        late, keep = np.array(late, dtype=np.int64), np.array(keep, dtype=np.int64)
        whole = info[late]
        whole = ranges_of(whole["doc"], whole["row"], whole["at"], whole["at"] + whole["len"])
        found = repeated_windows([content[i] for i in keep], info["doc"][keep], np.arange(len(keep)),
                                 info["at"][keep].astype(np.int64), size)
        own = keep[found["row"]]  # null ids stand in several slots, so the piece tells slot and row
        to, found["row"] = slot[own], info["row"][own]
        out = np.concatenate((whole, found))
        yield back_to_slots(np.concatenate((slot[late], to)).astype(np.int32), out, 0)


def _alike(order, rank, first, ids, texts, ranges: np.ndarray, size: int) -> np.ndarray:
    """The ranges of single windows, given to all other texts of their id that hold the window at that place."""
    order = np.array(order, dtype=np.int64)[first]
    rank = rank[first]
    own = ids[order]
    several = np.zeros(len(own), dtype=bool)
    several[1:] |= own[1:] == own[:-1]
    several[:-1] |= own[1:] == own[:-1]
    rows: dict[int, list[tuple[int, bytes]]] = {}
    for i, k in zip(order[several].tolist(), rank[several].tolist()):
        rows.setdefault(int(ids[i]), []).append((k, texts[i]))
    single = ranges[(ranges["hi"] - ranges["lo"] == size) & np.isin(ranges["doc"], list(rows))]
    wanted: dict[int, dict[int, set[bytes]]] = {}
    for r in single:
        doc, lo = int(r["doc"]), int(r["lo"])
        wanted.setdefault(doc, {}).setdefault(lo, set()).add(rows[doc][int(r["row"])][1][lo:lo + size])
    more = [(doc, k, lo, lo + size) for doc, at in wanted.items() for k, text in rows[doc]
            for lo, held in at.items() if text[lo:lo + size] in held]
    return np.concatenate((ranges, np.array(more, dtype=RANGE)))


def _result(left, ranges: np.ndarray, size: int):
    import pyarrow as pa
    ids = ids_of(left.column("doc_id").combine_chunks())
    texts = as_bytes(left.column("text"))
    order, rank, first = by_id_and_text(ids, texts)
    ranges = merged(_alike(order, rank, first, ids, texts, ranges, size))
    own: dict[tuple[int, int], list] = {}
    for r in ranges:
        own.setdefault((int(r["doc"]), int(r["row"])), []).append((int(r["lo"]), int(r["hi"])))
    spans: list = [[]] * len(texts)
    for i, k in zip(order, rank.tolist()):
        spans[i] = own.get((int(ids[i]), k), [])
    kept, removed = [], []
    for text, cut in zip(texts, spans):
        at, out = 0, []
        for lo, hi in cut:
            out.append(text[at:lo])
            at = hi
        out.append(text[at:])
        kept.append(b"".join(out))
        removed.append(sum(hi - lo for lo, hi in cut))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table({
        "doc_id": left.column("doc_id"), "text": pa.array(kept, pa.binary()),
        "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array([[{"start": a, "end": b} for a, b in cut] for cut in spans], span)})
