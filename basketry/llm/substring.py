"""Substring dedup by seed and extend.

A run of ``min_words`` words that also starts earlier (in a smaller document,
or earlier in the same one) is removed, wherever it lies in the text.

*Seeds.* Every run of ``min_words`` words selects one anchor by winnowing: the
smallest hash among its ``seed_words``-word grams. Equal runs select equal
anchors, so a run can only repeat where its anchor does. Slots of documents
send their distinct anchors to hash buckets; a bucket returns those that two
slots or more sent.

*Extend.* Around each returned anchor a slot extends to both sides: every run
that the anchor governs is hashed in full (128 bits), and the slot's first
occurrence of each is sent to its bucket, which tells every slot but that of
the earliest occurrence. Runs that overlap or touch are joined to maximal
repeats. Repeats within a slot are found by the slot itself.

A passage that occurs in a third of all documents reaches a bucket once per
slot, never once per document, and no pairs of documents are formed.

Null text has no words. Repeated rows of one id: a run counts as repeated
only if its (id, start) is strictly larger than the first one's. A null id
orders last. An empty table gives an empty table. Only the id and text columns
are read, so other columns may have any name. ``text_md5`` of a result row
tells the text it was cut from, where rows share an id.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .exchange import (PACKED, RETURNED, back_to_slots, buckets_for, by_slot, cut_by_bucket, gather, ids_of,
                       packed_rows, returned, slots_in, text_bytes)
from .text import CHECK_BASE, SPACE_WORDS, as_bytes, rolling, runs_inside, words_of

SEED_WORDS = 8
RUN = np.dtype([("run", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("at", "<i4")])
KEY = np.dtype([("run", "<u8"), ("check", "<u8")])
RESULT = ("doc_id long, text_md5 string, text string, n_words long, n_removed long, "
          "spans array<struct<start:int,end:int>>")


def _sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (doubling, so log w passes)."""
    m, have = g, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[:len(g) - w + 1], m[w - have:])
    return m


def _runs(texts: list[bytes], min_words: int, seed_words: int):
    """Words, valid run starts, and for these the governing anchor and the two halves of the run's hash."""
    w = words_of(texts, SPACE_WORDS, lower=False)
    if len(w.hash) < min_words:
        none = np.zeros(0, dtype=np.uint64)
        return w, np.zeros(0, dtype=np.int64), none, none, none
    at = np.flatnonzero(runs_inside(w.first, min_words, len(w.hash)))
    anchor = _sliding_min(rolling(w.hash, seed_words), min_words - seed_words + 1)[at]
    return w, at, anchor, rolling(w.hash, min_words)[at], rolling(w.hash, min_words, CHECK_BASE)[at]


def _local_first(run, check, doc, pos):
    """(order, start of group per element, is the group's first) of runs grouped by hash, earliest (doc, pos) first."""
    order = np.lexsort((pos, doc, check, run))
    r, c = run[order], check[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    return order, new


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
                    seed_words: int = SEED_WORDS, keep_spacing: bool = False) -> DataFrame:
    """Documents without the words of repeated runs: doc_id, text, n_words, n_removed, spans.

    ``spans`` are the removed maximal word ranges. ``text`` has the kept words
    joined by one space, or, with ``keep_spacing``, the original text without
    the removed ranges.
    """
    seed = min(seed_words, min_words)
    dealt, parts, slots = by_slot(docs, id_col, text_col, text_bytes(docs, text_col))
    buckets = buckets_for(parts, slots)

    def anchors(batches):
        for batch in batches:
            texts = as_bytes(batch.column(2))
            def rows():
                for slot, idx in slots_in(batch):
                    _, _, anchor, _, _ = _runs([texts[i] for i in idx], min_words, seed)
                    own = np.unique(anchor)
                    for bucket, k in cut_by_bucket(own, buckets):
                        yield bucket, slot, own[k].tobytes()
            yield packed_rows(rows())

    def repeated_anchors(batches):
        h, slot = gather(batches, np.dtype("<u8"))
        order = np.argsort(h, kind="stable")
        h, slot = h[order], slot[order]
        again = np.zeros(len(h), dtype=bool)
        same = h[1:] == h[:-1]
        again[1:] |= same
        again[:-1] |= same
        yield back_to_slots(slot[again], h[again], 0)

    def slot_runs(left, right):
        """Runs of one slot with order, positions and flags; the anchors that came back."""
        idx = np.argsort(ids_of(left.column("doc_id").combine_chunks()), kind="stable")
        left = left.take(idx)
        ids = ids_of(left.column("doc_id").combine_chunks())
        texts = as_bytes(left.column("text"))
        w, at, anchor, run, check = _runs(texts, min_words, seed)
        known = np.unique(returned(right, 0, "<u8"))
        hit = np.searchsorted(known, anchor)
        seeded = known[np.minimum(hit, len(known) - 1)] == anchor if len(known) else np.zeros(len(anchor), dtype=bool)
        text_no = np.searchsorted(w.first, at, side="right") - 1
        return left, ids, texts, w, at, seeded, run, check, ids[text_no], (at - w.first[text_no])

    def extend(left, right):
        import pyarrow as pa
        slot = left.column("slot")[0].as_py() if left.num_rows else 0
        _, _, _, _, _, seeded, run, check, doc, pos = slot_runs(left, right)
        run, check, doc, pos = run[seeded], check[seeded], doc[seeded], pos[seeded]
        order, new = _local_first(run, check, doc, pos)
        own = np.empty(int(new.sum()), dtype=RUN)
        k = order[new]
        own["run"], own["check"], own["doc"], own["at"] = run[k], check[k], doc[k], pos[k]
        return pa.Table.from_batches([packed_rows(
            (b, slot, own[i].tobytes()) for b, i in cut_by_bucket(own["run"], buckets))])

    def later(batches):
        items, slot = gather(batches, RUN)
        order, new = _local_first(items["run"], items["check"], items["doc"], items["at"])
        items, slot = items[order], slot[order]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        late = (items["doc"] > items["doc"][first]) | (items["at"] > items["at"][first])
        keys = np.empty(int(late.sum()), dtype=KEY)
        keys["run"], keys["check"] = items["run"][late], items["check"][late]
        yield back_to_slots(slot[late], keys, 1)

    def remove(left, right):
        left, ids, texts, w, at, _, run, check, doc, pos = slot_runs(left, right)
        order, new = _local_first(run, check, doc, pos)
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        d, p = doc[order], pos[order]
        late = (d > d[first]) | (p > p[first])
        told = returned(right, 1, KEY)
        if len(told):
            told = told[np.lexsort((told["check"], told["run"]))]
            r, c = run[order], check[order]
            lo = np.searchsorted(told["run"], r)
            while True:  # equal first halves with different second halves: step through all of them
                lo_c = np.minimum(lo, len(told) - 1)
                step = (told["run"][lo_c] == r) & (told["check"][lo_c] < c) & (lo < len(told))
                if not step.any():
                    break
                lo = lo + step
            lo = np.minimum(lo, len(told) - 1)
            late |= (told["run"][lo] == r) & (told["check"][lo] == c)
        cover = np.zeros(len(w.start) + 1, dtype=np.int64)
        hits = at[order[late]]
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + min_words, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return _cleaned(left, texts, w, gone, keep_spacing)

    seeds = dealt.mapInArrow(anchors, PACKED).repartition(parts, "bucket").mapInArrow(repeated_anchors, RETURNED)
    found = (dealt.groupBy("slot").cogroup(seeds.repartition(parts, "slot").groupBy("slot"))
             .applyInArrow(extend, PACKED).repartition(parts, "bucket").mapInArrow(later, RETURNED))
    marks = found.repartition(parts, "slot")
    return dealt.groupBy("slot").cogroup(marks.groupBy("slot")).applyInArrow(remove, RESULT)


def _cleaned(left, texts, w, gone, keep_spacing):
    """The RESULT rows of one slot."""
    import pyarrow as pa
    kept_texts, n_words, n_removed, spans = [], [], [], []
    for i, text in enumerate(texts):
        lo, hi = w.first[i], w.first[i + 1]
        g = gone[lo:hi]
        n_words.append(int(hi - lo))
        n_removed.append(int(g.sum()))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])])
        start, end = w.start[lo:hi] - w.text_at[i], w.end[lo:hi] - w.text_at[i]
        if keep_spacing:
            if len(edge):
                out, at = [], 0
                for a, b in zip(edge[0::2], edge[1::2]):
                    out.append(text[at:start[a]])
                    at = start[b] if b < len(start) else len(text)
                out.append(text[at:])
                text = b"".join(out).rstrip() if edge[-1] == len(start) else b"".join(out)
        else:
            keep = np.flatnonzero(~g)
            text = b" ".join(text[a:b] for a, b in zip(start[keep], end[keep]))
        kept_texts.append(text.decode("utf-8", "replace"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table({
        "doc_id": left.column("doc_id"), "text_md5": pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string()),
        "text": pa.array(kept_texts, pa.string()),
        "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "spans": pa.array(spans, span)})
