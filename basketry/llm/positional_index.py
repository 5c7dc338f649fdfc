"""Benchmark decontamination with a distributed positional inverted index.

*Index.* The documents' tokens are stored as postings: one row per segment (a
bounded run of documents) with its term dictionary (sorted 64-bit term
hashes), the postings of all terms (token positions, ascending within a term,
delta-coded) and its document table. Segments are built where the documents
are read, with no shuffle, and written once to the shared folder.

*Search.* Test texts are cut into windows of consecutive words. Term
frequencies over all segments order each window's terms from the rarest; in a
segment, the postings of the rarest term, minus its offset, are the candidate
starts, and each further term's offset-adjusted list is intersected with them.
What stays after all terms are exact phrase matches; with a tolerance on every
intersection step the same walk gives proximity matches (every term within
``slop`` words of its place).

Test texts are searched in blocks of bounded size; a block (its windows and
its terms' frequencies) is all that is sent to every task.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
characters. Null text has no words. A test text shorter than a window is one
window; one without words matches nothing. Repeated rows are indexed and
reported each; repeated item ids count once. Items with a null id are searched
like any other: their windows give spans, and all of them together are one null
entry at the end of ``items``, which counts in its size (``n_items``) and has no
name to join (``items_sha256``). Empty tables give empty results
or no matches. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NULL_ID, ids_of, stored
from .text import ALNUM_WORDS, U64, as_bytes, chunked, words_of

#: text bytes of a segment (a longer document is a segment by itself)
SEGMENT_BYTES = 8 << 20
#: text bytes of test items that are searched at a time
BLOCK_BYTES = 4 << 20
INDEX = ("segment long, n_terms long, n_postings long, terms binary, counts binary, postings binary, "
         "docs binary, doc_words binary")
FOUND = "segment long, doc_no int, doc_id long, n_words long, items array<string>, near_items array<string>, spans array<struct<start:int,end:int>>"


def _gaps(words: np.ndarray, gap: int) -> np.ndarray:
    """Position of each document's first word; documents stand ``gap`` apart, so no match crosses them."""
    first = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(words + gap, out=first[1:])
    return first


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """INDEX rows over all documents, written to the shared folder.

    ``gap`` bounds window + slop of later searches.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def segments(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = ids_of(batch.column(0))
            texts = as_bytes(batch.column(1))
            for lo, hi in chunked(map(len, texts), SEGMENT_BYTES):
                hashes, words = [], []
                for a, b in chunked(map(len, texts[lo:hi])):
                    w = words_of(texts[lo + a:lo + b], ALNUM_WORDS, lower=True)
                    hashes.append(w.hash)
                    words.append(w.n_words())
                words = np.concatenate(words)
                first = _gaps(words, gap)
                h = np.concatenate(hashes)
                place = np.arange(len(h)) + np.repeat(np.arange(len(words)) * gap, words)
                order = np.argsort(h, kind="stable")
                terms, start = np.unique(h[order], return_index=True)
                counts = np.diff(np.append(start, len(h)))
                post = place[order]
                delta = post.copy()
                delta[1:] -= post[:-1]
                delta[start] = post[start]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([len(terms)], pa.int64()),
                    pa.array([len(post)], pa.int64()), pa.array([terms.tobytes()], pa.binary()),
                    pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                    pa.array([delta.astype("<u4").tobytes()], pa.binary()),
                    pa.array([ids[lo:hi].tobytes()], pa.binary()),
                    pa.array([words.astype("<u4").tobytes()], pa.binary())],
                    names=["segment", "n_terms", "n_postings", "terms", "counts", "postings", "docs", "doc_words"])
                number += 1

    return stored(rows.mapInArrow(segments, INDEX), "positional-index")


class Windows:
    """Windows of a block of test items: term hash per place (0 past the end of a short item)."""

    def __init__(self, items: list[str | None], texts: list[bytes], window: int):
        w = words_of(texts, ALNUM_WORDS, lower=True)
        rows, item, length = [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
            h = w.hash[a:b]
            if not len(h):
                continue
            n = min(window, len(h))
            cut = np.lib.stride_tricks.sliding_window_view(h, n)
            full = np.zeros((len(cut), window), dtype=U64)
            full[:, :n] = cut
            rows.append(full)
            item.append(np.full(len(cut), i))
            length.append(np.full(len(cut), n))
        self.items = items
        self.terms = np.concatenate(rows) if rows else np.zeros((0, window), dtype=U64)
        self.item = np.concatenate(item) if item else np.zeros(0, dtype=np.int64)
        self.length = np.concatenate(length) if length else np.zeros(0, dtype=np.int64)
        self.vocabulary = np.unique(w.hash)

    def rarest_first(self, frequency: np.ndarray) -> np.ndarray:
        """Places of every window ordered by the frequency of their terms; absent places last."""
        f = frequency[np.searchsorted(self.vocabulary, self.terms).clip(max=len(self.vocabulary) - 1)]
        f = np.where(np.arange(self.terms.shape[1]) < self.length[:, None], f, np.iinfo(np.int64).max)
        return np.argsort(f, axis=1, kind="stable")


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Windows]:
    """The test items in blocks of BLOCK_BYTES, read one block at a time."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    names, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if not r["text"]:
            continue
        t = r["text"].encode()
        if names and size + len(t) > BLOCK_BYTES:
            yield Windows(names, texts, window)
            names, texts, size = [], [], 0
        names.append(r["item"])
        texts.append(t)
        size += len(t)
    yield Windows(names, texts, window)


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of a block's vocabulary occurs in all segments."""
    if not len(vocabulary):
        return np.zeros(1, dtype=np.int64)

    def count(batches):
        import pyarrow as pa
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, counts = np.frombuffer(t, dtype="<u8"), np.frombuffer(c, dtype="<u4")
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    total += np.where(terms[at] == vocabulary, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())],
                                         names=["term", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in (index.select("terms", "counts").mapInArrow(count, "term int, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).collect()):  # the block bounds its terms
        out[r["term"]] = r["n"]
    return out


class Segment:
    """One segment's postings as a sorted array of (term number, position) keys."""

    def __init__(self, terms: bytes, counts: bytes, postings: bytes, docs: bytes, doc_words: bytes, gap: int):
        self.terms = np.frombuffer(terms, dtype="<u8")
        counts_ = np.frombuffer(counts, dtype="<u4").astype(np.int64)
        self.start = np.append(0, np.cumsum(counts_))
        delta = np.frombuffer(postings, dtype="<u4").astype(np.int64)
        total = np.cumsum(delta)
        before = np.append(0, total)[self.start[:-1]]
        self.place = total - np.repeat(before, counts_)
        self.key = (np.repeat(np.arange(len(counts_)), counts_) << 40) | self.place
        self.docs = np.frombuffer(docs, dtype="<i8")
        self.words = np.frombuffer(doc_words, dtype="<u4").astype(np.int64)
        self.first = _gaps(self.words, gap)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each hash, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, w: Windows, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, exact) of all matches, the lists intersected from each window's rarest term."""
        none = np.zeros(0, dtype=np.int64)
        if not len(w.terms) or not len(self.key):
            return none, none, none.astype(bool)
        number = self.numbers(w.terms)
        absent = np.arange(w.terms.shape[1]) >= w.length[:, None]
        live = np.flatnonzero(((number >= 0) | absent).all(axis=1))
        lead = order[live, 0]
        term = number[live, lead]
        count = self.start[term + 1] - self.start[term]
        win = np.repeat(live, count)
        nth = np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count)
        start = self.place[np.repeat(self.start[term], count) + nth] - np.repeat(lead, count)
        exact = np.ones(len(win), dtype=bool)
        for step in range(1, w.terms.shape[1]):
            offset = order[win, step]
            beyond = offset >= w.length[win]
            goal = start + offset
            t = np.maximum(number[win, offset], 0)
            key = (t << 40) | np.maximum(goal, 0)
            at = np.searchsorted(self.key, key)
            here = np.minimum(at, len(self.key) - 1)
            hit = (self.key[here] == key) & (goal >= 0)
            near = hit.copy()
            if slop:
                for side in (here, np.maximum(at - 1, 0)):
                    k = self.key[side]
                    near |= ((k >> 40) == t) & (np.abs((k & ((1 << 40) - 1)) - goal) <= slop)
            exact &= hit | beyond
            keep = near | beyond
            win, start, exact = win[keep], start[keep], exact[keep]
        # a start must lie in a document with room for the window
        doc = np.searchsorted(self.first, start, side="right") - 1
        ok = (start >= 0) & (doc < len(self.words))
        inside = np.zeros(len(start), dtype=bool)
        d = np.minimum(np.maximum(doc, 0), max(len(self.words) - 1, 0))
        inside[ok] = (start + w.length[win] <= self.first[d] + self.words[d])[ok]
        exact &= inside
        return win, start, exact


def search_index(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                 window: int = 10, slop: int = 3, gap: int = 64) -> DataFrame:
    """FOUND rows, one per indexed document: matched items, near items (exact ones included), hit word ranges."""
    if window + slop >= gap:
        raise ValueError("window + slop must stay below the index's gap")
    parts = [_search_block(index, block, slop, gap) for block in _blocks(items, item_col, text_col, window)]
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)

    def names(c):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    def add(done, x):
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(last["end"] >= x["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
                      ).otherwise(F.concat(done, F.array(x)))

    return (found.groupBy("segment", "doc_no", "doc_id", "n_words")
            .agg(names("items").alias("items"), names("near_items").alias("near_items"),
                 F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
            .withColumn("spans", F.aggregate("spans", F.slice("spans", 1, 0), add)))


def _search_block(index: DataFrame, w: Windows, slop: int, gap: int) -> DataFrame:
    order = w.rarest_first(_frequencies(index, w.vocabulary)) if len(w.terms) else np.zeros((0, 1), dtype=np.int64)

    def search(batches):
        import pyarrow as pa
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in
                    ("segment", "terms", "counts", "postings", "docs", "doc_words")]
            for segment, *row in zip(*cols):
                s = Segment(*row, gap)
                win, start, exact = s.search(w, order, slop)
                doc = np.clip(np.searchsorted(s.first, start, side="right") - 1, 0, max(len(s.words) - 1, 0))
                items = _names_by_doc(doc[exact], w.item[win[exact]], w.items)
                near = _names_by_doc(doc, w.item[win], w.items)
                cover = np.zeros(int(s.first[-1]) + 1, dtype=np.int64)
                np.add.at(cover, start[exact], 1)
                np.add.at(cover, start[exact] + w.length[win[exact]], -1)
                covered = np.cumsum(cover) > 0
                spans = []
                for d, (a, n) in enumerate(zip(s.first[:-1], s.words)):
                    if d not in items:
                        spans.append([])
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered[a:a + n].view(np.int8), [0]))))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(s.docs), segment), pa.int64()), pa.array(np.arange(len(s.docs)), pa.int32()),
                    pa.array(s.docs, pa.int64(), mask=s.docs == NULL_ID), pa.array(s.words, pa.int64()),
                    pa.array([items.get(d, []) for d in range(len(s.docs))], pa.list_(pa.string())),
                    pa.array([near.get(d, []) for d in range(len(s.docs))], pa.list_(pa.string())),
                    pa.array(spans, span)], names=["segment", "doc_no", "doc_id", "n_words", "items", "near_items", "spans"])

    return index.select("segment", "terms", "counts", "postings", "docs", "doc_words").mapInArrow(search, FOUND)


def _names_by_doc(doc: np.ndarray, item: np.ndarray, names: list[str | None]) -> dict[int, list[str | None]]:
    out: dict[int, set[str | None]] = {}
    if len(doc):
        for d, i in np.unique(np.vstack((doc, item)), axis=1).T.tolist():
            out.setdefault(d, set()).add(names[i])
    return {d: sorted(v, key=lambda x: (x is None, x or "")) for d, v in out.items()}


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  slop: int = 3) -> DataFrame:
    """Per document: n_words, items with exact matches, items with near matches only, hit word ranges."""
    gap = max(64, window + slop + 1)
    index = build_index(docs, id_col, text_col, gap)
    found = search_index(index, items, item_col, item_text_col, window, slop, gap)
    return found.select("doc_id", "n_words", "items", F.array_except("near_items", "items").alias("near_items"),
                        "spans")
