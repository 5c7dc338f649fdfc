"""Token-id output as one wavelet matrix per shard.

A shard holds the token ids of a run of documents in ascending id order. Its
file is self-contained: a header, the document table, and one bit-plane per id
bit (highest first). Each plane is stored with rank counts every ``RANK_BITS``
bits and compressed by itself, so a reader opens only the planes that it
needs. From the one file a reader gets any token (``access``), how often an id
occurs in a range (``count``), and where (``select``, ``occurrences``), in one
step per plane; whole shards are decoded plane by plane.

The files are written by Spark as rows of a Parquet table (one payload a row),
so writes are atomic, retried with their task, and work on any file system
Spark writes to. ``payload`` is the file's format; it can be saved and opened
by itself.

Documents are dealt by id range, so that shards ascend, and encoded where
they arrive; no task holds more than one shard's ids at a time.

Null text is empty: its document has the end id alone. Repeated rows are kept
each. A null id orders last. An empty table gives no shard. Other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NULL_ID, ids_of, parts_for, stored, text_bytes
from .text import BLOCK_MASK, LOWER, as_bytes, chunked, word_hashes

MAGIC = b"WVMX1\0"
RANK_BITS = 512
#: token ids of a shard at most (a longer document makes a longer shard)
SHARD_TOKENS = 4 << 20
#: text bytes of a partition of the id ranges
PART_BYTES = 24 << 20
SHARDS = "part int, shard int, first_id long, n_docs long, n_tokens long, payload binary"
ROWS = "part int, shard int, doc_no int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
#: pieces that a worker knows at most before it starts anew, and slots for twice as many
_KNOWN_PIECES = 900_000
_SLOT_BITS = 21
#: text bytes encoded at a time, and tokens of a plane undone at a time: their arrays fit a core's cache
ENCODE_BYTES = 256 << 10
UNDO_TOKENS = 32 << 10


# ---------------------------------------------------------------- encoding --

_BLANK, _LETTER, _DIGIT, _OTHER, _END, _WHOLE, _ODD = 0, 1, 2, 3, 4, 5, 9


def _byte_classes() -> np.ndarray:
    """Class of a byte; odd where the byte alone doesn't settle it."""
    c = np.full(256, _ODD, dtype=np.uint8)
    c[0x21:0x7F] = _OTHER
    c[ord("0"):ord("9") + 1] = _DIGIT
    for lo, hi in (("a", "z"), ("A", "Z")):
        c[ord(lo):ord(hi) + 1] = _LETTER
    c[[ord("'"), ord("<")]] = _ODD  # contractions, special tokens
    c[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK  # words are cut at these only; other white space stays for the tokenizer
    return c


_CLASS = _byte_classes().tobytes()
_LOWER = LOWER.tobytes()
_GROUP = 256
#: pieces of every settled character, alone and after a letter
_SETTLED = [x + chr(i) for i in (*range(0x21, 0x7F), *range(0xDF, 0x100)) if i != 0xF7 and not chr(i).isupper()
            and chr(i) not in "'<" for x in (("", "a") if chr(i).isalpha() else ("",))]


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for every n given."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, class) of the pieces of all texts, in order; each text ends with the piece ``_END``.

    Pieces are runs of letters, single digits, and runs of other characters,
    lower-cased; the tokenizer splits there too. Of the non-ASCII letters those
    of the two-byte range C3 80 - C3 BF are settled by their bytes (but for the
    two signs among them). A word with any other byte is one piece, unchanged
    (``_WHOLE``).
    """
    joined = bytearray(b" ".join(texts) + b" ")
    buf = np.frombuffer(joined, dtype=np.uint8)
    c = np.frombuffer(joined.translate(_CLASS), dtype=np.uint8)
    low = np.frombuffer(joined.translate(_LOWER), dtype=np.uint8)
    c[np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1] = _END
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    after = buf[lead + 1]
    letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    lead, after = lead[letter], after[letter]
    c[lead] = c[lead + 1] = _LETTER
    low[lead + 1] = after + np.where(after < 0x9F, 0x20, 0).astype(np.uint8)
    odd = np.flatnonzero(c == _ODD)
    if len(odd):
        gap = np.flatnonzero((c == _BLANK) | (c == _END))
        word = np.searchsorted(gap, odd)
        word = word[np.append(True, word[1:] != word[:-1])]
        lo = np.where(word > 0, gap[word - 1] + 1, 0)
        size = gap[word] - lo
        inside = np.repeat(lo, size) + _steps(size)
        c[inside] = _WHOLE
        low[inside] = buf[inside]
    new = np.empty(len(c), dtype=bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    new |= (c == _DIGIT) | (c == _END)
    at = np.flatnonzero(new)
    kind = c.take(at)
    kept = np.flatnonzero(kind)
    return low, at.take(kept), np.append(at[1:], len(c)).take(kept), kind.take(kept)


def _eights(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes at each place (fewer where fewer are left) as one number."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(eight).view("<u8").ravel() & BLOCK_MASK[left]


class Encoder:
    """Token ids of whole texts; equal pieces are encoded once.

    The tokenizer drops white space and splits at it before anything else, so
    a text's ids are those of its blank-separated words in order, and a word's
    those of its pieces where its bytes settle them. New pieces go to the
    tokenizer many at a time, the settled ones without its normalizer and its
    split where these change nothing (tried on every settled character); the ids are told apart by the
    vocabulary's word ends, one for every piece. Words whose pieces their bytes
    don't settle are encoded one by one, by the whole tokenizer.

    Known pieces are found by their hash, from the slot of its first bits on,
    and their bytes are compared: the hash of up to 8 bytes is one to one for
    each length, longer ones are compared eight bytes at a time. A piece that
    differs from the known one of its hash is encoded by itself. Piece 0 is the
    end of a text; an empty slot holds it.
    """

    _of: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this Python worker, with what its earlier tasks learnt."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.settled = Tokenizer(self.tokenizer.model)
        self.settled.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if any(a.ids != b.ids for a, b in zip(*(t.encode_batch_fast(_SETTLED, add_special_tokens=False)
                                                for t in (self.settled, self.tokenizer)))):
            self.settled = self.tokenizer  # it changes settled pieces, or their bytes
        self.end_id = -1

    def reset(self, end_id: int) -> None:
        """Forget all pieces but the end of a text, whose bytes are one blank."""
        self.end_id = end_id
        self.n = self.n_ids = self.n_raw = 0
        self.hashes = np.zeros(1024, dtype=np.uint64)
        self.at = np.zeros(1024, dtype=np.int64)
        self.size = np.zeros(1024, dtype=np.int32)
        self.raw_at = np.zeros(1024, dtype=np.int64)
        self.raw_size = np.zeros(1024, dtype=np.int32)
        self.ids = np.zeros(4096, dtype=np.uint32)
        self.raw = np.zeros(8192, dtype=np.uint8)
        self.bits = _SLOT_BITS
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        blank, one = np.frombuffer(b" ", dtype=np.uint8), np.ones(1, dtype=np.int64)
        self._keep(word_hashes(blank, one - 1, one), np.array([end_id], dtype=np.uint32), one, blank, one)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known piece of each hash, 0 where none has it; where none has it)."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        known = self.slots.take(slot)
        first = rest = np.flatnonzero(self.hashes.take(known) != hashes)
        rest = rest[known[rest] > 0]
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            known[rest] = self.slots[slot[rest]]
            rest = rest[(known[rest] > 0) & (self.hashes[known[rest]] != hashes[rest])]
        # the hash of the end may stand behind a taken slot
        return known, first[(known[first] == 0) & (hashes[first] != self.hashes[0])]

    def _deal(self, piece: np.ndarray) -> None:
        """Give known pieces the next empty slot from that of their hash on."""
        slot = (self.hashes[piece] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(piece):
            empty = self.slots[slot] == 0
            self.slots[slot[empty]] = piece[empty]
            left = self.slots[slot] != piece
            piece, slot = piece[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: np.ndarray,
              raw_size: np.ndarray) -> None:
        """Append pieces; arrays grow by doubling, so that a piece is moved few times."""
        n, n_ids, n_raw = self.n, self.n_ids, self.n_raw
        self.n, self.n_ids, self.n_raw = n + len(hashes), n_ids + len(ids), n_raw + len(raw)
        for name, lo, hi, values in (
                ("hashes", n, self.n, hashes), ("at", n, self.n, n_ids + np.cumsum(size) - size),
                ("size", n, self.n, size), ("raw_at", n, self.n, n_raw + np.cumsum(raw_size) - raw_size),
                ("raw_size", n, self.n, raw_size), ("ids", n_ids, self.n_ids, ids), ("raw", n_raw, self.n_raw, raw)):
            have = getattr(self, name)
            if len(have) < hi + 8:  # eight bytes can be read at any place of raw
                have = np.concatenate((have, np.zeros(max(len(have), hi + 8 - len(have)), dtype=have.dtype)))
                setattr(self, name, have)
            have[lo:hi] = values
        if 2 * self.n > len(self.slots):
            self.bits = (2 * self.n).bit_length()
            self.slots = np.zeros(1 << self.bits, dtype=np.int32)
            n = 1
        self._deal(np.arange(max(n, 1), self.n, dtype=np.int32))

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words encoded one by one."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter((i for g in got for i in g), dtype=np.uint32, count=int(size.sum())), size

    def _encoded_groups(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of settled pieces, ``_GROUP`` at a time."""
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        texts = [b" ".join(pieces[i:i + _GROUP]).decode() for i in range(0, len(pieces), _GROUP)]
        for g, e in enumerate(self.settled.encode_batch_fast(texts, add_special_tokens=False)):
            got = np.array(e.ids, dtype=np.uint32)
            group = pieces[g * _GROUP:(g + 1) * _GROUP]
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(group) and ends[-1] == len(got):
                size = np.diff(ends, prepend=0)
            else:  # a vocabulary without word ends
                got, size = self._encoded(group)
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, settled: np.ndarray,
               hashes: np.ndarray) -> None:
        """Encode the pieces given and keep their ids and bytes under ``hashes``."""
        raw = low.tobytes()
        quick, slow = np.flatnonzero(settled), np.flatnonzero(~settled)
        order = np.concatenate((quick, slow))
        cut = [raw[a:b] for a, b in zip(start[order].tolist(), end[order].tolist())]
        ids, size = self._encoded_groups(cut[:len(quick)])
        if len(slow):
            more, sizes = self._encoded(cut[len(quick):])
            ids, size = np.concatenate((ids, more)), np.concatenate((size, sizes))
        self._keep(hashes[order], ids, size, np.frombuffer(b"".join(cut), dtype=np.uint8), (end - start)[order])

    def _other(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those of the known piece of their hash."""
        size = end - start
        differ = size != self.raw_size.take(known)
        long = np.flatnonzero(~differ & (size > 8))
        if len(long):
            blocks = (size[long] + 7) >> 3
            step = 8 * _steps(blocks)
            left = np.minimum(np.repeat(size[long], blocks) - step, 8)
            padded = np.concatenate((low, np.zeros(8, dtype=np.uint8)))
            unequal = _eights(padded, np.repeat(start[long], blocks) + step, left) != \
                _eights(self.raw, np.repeat(self.raw_at[known[long]], blocks) + step, left)
            differ[long] = np.logical_or.reduceat(unequal, np.cumsum(blocks) - blocks)
        return np.flatnonzero(differ)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; ids per text)."""
        if end_id != self.end_id or self.n > _KNOWN_PIECES:
            self.reset(end_id)
        low, start, end, kind = _pieces(texts)
        hashes = word_hashes(low, start, end)
        known, new = self._find(hashes)
        if len(new):
            own, first = np.unique(hashes[new], return_index=True)
            i = new[first]
            self._learn(low, start[i], end[i], kind[i] != _WHOLE, own)
            known[new] = self._find(hashes[new])[0]
        at, size, ids = self.at.take(known), self.size.take(known), self.ids
        other = self._other(low, start, end, known)
        if len(other):
            raw = low.tobytes()
            more, sizes = self._encoded([raw[a:b] for a, b in zip(start[other].tolist(), end[other].tolist())])
            at[other] = len(ids) + np.cumsum(sizes) - sizes
            size[other] = sizes
            ids = np.concatenate((ids, more))
        done = np.cumsum(size, dtype=np.int64)
        out = ids.take(np.repeat(at - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0))
        return out, np.diff(done[kind == _END], prepend=0)


# --------------------------------------------------------------- the shard --

def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_tokens: np.ndarray) -> bytes:
    """The file of one shard."""
    import pyarrow as pa
    import zstandard
    z = zstandard.ZstdCompressor(level=1)
    levels = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, zeros = [], []
    for k in range(levels - 1, -1, -1):
        packed = np.packbits((now & now.dtype.type(1 << k)) != 0, bitorder="little")
        planes.append(packed)
        # an Arrow filter reads the packed bits as they are
        tokens, one, zero = pa.array(now), *(pa.Array.from_buffers(pa.bool_(), len(now), [None, pa.py_buffer(p)])
                                             for p in (packed, ~packed))
        first = tokens.filter(zero)
        zeros.append(len(first))
        now = np.concatenate((first.to_numpy(), tokens.filter(one).to_numpy()))
    blobs = []
    for packed in planes:
        packed = np.concatenate((packed, np.zeros(-len(packed) % (RANK_BITS // 8), dtype=np.uint8)))
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1)
        rank = np.append(0, np.cumsum(ones)).astype("<u4")
        blobs.append(z.compress(packed.tobytes()))
        blobs.append(z.compress(rank.tobytes()))
    blobs.append(z.compress(doc_ids.astype("<i8").tobytes()))
    blobs.append(z.compress(doc_tokens.astype("<u4").tobytes()))
    head = struct.pack(f"<6sBQI{levels}Q{len(blobs)}Q", MAGIC, levels, len(ids), len(doc_ids), *zeros,
                       *(len(b) for b in blobs))
    return head + b"".join(blobs)


class Shard:
    """Reader of one shard's file; planes are opened when first needed."""

    def __init__(self, payload: bytes):
        magic, self.levels, self.n, self.n_docs = struct.unpack_from("<6sBQI", payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<6sBQI")
        self.zeros = struct.unpack_from(f"<{self.levels}Q", payload, at)
        at += 8 * self.levels
        sizes = struct.unpack_from(f"<{2 * self.levels + 2}Q", payload, at)
        at += 8 * len(sizes)
        self._blob = []
        for s in sizes:
            self._blob.append(payload[at:at + s])
            at += s
        self._open: dict[int, np.ndarray] = {}

    def _part(self, i: int, dtype: str) -> np.ndarray:
        if i not in self._open:
            import zstandard
            self._open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._blob[i]), dtype=dtype)
        return self._open[i]

    @property
    def doc_ids(self) -> np.ndarray:
        return self._part(2 * self.levels, "<i8")

    @property
    def doc_tokens(self) -> np.ndarray:
        return self._part(2 * self.levels + 1, "<u4").astype(np.int64)

    def bit(self, level: int, i: int) -> int:
        return int(self._part(2 * level, "u1")[i >> 3] >> (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        plane, rank = self._part(2 * level, "u1"), self._part(2 * level + 1, "<u4")
        block = i // RANK_BITS
        n = int(rank[block])
        lo, hi = block * RANK_BITS // 8, i >> 3
        n += int(np.bitwise_count(plane[lo:hi]).sum())
        if i & 7:
            n += (int(plane[hi]) & ((1 << (i & 7)) - 1)).bit_count()
        return n

    def select(self, level: int, one: int, k: int) -> int:
        """Position of the ``k``-th (from 0) bit of value ``one`` in a plane."""
        rank = self._part(2 * level + 1, "<u4").astype(np.int64)
        have = rank if one else np.arange(len(rank)) * RANK_BITS - rank
        block = int(np.searchsorted(have, k, side="right")) - 1
        lo = block * RANK_BITS
        bits = np.unpackbits(self._part(2 * level, "u1")[lo // 8:(lo + RANK_BITS) // 8], bitorder="little")
        return lo + int(np.flatnonzero(bits == one)[k - int(have[block])])

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            b = self.bit(k, i)
            ones = self.rank1(k, i)
            i = self.zeros[k] + ones if b else i - ones
            value = value << 1 | b
        return value

    def _down(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in positions [lo, hi)."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._down(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """All positions of ``token``, ascending."""
        if token < 0 or token >> self.levels:
            return []
        a, b = self._down(token, 0, self.n)
        out = []
        for i in range(a, b):
            for k in range(self.levels - 1, -1, -1):
                one = token >> (self.levels - 1 - k) & 1
                i = self.select(k, one, i - self.zeros[k] if one else i)
            out.append(i)
        return sorted(out)

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes from the lowest."""
        now = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self._part(2 * k, "u1"), bitorder="little", count=self.n).view(bool)
            up = np.empty_like(now)
            a, b = 0, self.zeros[k]
            now[b:] |= now.dtype.type(1 << (self.levels - 1 - k))
            for lo in range(0, self.n, UNDO_TOKENS):
                block, one = up[lo:lo + UNDO_TOKENS], bit[lo:lo + UNDO_TOKENS]
                zeros, ones = np.flatnonzero(~one), np.flatnonzero(one)
                block[zeros], block[ones] = now[a:a + len(zeros)], now[b:b + len(ones)]
                a, b = a + len(zeros), b + len(ones)
            now = up
        return now.astype("<u4")


# ------------------------------------------------------------------- Spark --

def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """SHARDS rows in ascending id order, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts_for(text_bytes(rows), docs.sparkSession, PART_BYTES)
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last())

    def encode(batches):
        import os
        import pyarrow as pa
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        part = TaskContext.get().partitionId()
        encoder = Encoder.of(tokenizer)
        ids, sizes, docs_, held, shard = [], [], [], 0, 0

        def flush():
            all_ids, all_sizes, all_docs = np.concatenate(ids), np.concatenate(sizes), np.concatenate(docs_)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(all_docs[0])], pa.int64()),
                pa.array([len(all_docs)], pa.int64()), pa.array([len(all_ids)], pa.int64()),
                pa.array([pack(all_ids, all_docs, all_sizes)], pa.binary())],
                names=["part", "shard", "first_id", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            texts, own = as_bytes(batch.column(1)), ids_of(batch.column(0))
            for lo, hi in chunked(map(len, texts), ENCODE_BYTES):
                got, size = encoder.encode(texts[lo:hi], end_id)
                if held and held + len(got) > shard_tokens:
                    yield flush()
                    ids, sizes, docs_, held, shard = [], [], [], 0, shard + 1
                ids.append(got.astype(np.uint16) if int(got.max()) < 65536 else got)
                sizes.append(size)
                docs_.append(own[lo:hi])
                held += len(got)
        if held:
            yield flush()

    return stored(ordered.mapInArrow(encode, SHARDS), "wavelet-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    def read(batches):
        import pyarrow as pa
        for batch in batches:
            for part, number, payload in zip(*(batch.column(n).to_pylist() for n in ("part", "shard", "payload"))):
                s = Shard(payload)
                ids, size = s.tokens().tobytes(), s.doc_tokens
                end = np.cumsum(size)
                crc = [zlib.crc32(ids[4 * (b - n):4 * b]) for b, n in zip(end.tolist(), size.tolist())]
                n = s.n_docs
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, number), pa.int32()),
                    pa.array(np.arange(n), pa.int32()), pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NULL_ID),
                    pa.array(end - size, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_no", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    # tokens of earlier partitions (one row each) and of earlier shards of the same partition
    by_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    part_start = by_part.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and 1 preceding) as before")
    starts = (shards.selectExpr("part", "shard", "sum(n_tokens) over (partition by part order by shard "
                                "rows between unbounded preceding and 1 preceding) as inside")
              .join(part_start, "part")
              .select("part", "shard", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("base")))
    return (shards.select("part", "shard", "payload").mapInArrow(read, ROWS).join(starts, ["part", "shard"])
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))
