"""HTML main text: declared structure, and a host suffix array for what pages of a host share.

A page is scanned once into blocks of text, each with a mark: text of a
declared main container (``article``, ``main``), furniture by its element or
class (menus, headers, footers, sidebars, notices, adverts, forms, comments), or
undeclared. The words outside declared main containers are the page's token
stream. *Host suffix array*: all suffixes of all streams of a host in the
order of their first ``min_tokens`` tokens; neighbours from distinct pages that
agree in that many mark a repeat, and the words that repeats cover are
boilerplate. Undeclared blocks lose their covered runs and keep the others;
furniture is never kept; main containers, if a page declares any, are kept
whole, because copies of an article on one host are text, not template.

*Spread.* The array is cut by leading tokens, not by host: a suffix goes to the
bucket of (host, first tokens), where all suffixes that agree in them meet, so a
host with a third of all pages is spread like any other. Each slot of pages
folds equal suffixes first (first page, and whether there is another), so a
footer that is on every page of a host reaches its bucket once per slot. In a
bucket the suffixes are sorted and neighbours compared; what repeats goes back
to the slots that hold it. Keys are 128 bits of hash of the host and the tokens.

Results for odd input: null or empty html has an empty text; pages cut off in
the middle, unclosed and stray tags are read as far as they go; a null url is a
host of its own name (empty). Rows that repeat a page (id and url) count as one
page, and each gets its row. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import FINE_BYTES, FINE_SLOTS, PACKED, RETURNED, SLOT_BYTES, back_to_slots, buckets_for, cut_by_bucket, \
    packed_rows, parts_for, returned, slots_in

#: shortest run of words that counts as shared
MIN_TOKENS = 6

# Element names of HTML by what they do here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title noscript template iframe object svg math canvas audio video map "
                   "textarea select datalist xmp noembed noframes".split())
FURNITURE = frozenset("nav menu header footer aside form button fieldset dialog".split())
MAIN = frozenset("article main".split())
#: an open element of the second kind ends where an element of the first kind begins
CLOSES = {**{b: frozenset(["p"]) for b in BLOCKS - {"option", "optgroup"}}, "li": frozenset(["li", "p"]),
          **{x: frozenset(["dt", "dd", "p"]) for x in ("dt", "dd")}, "option": frozenset(["option"]),
          "tr": frozenset(["tr", "td", "th"]), **{x: frozenset(["td", "th"]) for x in ("td", "th")}}
#: elements that such a search does not leave
SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog "
                            "menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted "
    "promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

#: class names that tell of a page's state, not of an element's use
STATES = ("has-", "with-", "no-", "without-", "is-", "js-", "has_", "with_", "no_")

#: marks of blocks
KEPT, DROPPED, UNDECLARED = b"k", b"d", b"u"
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+(?:>|\Z)
                 |<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S | re.X)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)")  # a quote is never closed
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
WORD = re.compile(r"[A-Za-z]+")


def _kind(name: str, attributes: str) -> bytes | None:
    """What an element makes of its text: KEPT, DROPPED, or None (as around it)."""
    if name in HIDDEN or name in FURNITURE:
        return DROPPED
    kind = KEPT if name in MAIN else None
    if attributes and "=" in attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            key = key.lower()
            if key in ("class", "id"):
                said = {w for c in value.split() if not c.startswith(STATES) for w in WORD.findall(c)}
                if name not in ("html", "body") and not FURNITURE_WORDS.isdisjoint(said):
                    return DROPPED
            elif key == "role":
                if value.strip() in FURNITURE_ROLES:
                    return DROPPED
                if value.strip() in ("main", "article"):
                    kind = KEPT
            elif "articlebody" in value.split():
                kind = KEPT
    return kind


def blocks_of(page: str) -> list[tuple[str, bytes]]:
    """(text, mark) of every non-empty block of a page, in order."""
    out: list[tuple[str, bytes]] = []
    #: text of the block so far, and of furniture in it, which does not end it
    parts: list[str] = []
    waste: list[str] = []
    around = UNDECLARED  # mark of ``parts``
    #: open elements: name, and the mark of their text; a furniture element's inside stays furniture
    open_: list[tuple[str, bytes]] = []
    mark = UNDECLARED

    def flush(held: list[str], as_: bytes):
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, as_))

    def end_block():
        flush(parts, around)
        flush(waste, DROPPED)

    def put(text: str):
        (waste if mark == DROPPED else parts).append(text)

    def turn(now: bytes):
        nonlocal mark, around
        if mark == DROPPED != now:
            flush(waste, DROPPED)
        if now not in (DROPPED, around):
            flush(parts, around)
            around = now
        mark = now

    def reopen(size: int):
        del open_[size:]
        turn(open_[-1][1] if open_ else UNDECLARED)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if m is None:  # a bare <
            put("<")
            at = lt + 1
            continue
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if name in BLOCKS:
            end_block()
        if m.group(1):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    reopen(k)
                    break
            continue
        if name in VOID:
            if name == "br":
                put(" ")
            continue
        closes = CLOSES.get(name)
        if closes:
            k = len(open_)
            while k and open_[k - 1][0] not in SCOPE:
                k -= 1
                if open_[k][0] in closes:
                    reopen(k)
            while k and open_[k - 1][0] in closes:  # cells are scopes of their own
                k -= 1
                reopen(k)
        kind = _kind(name, m.group(3))
        if m.group(3).endswith("/") and name not in BLOCKS:
            continue
        inner = DROPPED if mark == DROPPED else kind or mark
        open_.append((name, inner))
        turn(inner)
        if name in RAW:  # no markup inside
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = close.start() if close else n
            put(page[at:stop])
            at = stop
    end_block()
    if any(m == KEPT for _, m in out):
        return [(t, DROPPED if m == UNDECLARED else m) for t, m in out]
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def host_name(url: str | None) -> str:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m.group(1).translate(LOWER) if m else ""


PARSED = "page_id long, url string, host string, text binary, marks binary"


def _parsed(batches) -> Iterator:
    """Pages to their blocks: texts joined by line breaks (compressed for the exchange), one mark each."""
    import pyarrow as pa
    import zstandard
    packer = zstandard.ZstdCompressor()
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            urls = part.column(1).to_pylist()
            found = [blocks_of(h) if h else [] for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([host_name(u) for u in urls], pa.string()),
                pa.array([packer.compress("\n".join(t for t, _ in f).encode()) for f in found], pa.binary()),
                pa.array([b"".join(m for _, m in f) for f in found], pa.binary())],
                names=[c.split()[0] for c in PARSED.split(", ")])


def _unpacked(rows, columns: list[str]) -> Iterator[tuple]:
    """The named columns of parsed pages, row by row, texts as they were."""
    import zstandard
    opener = zstandard.ZstdDecompressor()
    return zip(*([opener.decompress(x).decode() for x in rows.column(c).to_pylist()] if c == "text"
                 else rows.column(c).to_pylist() for c in columns))


# ---------------------------------------------------------- suffix array --

SUFFIX = np.dtype([("key", "<u8"), ("check", "<u8"), ("page", "<u8"), ("more", "?")])
KEY = np.dtype([("key", "<u8"), ("check", "<u8")])


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=16).digest()


def streams(text: str | None, marks: bytes) -> list[tuple[int, list[str]]]:
    """(block number, words) of the blocks outside declared main containers."""
    if not text:
        return []
    return [(k, t.split()) for k, (t, m) in enumerate(zip(text.split("\n"), marks)) if m != KEPT[0]]


def suffix_keys(host: str, words: list[str], min_tokens: int) -> np.ndarray:
    """The key of every suffix of at least ``min_tokens`` words: host and first words."""
    n = len(words) - min_tokens + 1
    if n < 1:
        return np.zeros(0, dtype=KEY)
    raw = [w.encode() for w in words]
    h = host.encode()
    return np.frombuffer(b"".join(_digest(h, *raw[i:i + min_tokens]) for i in range(n)), dtype=KEY)


def _page_key(page_id, url) -> int:
    return int.from_bytes(_digest(repr(page_id).encode(), (url or "").encode())[:8], "little")


def slot_suffixes(rows, min_tokens: int) -> np.ndarray:
    """The distinct suffixes of a slot's pages, each with a page it is on and whether it is on another."""
    keys, pages = [], []
    for page_id, url, host, text, marks in rows:
        k = suffix_keys(host, [w for _, words in streams(text, marks) for w in words], min_tokens)
        keys.append(k)
        pages.append(np.full(len(k), _page_key(page_id, url), dtype=np.uint64))
    out = np.zeros(sum(map(len, keys)), dtype=SUFFIX)
    if len(out):
        k = np.concatenate(keys)
        out["key"], out["check"], out["page"] = k["key"], k["check"], np.concatenate(pages)
    return merged_suffixes(out)


def merged_suffixes(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes, equal ones as one: ``more`` if they come from distinct pages."""
    if not len(s):
        return s
    s = s[np.lexsort((s["page"], s["check"], s["key"]))]
    new = np.append(True, (s["key"][1:] != s["key"][:-1]) | (s["check"][1:] != s["check"][:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(s)) - 1
    out = s[start]
    out["more"] = np.logical_or.reduceat(s["more"], start) | (s["page"][start] != s["page"][stop])
    return out


def _shared(batches) -> Iterator:
    """Buckets: suffixes that neighbours from distinct pages agree in, back to the slots that hold them."""
    items, slots = [], []
    for b in batches:
        for slot, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            items.append(np.frombuffer(data, dtype=SUFFIX))
            slots.append(np.full(len(items[-1]), slot, dtype=np.int32))
    if not items:
        return
    s, slot = np.concatenate(items), np.concatenate(slots)
    order = np.lexsort((s["page"], s["check"], s["key"]))
    s, slot = s[order], slot[order]
    start = np.flatnonzero(np.append(True, (s["key"][1:] != s["key"][:-1]) | (s["check"][1:] != s["check"][:-1])))
    stop = np.append(start[1:], len(s)) - 1
    repeated = np.logical_or.reduceat(s["more"], start) | (s["page"][start] != s["page"][stop])
    take = np.repeat(repeated, np.diff(np.append(start, len(s))))
    yield back_to_slots(slot[take], s[take][["key", "check"]].astype(KEY), 0)


def page_text(host: str, text: str | None, marks: bytes, repeated: set, min_tokens: int) -> str:
    """The kept blocks, undeclared ones without the words that repeats cover."""
    if not text:
        return ""
    own = streams(text, marks)
    covered = np.zeros(sum(len(w) for _, w in own), dtype=bool)
    if UNDECLARED[0] in marks:
        for i, k in enumerate(suffix_keys(host, [w for _, words in own for w in words], min_tokens).tolist()):
            if k in repeated:
                covered[i:i + min_tokens] = True
    left, at = {}, 0
    for k, words in own:
        if marks[k] == UNDECLARED[0]:
            left[k] = " ".join(w for w, c in zip(words, covered[at:at + len(words)]) if not c)
        at += len(words)
    out = (t if marks[k] == KEPT[0] else left.get(k, "") for k, t in enumerate(text.split("\n")))
    return "\n".join(t for t in out if t)


RESULT = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The main text of every page, blocks joined by one line break. Returns RESULT columns."""
    spark = pages.sparkSession
    told = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    n_bytes = int(told.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0)
    parts = parts_for(n_bytes, spark)
    slots = max(64, 2 * parts, -(-n_bytes // SLOT_BYTES), min(FINE_SLOTS, n_bytes // FINE_BYTES))
    buckets = buckets_for(parts, slots)
    columns = ["page_id", "url", "host", "text", "marks"]
    dealt = told.mapInArrow(_parsed, PARSED).select(
        F.pmod(F.xxhash64("page_id", "url", "text"), F.lit(slots)).cast("int").alias("slot"), *columns) \
        .repartition(parts, "slot")

    def suffixes(batches):
        import pyarrow as pa
        for b in batches:
            for s, idx in slots_in(b):
                rows = b.take(pa.array(idx))
                found = slot_suffixes(_unpacked(rows, columns), min_tokens)
                if len(found):
                    yield packed_rows((k, s, found[at].tobytes()) for k, at in cut_by_bucket(found["key"], buckets))

    def cut(key, left, right):
        import pyarrow as pa
        repeated = set(returned(right, 0, KEY).tolist())
        texts = [page_text(*row, repeated, min_tokens) for row in _unpacked(left, columns[2:])]
        return pa.table([left.column("page_id"), left.column("url"), pa.array(texts, pa.string()),
                         pa.array([len(t) for t in texts], pa.int64())], names=[c.split()[0] for c in RESULT.split(", ")])

    shared = dealt.mapInArrow(suffixes, PACKED).repartition(parts, "bucket").mapInArrow(_shared, RETURNED)
    return (dealt.groupBy("slot").cogroup(shared.repartition(parts, "slot").groupBy("slot")).applyInArrow(cut, RESULT))
