"""Conversation repair: cheapest edits by Four-Russians block tables.

A conversation is a string over a small alphabet (who speaks, whether the row
must go, whether its text is cut off). The cheapest edits that give role
initials ``(s?(ua)+)?`` follow from a cost vector: for each state of that
pattern, the least cost of the rows still to come. Less its minimum the vector
takes only a few values, so *every* vector is a number and one symbol a table
lookup; composing the table with itself gives the transition, and the cost it
adds, of every block of ``BLOCK`` symbols. Conversations are processed from
the end, block by block, all of a batch in step. Tracing expands each block
backward from the vector at its end into the vectors at its rows, and then goes
forward, taking at each row the ASCII-least edits that keep the least cost
(also from a table), so ties never depend on the way of computing.

*Spread.* Rows are dealt by conversation and sorted inside the partition by
Spark, which spills; faults are one window over the same exchange. A task reads
the sorted rows as a stream and holds one byte a row of a conversation, as long
as the audit it must return; texts are never gathered: the repaired text's hash is
taken from a second sorted stream, in which the audit comes before its rows.
A single hash over one conversation's text is sequential by its nature, so a
conversation is one task's work, however long; memory stays bounded.

Results for odd input: null ids are one conversation with a null id; null
roles and texts count as one space; rows with a null turn come first; rows of
one turn are ordered by role and text. An exactly repeated row is a duplicate.
A conversation without rows after damage returns zeros, an empty audit and
the hash of the empty string. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import parts_for

#: fixed values: costs of the edits, in the order Delete, Insert, Keep, Rerole, and of leaving a truncated row
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: states of the pattern: nothing yet, after s, after u, after a; the state after a kept or new initial
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U,
        (AFTER_U, "a"): AFTER_A}
EXPECTED = {START: "u", AFTER_S: "u", AFTER_A: "u", AFTER_U: "a"}
ROLE = {"u": "user", "a": "assistant"}
INITIALS = "sua?"
#: symbols: 2 * initial + truncated, then a row that must go, then nothing (fills the first block)
MUST_GO, NOTHING = 2 * len(INITIALS), 2 * len(INITIALS) + 1
SYMBOLS = NOTHING + 1
BLOCK = 4
SPACE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------ block tables --

def _inserted(costs) -> tuple:
    """The least costs when turns may be inserted first."""
    out = list(costs)
    for _ in range(len(out)):
        out = [min(c, INSERT + out[NEXT[s, EXPECTED[s]]]) for s, c in enumerate(out)]
    return tuple(out)


def _row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol < MUST_GO:
        initial, extra = INITIALS[symbol // 2], TRUNCATED * (symbol % 2)
        if (state, initial) in NEXT:
            out.append(("K", KEEP + extra, NEXT[state, initial]))
        out.append(("R", REROLE + extra, NEXT[state, EXPECTED[state]]))
    return out


def _before(symbol: int, after) -> tuple:
    """Cost vector before a row, from the one after it."""
    if symbol == NOTHING:
        return tuple(after)
    return _inserted([min(cost + after[to] for _, cost, to in _row_edits(symbol, s)) for s in range(4)])


class Tables:
    """Numbered normalised cost vectors, transitions by symbol and by block, and the tie-safe edits.

    ``step[v, x]``: vector before symbol x, ``add`` the cost it adds; ``jump``,
    ``jump_add``: the same for a block (its number: the symbols as digits, first
    symbol highest). ``edit[v, x, s]``: number of the edits that go before and
    with a row of symbol x in state s when v is the vector after it, ``to`` the
    state they lead to; ``last[s]``: insertions at the end.
    """

    def __init__(self, block: int = BLOCK) -> None:
        end = _inserted([0, np.inf, np.inf, 0])
        vectors, number, queue = [], {}, [end]
        while queue:
            v = queue.pop()
            if v in number:
                continue
            number[v] = len(vectors)
            vectors.append(v)
            queue += [tuple(c - min(w) for c in w) for w in (_before(x, v) for x in range(SYMBOLS))]
        self.block, self.vectors, self.end = block, np.array(vectors), number[end]
        self.step = np.zeros((len(vectors), SYMBOLS), dtype=np.int32)
        self.add = np.zeros((len(vectors), SYMBOLS), dtype=np.int64)
        texts: dict[str, int] = {}
        self.edit = np.zeros((len(vectors), SYMBOLS, 4), dtype=np.int32)
        self.to = np.zeros((len(vectors), SYMBOLS, 4), dtype=np.int8)
        for v in vectors:
            for x in range(SYMBOLS):
                w = _before(x, v)
                self.step[number[v], x], self.add[number[v], x] = number[tuple(c - min(w) for c in w)], min(w)
                for s in range(4):
                    text, to = self._edits(x, s, w, v)
                    self.edit[number[v], x, s] = texts.setdefault(text, len(texts))
                    self.to[number[v], x, s] = to
        self.texts = list(texts)
        self.last = [self._closing(s, end) for s in range(4)]
        self.jump, self.jump_add = self.step, self.add
        for _ in range(block - 1):  # one more symbol in front: its digit is the highest
            before = self.step[self.jump]                      # vector, block, new first symbol
            added = self.jump_add[:, :, None] + self.add[self.jump]
            self.jump = before.transpose(0, 2, 1).reshape(len(vectors), -1)
            self.jump_add = added.transpose(0, 2, 1).reshape(len(vectors), -1)

    @staticmethod
    def _edits(symbol: int, state: int, before, after) -> tuple[str, int]:
        """The ASCII-least cheapest edits up to and with this row."""
        if symbol == NOTHING:
            return "", state
        text = ""
        while True:
            rows = [(e, to) for e, cost, to in _row_edits(symbol, state) if cost + after[to] == before[state]]
            turn = NEXT[state, EXPECTED[state]]
            if INSERT + before[turn] == before[state]:
                rows.append(("I", turn))
            edit, to = min(rows)
            text, state = text + edit, to
            if edit != "I":
                return text, state

    @staticmethod
    def _closing(state: int, end) -> str:
        text = ""
        while end[state]:
            text, state = text + "I", NEXT[state, EXPECTED[state]]
        return text

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of rows of ``block`` symbols."""
        return symbols.reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))


_TABLES: dict[int, Tables] = {}


def tables(block: int = BLOCK) -> Tables:
    if block not in _TABLES:
        _TABLES[block] = Tables(block)
    return _TABLES[block]


def audits(symbols: np.ndarray, first: np.ndarray, tab: Tables) -> tuple[np.ndarray, list[str]]:
    """(cost, audit) of each conversation; ``first``: where each one's symbols start, and their end."""
    n = np.diff(first)
    k = tab.block
    n_blocks = -(-n // k)
    at = np.concatenate(([0], np.cumsum(n_blocks)))
    filled = np.full(int(at[-1]) * k, NOTHING, dtype=np.int64)  # filled up in front
    shift = at[1:] * k - first[1:]
    filled[np.arange(len(symbols)) + np.repeat(shift, n)] = symbols
    block = tab.blocks(filled)
    order = np.argsort(-n_blocks, kind="stable")
    active = np.searchsorted(-n_blocks[order], -np.arange(1, int(n_blocks.max(initial=0)) + 1), "right")
    vector = np.full(len(n), tab.end, dtype=np.int64)
    cost = np.zeros(len(n), dtype=np.int64)
    after = np.zeros(len(block), dtype=np.int64)  # vector at the end of each block
    for step, m in enumerate(active):
        who = order[:m]
        where = at[who + 1] - 1 - step
        after[where] = vector[who]
        cost[who] += tab.jump_add[vector[who], block[where]]
        vector[who] = tab.jump[vector[who], block[where]]
    cost += tab.vectors[vector, START].astype(np.int64)
    rows = filled.reshape(-1, k)
    behind = np.zeros(rows.shape, dtype=np.int64)  # vector after each row, expanded backward from the block's end
    for c in range(k - 1, -1, -1):
        behind[:, c] = after
        after = tab.step[after, rows[:, c]]
    state = np.full(len(n), START, dtype=np.int64)
    edit = np.zeros(rows.shape, dtype=np.int64)
    for step, m in enumerate(active):  # forward: the longest ones start first, so that all end together
        who = order[:m]
        where = at[who] + step
        for c in range(k):
            v, x = behind[where, c], rows[where, c]
            edit[where, c] = tab.edit[v, x, state[who]]
            state[who] = tab.to[v, x, state[who]]
    said = [tab.texts[e] for e in edit.ravel().tolist()]
    return cost, ["".join(said[at[i] * k:at[i + 1] * k]) + tab.last[state[i]] for i in range(len(n))]


# ------------------------------------------------------------------- spark --

def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present) after the contract's damage; a dropped row stays with present false."""
    filled = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = filled.withColumn("kind", F.crc32(F.encode(key, "UTF-8")) % 20)
    gone = F.col("kind") == 0
    return kind.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, F.lit(None)).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(gone, F.lit(None)).when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (~gone).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def symbol_of(role: Column, text: Column, seen: Column) -> tuple[Column, Column, Column]:
    """(symbol, blank, truncated) of a row, by its first fault."""
    bare = F.rtrim(text, F.lit(SPACE))
    blank = bare == ""
    cut = ~blank & ~seen & ~F.substring(bare, -1, 1).isin(".", "!", "?")
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    symbol = F.when(blank | seen, F.lit(MUST_GO)).otherwise(2 * initial + cut.cast("int"))
    return symbol, blank, cut


SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string")
HELD_ROWS = 1 << 16


def _streams(batches) -> Iterator:
    """Whole conversations of a sorted stream, some at a time: columns as arrays, cut at a conversation's end."""
    import pyarrow as pa
    held: list = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < HELD_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        conv = t.column(0)
        ids = conv.fill_null(0).to_numpy()
        null = conv.is_null().to_numpy()
        other = (null != null[-1]) | (~null & ~null[-1] & (ids != ids[-1]))
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _borders(t) -> np.ndarray:
    """Where each conversation starts in a sorted table, and the table's end."""
    conv = t.column("conv_id")
    ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy()
    new = np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1
    return np.concatenate(([0], new, [len(ids)]))


def _summaries(batches) -> Iterator:
    """Sorted rows (conv_id, present, turn, initial, symbol, blank, duplicate, truncated) to SUMMARY rows."""
    import pyarrow as pa
    tab = tables()
    for t in _streams(batches):
        if not t.num_rows:
            continue
        edges = _borders(t)
        conv = t.column("conv_id").take(pa.array(edges[:-1]))
        present = t.column("present").to_numpy()
        kept = np.concatenate(([0], np.cumsum(present)))[edges]  # a conversation's rows after damage
        t = t.filter(t.column("present"))
        col = {c: t.column(c).to_numpy() for c in ("initial", "symbol", "blank", "duplicate", "truncated")}
        of = np.repeat(np.arange(len(edges) - 1), np.diff(kept))
        n = len(edges) - 1

        def counted(flag):
            return np.bincount(of, weights=flag, minlength=n).astype(np.int64)

        turn, null = t.column("turn").fill_null(0).to_numpy(), t.column("turn").is_null().to_numpy()
        has = np.flatnonzero(~null)
        gaps = np.zeros(n, dtype=np.int64)
        if len(has):  # turns are in order
            mine, value = of[has], turn[has]
            new = np.append(True, (mine[1:] != mine[:-1]) | (value[1:] != value[:-1]))
            start = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            stop = np.append(start[1:], len(mine)) - 1
            distinct = np.bincount(mine[new], minlength=n)
            gaps[mine[start]] = value[stop] - value[start] + 1 - distinct[mine[start]]
        two = col["initial"][:-1] * 4 + col["initial"][1:]
        legal = np.isin(two, [INITIALS.index(x) * 4 + INITIALS.index(y) for x, y in ("su", "ua", "au")])
        illegal = np.zeros(len(of))
        illegal[1:] = (of[1:] == of[:-1]) & ~legal
        cost, audit = audits(col["symbol"], kept, tab)
        yield pa.RecordBatch.from_arrays([
            conv.combine_chunks() if isinstance(conv, pa.ChunkedArray) else conv, pa.array(gaps),
            *(pa.array(counted(x)) for x in (col["blank"], col["duplicate"], col["truncated"], illegal)),
            pa.array(cost), pa.array(audit, pa.string())], names=[c.split()[0] for c in SUMMARY.split(", ")])


REPAIRED = SUMMARY + ", repaired_sha256 string"


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired `role:text` lines of one conversation, row by row."""
    state = START
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = (ROLE[EXPECTED[state]], "") if edit == "I" else next(rows)
        if edit == "R":
            role = ROLE[EXPECTED[state]]
        state = NEXT[state, role[:1]]
        yield f"{role}:{text}"


def _hashed(batches) -> Iterator:
    """A stream of conversations, each one's summary before its sorted rows, to REPAIRED rows."""
    import pyarrow as pa
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    out: list[tuple] = []

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("is_row", *names[:-1], "role", "text")))

    stream = rows()
    head = next(stream, None)
    while head is not None:
        following = None

        def own():
            nonlocal following
            for r in stream:
                if not r[0]:
                    following = r
                    return
                yield r[-2], r[-1]

        mine, digest, sep = own(), hashlib.sha256(), b""
        for line in repaired_lines(head[8], mine):
            digest.update(sep + line.encode())
            sep = b"\n"
        for _ in mine:  # what the audit leaves over: nothing, but the next summary is found here
            pass
        out.append((*head[1:9], digest.hexdigest()))
        head = following
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=_schema(names))
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=_schema(names))


def _schema(names):
    import pyarrow as pa
    return pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])


def repair(rows: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every conversation.

    ``rows``: (conv_id, turn, role, text, present), as ``damaged`` makes them.
    Returns REPAIRED columns.
    """
    spark = rows.sparkSession
    if n_bytes is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    parts = parts_for(n_bytes, spark)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition(parts, "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "present")
                               .orderBy(F.col("turn").asc_nulls_first())) > 1
    symbol, blank, cut = symbol_of(F.col("role"), F.col("text"), F.col("seen"))
    first = F.substring("role", 1, 1)
    summary = (dealt.withColumn("seen", seen).withColumns({
        "symbol": symbol, "blank": blank, "duplicate": ~blank & F.col("seen"), "truncated": cut,
        "initial": F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)})
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "present", *order)
        .select("conv_id", "present", "turn", "initial", "symbol",
                *(F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in ("blank", "duplicate", "truncated")))
        .mapInArrow(_summaries, SUMMARY))
    lines = rows.where("present").select("conv_id", "turn", "role", "text")
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    none = F.lit(None)
    both = (summary.select(F.lit(False).alias("is_row"), *names, none.cast("long").alias("turn"),
                           none.cast("string").alias("role"), none.cast("string").alias("text"))
            .unionByName(lines.select(F.lit(True).alias("is_row"), "conv_id",
                                      *(none.cast("string" if c == "audit" else "long").alias(c) for c in names[1:]),
                                      "turn", "role", "text")))
    return (both.repartition(parts, "conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "is_row", *order)
            .mapInArrow(_hashed, REPAIRED))
