"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from basketry.llm.repair import BLOCK, MUST_GO, SYMBOLS, Tables, audits, damaged, repair

SCHEMA = "conv_id long, turn long, role string, text string, symbol int, seen string"


def brute_damage(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        mine = convs[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    for c in convs.values():
        c.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return convs


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Dijkstra over (cost, audit), so the first goal is the ASCII-least cheapest; the pattern as a regex's states."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "0", "")], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "0a":
            return cost, audit, out.split("\0")[1:]
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[state, role[0]], out + "\0" + role + ":"))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
        if fault[i] in ("blank", "duplicate"):
            continue
        extra = 5 * (fault[i] == "truncated")
        _, role, text = rows[i]
        for new, edit, c in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
            if (state, new[:1]) in step:
                heapq.heappush(heap, (cost + c + extra, audit + edit, i + 1, step[state, new[:1]],
                                      out + "\0" + new + ":" + text))


def brute(rows):
    out = []
    for conv, mine in brute_damage(rows).items():
        f = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        two = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, lines = cheapest(mine, f)
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                    sum(x not in ("su", "ua", "au") for x in two), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "a"])
            text = rng.choice(["Hello.", "What? ", "no end", "", " \t", None, "Same!", "Ünï!\n", "x" * 50 + ".", "a. b"])
            rows.append((None if c == 3 else c, rng.choice([turn, turn, turn, None]), role, text))
            turn += rng.randrange(0, 3)
    return rows


def test_repair_matches_search(spark, monkeypatch):
    rows = conversations(1, 150)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = repair(damaged(df))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_repair_streams_long_conversations(spark):
    """Conversations longer than the batches and than what a task holds at a time."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"t{t}!"]))
            for c in range(4) for t in range(700)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, repair(damaged(df)).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 0, "")], SCHEMA)
    assert [tuple(r) for r in repair(damaged(df)).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair(damaged(df.limit(0))).collect() == []


@pytest.mark.parametrize("block", [1, 2, 3, BLOCK])
def test_block_length_changes_nothing(block):
    rng = np.random.RandomState(block)
    n = rng.randint(0, 30, size=200)
    symbols = rng.randint(0, MUST_GO + 1, size=n.sum())
    first = np.concatenate(([0], np.cumsum(n)))
    want = audits(symbols, first, Tables(1))
    got = audits(symbols, first, Tables(block))
    assert got[0].tolist() == want[0].tolist() and got[1] == want[1]
    assert Tables(block).jump.shape[1] == SYMBOLS ** block
