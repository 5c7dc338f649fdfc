"""Cross-tokenizer alignment against a plain version that looks at every byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from basketry.llm.align import Tokenizers, align, diagonal_cuts, overlaps

P = pytest.importorskip("public_tokenizers")
FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def brute(rows):
    """The contract, byte by byte, with the slower library for A."""
    from tokenizers import Tokenizer
    import sentencepiece
    tok = Tokenizers(*FILES[:2])
    a_lib, b_lib = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_lib.encode_special_tokens = True
    out, links = [], []
    for doc_id, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(tok.a_bytes[i] for i in a) != raw or b"".join(tok.b_bytes[i] for i in b) != raw:
            a, b = [], []
        at_a = [k for k, i in enumerate(a) for _ in tok.a_bytes[i]]
        at_b = [k for k, i in enumerate(b) for _ in tok.b_bytes[i]]
        pairs = sorted(set(zip(at_a, at_b)))
        groups, ga, gb = [], [], []
        for p in range(len(at_a)):
            end_a = p + 1 == len(at_a) or at_a[p + 1] != at_a[p]
            end_b = p + 1 == len(at_b) or at_b[p + 1] != at_b[p]
            if end_a:
                ga.append(a[at_a[p]])
            if end_b:
                gb.append(b[at_b[p]])
            if end_a and end_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        links.append([(a[i], b[j]) for i, j in pairs])
        out.append((doc_id, len(a), len(b), len(groups), len(pairs),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(x for ls in links for x in ls)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return Counter((*o[:5], sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), o[5])
                   for o, ls in zip(out, links))


def odd_texts():
    rng = random.Random(5)
    low = [chr(c) for c in range(1, 0x250)]
    out = ["<s> x <|endoftext|> <unk>", "a▁b", "  two  spaces ", " lead", "日本語 テキスト 🙂", "tab\t\n\nx", "0", " "]
    out += ["".join(rng.choices(low, k=rng.randrange(1, 60))) for _ in range(60)]
    out += ["".join(rng.choices(["the ", "don't ", "12", "  ", "\n", "é", "Ω", "x" * 40], k=30)) for _ in range(20)]
    return out


def test_align_matches_bytewise_version(spark, texts):
    rows = texts + [(1000 + k, t) for k, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, chunk string, kind string")
    got = align(docs.repartition(4), *FILES, chunk_bytes=3000)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_align_null_ids_repeats_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(map(tuple, align(odd_docs, *FILES).collect())) == brute(rows)
    assert align(no_docs, *FILES).collect() == []


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100])
def test_pieces_are_stitched(piece):
    rng = np.random.RandomState(piece)
    for _ in range(30):
        n = rng.randint(1, 60)
        a = np.append(np.flatnonzero(rng.rand(n) < 0.4) + 1, n + 1)
        b = np.append(np.flatnonzero(rng.rand(n) < 0.5) + 1, n + 1)
        ia, ib, closed = overlaps(a, b, piece)
        at_a, at_b = np.searchsorted(a, np.arange(n + 1), "right"), np.searchsorted(b, np.arange(n + 1), "right")
        assert list(zip(ia, ib)) == sorted(set(zip(at_a, at_b)))
        assert a[closed].tolist() == sorted(set(a) & set(b))


def test_diagonals_cut_the_merge_evenly():
    a, b = np.array([1, 3, 3, 9]), np.array([3, 4, 5])
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    for d in range(8):
        assert diagonal_cuts(a, b, np.array([d]))[0] == sum(side == 0 for _, side in merged[:d])


def test_both_libraries_split_common_letters_alike():
    fast, slow = Tokenizers(*FILES), Tokenizers(*FILES[:2])
    texts = [" " + t for t in odd_texts()]
    assert fast.fast is not None and fast.encode_a(texts) == slow.encode_a(texts)
