"""Two words that every polynomial hash modulo 2**64 takes for one must stay two in every operator."""

import numpy as np
import pytest

from basketry.llm.jaccard_join import jaccard_components
from basketry.llm.lm import lm_scores
from basketry.llm.positional_index import contamination
from basketry.llm.substring import substring_dedup
from basketry.llm.text import SPACE_WORDS, words_of
from basketry.llm.wavelet import read_documents, write_shards

TURNS = [bin(i).count("1") % 2 for i in range(1024)]  # Thue-Morse
A, B = ("".join(letters[t] for t in TURNS) for letters in ("ab", "ba"))
TAIL = " ".join(f"t{i}" for i in range(19))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, f"{A} {TAIL}"), (2, f"{B} {TAIL}")], "doc_id long, text string")


def test_hashes_of_all_lengths_differ():
    rng = np.random.RandomState(0)
    words = [bytes(rng.choice([97, 98], size=n).tolist()) for n in range(20, 60) for _ in range(200)]
    words += [b"a" * n for n in range(1, 600)] + [A.encode(), B.encode(), b"x\0", b"x"]
    h = words_of(words, SPACE_WORDS, lower=False).hash
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    again = words_of([b"  ".join(words)], SPACE_WORDS, lower=False).hash  # wherever the word stands
    assert (again == h).all()


def test_jaccard_join(pair):
    got = jaccard_components(pair, shingle=20, percent=90).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2)]


def test_substring_dedup(pair):
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(pair, min_words=20).collect()) == [(1, 0), (2, 0)]


def test_decontamination(spark, pair):
    item = spark.createDataFrame([("i", f"{A} " + " ".join(TAIL.split()[:9]))], "item_id string, text string")
    got = {r.doc_id: len(r.spans) for r in contamination(pair, item, window=10, slop=0).collect()}
    assert got == {1: 1, 2: 0}


def test_tokens(spark, pair):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = read_documents(write_shards(pair, path, end_id=2)).collect()
    crc = {r.doc_id: r.ids_crc32 for r in rows}
    import zlib
    for doc_id, text in ((1, f"{A} {TAIL}"), (2, f"{B} {TAIL}")):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        assert crc[doc_id] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_lm_counts(spark):
    rows = [(i, A) for i in range(20)] + [(i, B) for i in range(100, 101)]
    import zlib
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(i, t) for i, t in rows[:20]] + [(held, B)], "doc_id long, text string")
    r = lm_scores(df, order=2, folds=7, test_fold=2, em_fold=3).where(f"doc_id = {held}").first()
    assert (r.held_out, r.n_tokens, r.n_known) == (True, 2, 1)  # the end alone is known


@pytest.mark.parametrize("buckets", [0, 3])  # 3: most pieces over 8 bytes share a hash, so their bytes must tell
def test_encoder_equals_the_tokenizer(monkeypatch, buckets):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    from basketry.llm import wavelet
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    if buckets:
        real = wavelet.word_hashes
        monkeypatch.setattr(wavelet, "word_hashes", lambda low, start, end: np.where(
            end - start > 8, real(low, start, end) % np.uint64(buckets), real(low, start, end)))
    rng = np.random.RandomState(1)
    parts = ["Abc", "éÉÀß", "ÿþ", "×÷", "12", "...", "it's", "'ll", "<|endoftext|>", "日本", "é", " ", "İ",
             "x" * 300, "y" * 300, "z" * 9, "Übermäßig", "ÜBERMÄSSIG", "_-_", "a1b2", "\x00", " ", "naïve,", "ſ", "K"]
    texts = ["", " ", "\t\n", *parts, *(
        "".join(rng.choice([*parts, " ", "  ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    encoder = wavelet.Encoder(path)
    for lo, hi in ((0, 100), (100, len(texts))):
        ids, size = encoder.encode([t.encode() for t in texts[lo:hi]], 2)
        want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts[lo:hi]]
        assert size.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("bits", [1, 21])  # 1: nearly all known pieces have lost their slot
def test_known_pieces_are_found_by_slot(monkeypatch, bits):
    P = pytest.importorskip("public_tokenizers")
    from basketry.llm import wavelet
    monkeypatch.setattr(wavelet, "_SLOT_BITS", bits)
    rng = np.random.RandomState(2)
    words = ["".join(rng.choice(list("abcdefghij"), rng.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 50)).encode() for _ in range(60)]
    path = P.path("word_bpe_49k.json")
    encoder, sorted_ = wavelet.Encoder(path), []
    real = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: (sorted_.append(len(x)), real(x, **k))[1])
    got = [encoder.encode(texts[lo:lo + 20], 2)[0] for lo in (0, 20, 40)]
    sorted_.clear()
    got.append(encoder.encode(texts[:20], 2)[0])
    again = sum(sorted_)  # the last pass knows all its pieces
    want = [wavelet.Encoder(path).encode(texts[lo:lo + 20], 2)[0] for lo in (0, 20, 40, 0)]
    assert all((a == b).all() for a, b in zip(got, want))
    if bits > 1:
        assert again < 50  # of 1,000


def test_known_pieces_are_not_sorted_again(monkeypatch):
    """However many pieces want the same slots, those known are found without sorting the batch."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    from basketry.llm import wavelet
    monkeypatch.setattr(wavelet, "_SLOT_BITS", 1)
    rng = np.random.RandomState(3)
    words = ["".join(rng.choice(list("abcdefghij\u00e9"), rng.randint(1, 14))) for _ in range(3000)]
    texts = ["", *(" ".join(rng.choice(words, 50)) for _ in range(200)), ""]
    path = P.path("word_bpe_49k.json")
    encoder, sorted_ = wavelet.Encoder(path), []
    raw = [t.encode() for t in texts]
    for lo in range(0, len(raw), 50):
        encoder.encode(raw[lo:lo + 50], 2)
    real = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: (sorted_.append(len(x)), real(x, **k))[1])
    ids, size = encoder.encode(raw, 2)
    assert sum(sorted_) == 0
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    ids, _ = encoder.encode(raw[:20], 7)  # another end id
    assert ids.tolist() == [i for x in want[:20] for i in x[:-1] + [7]]


def test_settled_pieces_skip_normalizer_and_split_only_where_these_change_nothing(tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, normalizers as N
    from basketry.llm import wavelet
    path = P.path("word_bpe_49k.json")
    encoder = wavelet.Encoder(path)
    assert encoder.settled is not encoder.tokenizer
    tok = Tokenizer.from_file(path)
    tok.normalizer = N.Sequence([N.NFD(), N.StripAccents(), N.Lowercase()])
    other = str(tmp_path / "no_accents.json")
    tok.save(other)
    text = "\u00c9t\u00e9 na\u00efve 12 a-b \u00fcbung, ete"
    for p in (path, other):
        want = Tokenizer.from_file(p).encode(text, add_special_tokens=False).ids + [2]
        assert wavelet.Encoder(p).encode([text.encode()], 2)[0].tolist() == want
