"""Word and byte operators against brute-force versions on small tables with edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from basketry.llm.jaccard_join import choose_prefix, jaccard_components
from basketry.llm.lm import bin_estimate, em_weights, estimate_bins, lm_scores
from basketry.llm.positional_index import contamination
from basketry.llm.substring import substring_dedup
from basketry.llm.suffix_array import permuted_lcp, suffix_array, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def seen_before(sequence_of, texts, size):
    """Positions covered by a run of ``size`` items that starts earlier in (id, start) order."""
    seen, gone = set(), {}
    for i, t in texts:
        s = sequence_of(t)
        flags = [False] * len(s)
        for k in range(len(s) - size + 1):
            key = tuple(s[k:k + size])
            if key in seen:
                flags[k:k + size] = [True] * size
            seen.add(key)
        gone[i] = (s, flags)
    return gone


def test_substring_dedup_matches_brute_force(docs, texts):
    got = {r.doc_id: r for r in substring_dedup(docs, min_words=20).collect()}
    for i, (w, flags) in seen_before(space_words, texts, 20).items():
        kept = " ".join(x for x, f in zip(w, flags) if not f)
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), sum(flags), kept)
        assert sum(s.end - s.start for s in got[i].spans) == sum(flags)


def test_substring_dedup_keeps_spacing(docs, texts):
    got = {r.doc_id: r for r in substring_dedup(docs, min_words=20, keep_spacing=True).collect()}
    for i, (w, flags) in seen_before(space_words, texts, 20).items():
        assert space_words(got[i].text) == [x for x, f in zip(w, flags) if not f]
        if not any(flags):
            assert got[i].text == (dict(texts)[i] or "")


def test_suffix_array_and_prefixes_match_sorting():
    rng = np.random.RandomState(3)
    for trial in range(120):
        k = int(rng.choice([1, 2, 3, 250]))
        t = np.append(rng.randint(1, k + 1, size=rng.randint(1, 70)), 0).astype(np.int16)
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix_array(t)
        assert sa.tolist() == want
        plcp, _ = permuted_lcp(t, sa)
        for a, b in zip(want, want[1:]):
            m = 0
            while max(a, b) + m < len(s) and s[a + m] == s[b + m]:
                m += 1
            assert plcp[b] == m


@pytest.mark.parametrize("hot", [2048, 3])
def test_suffix_dedup_matches_brute_force(docs, texts, hot):
    got = {r.doc_id: r for r in suffix_dedup(docs, min_bytes=100, hot=hot).collect()}
    for i, (b, flags) in seen_before(lambda t: (t or "").encode(), texts, 100).items():
        kept = bytes(x for x, f in zip(b, flags) if not f)
        runs = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].spans)) == (len(b), sum(flags), runs)
        assert bytes(got[i].text) == kept


@pytest.mark.parametrize("hot", [1 << 17, 3])
def test_suffix_dedup_cuts_every_row_of_an_id(spark, hot):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b, c = text(200), text(240), text(230)
    rows = [(3, a), (5, a), (5, a)]  # two equal rows of one id
    rows += [(3, b), (None, b), (None, b), (None, b)]
    rows += [(13, c + text(80)), (15, c[20:] + text(70)), (15, c[20:] + text(90)), (15, text(50) + c)]  # unequal rows
    rows += [(None, c[20:] + text(k)) for k in range(60, 90, 3)]  # null ids over several slots
    d = text(150)
    rows += [(23, text(10) + d[:120]), (25, text(40) + d), (25, d), (25, d + "x")]
    key = lambda i: 1 << 62 if i is None else i
    seen = {}
    for i, t in rows:
        for k in range(len(t) - 99):
            seen[t[k:k + 100]] = min(seen.get(t[k:k + 100], (1 << 63, 0)), (key(i), k))
    want = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            if (key(i), k) > seen[t[k:k + 100]]:
                gone[k:k + 100] = [True] * 100
        want.append((str(i), t, "".join(x for x, g in zip(t, gone) if not g), sum(gone)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup(table, min_bytes=100, hot=hot).collect()
    assert sorted((str(r.doc_id), bytes(r.text).decode(), r.n_removed) for r in got) == sorted(
        (i, kept, n) for i, _, kept, n in want)
    assert sum(n == len(t) for i, t, _, n in want if t in (a, b)) == 5


def shingles(t, k):
    w = space_words((t or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, pct):
    sets = {i: shingles(t, k) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= pct * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,pct", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components_match_brute_force(docs, texts, k, pct):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, shingle=k, percent=pct).collect()}
    assert got == brute_components(texts, k, pct)


def test_longer_prefix_where_candidates_are_many():
    cold, need = choose_prefix(np.zeros(100), 100, 90)
    hot, more = choose_prefix(np.full(100, 50.0), 100, 90)
    assert (cold, need) == (11, 1) and more > 1 and hot == 10 + more


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_contamination_matches_brute_force(spark, docs, texts):
    w = alnum(texts[5][1])
    items = [(1, " ".join(w[3:17])), (2, texts[6][1].upper()), (3, "one"), (4, None), (5, ""), (6, "not anywhere here"),
             (7, " ".join(w[3:9] + w[10:15])), (1, " ".join(w[3:17]))]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in contamination(docs, table, window=10, slop=2).collect()}
    for i, t in texts:
        d = alnum(t)
        hit, found = [False] * len(d), set()
        for item, x in items:
            v = alnum(x)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(d) - n + 1):
                    if d[b:b + n] == v[a:a + n]:
                        hit[b:b + n] = [True] * n
                        found.add(str(item))
        r = got[i]
        assert (r.n_words, sorted(r["items"]), sum(s.end - s.start for s in r.spans)) == (len(d), sorted(found), sum(hit))
    assert "7" in got[5].near_items  # the document has one word more in between: a proximity match only


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_items_with_a_null_id_are_searched(spark, tmp_path, monkeypatch, block):
    import corpus_pipeline as cp
    from basketry.llm import positional_index as pi
    from basketry.llm.queries import op4_decontamination
    from basketry.llm.sql import SQL
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(pi, "BLOCK_BYTES", block)
    passage = lambda x: " ".join(f"{x}{i}" for i in range(12))
    docs = [(1, f"a b {passage('p')} c"), (2, f"{passage('q')} d {passage('p')}"), (3, "clean words only"), (4, passage("r"))]
    items = [(None, passage("p")), (None, passage("r")), (7, passage("q")), (None, None), (None, "")]
    (spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs],
                           "doc_id long, text string, lang string, source string, n_chars long")
     .write.parquet(f"{tmp_path}/documents.parquet"))
    spark.createDataFrame(items, "item_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op4_decontamination(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["op4_decontamination"]).fetchall())
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got} == {
        1: (12, 1, True), 2: (24, 2, True), 3: (0, 0, False), 4: (12, 1, True)}
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in cp.benchmark_free(spark, table, str(tmp_path)).collect()] == [3]


def test_search_in_blocks_gives_the_same(spark, docs, texts, monkeypatch):
    from basketry.llm import positional_index as pi
    table = spark.createDataFrame([(k, texts[k][1]) for k in range(8)], "item_id int, text string")
    whole = {tuple(map(str, r)) for r in contamination(docs, table).select("doc_id", "n_words", "items", "spans").collect()}
    monkeypatch.setattr(pi, "BLOCK_BYTES", 600)
    cut = {tuple(map(str, r)) for r in contamination(docs, table).select("doc_id", "n_words", "items", "spans").collect()}
    assert whole == cut


def brute_scores(texts, order):
    toks = [(i, space_words((t or "").translate(LOW)) + ["</s>"]) for i, t in texts]
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in toks}

    def grams(t, k):
        p = ["<s>"] * (k - 1) + t
        return [tuple(p[j:j + k]) for j in range(len(t))]
    from collections import Counter
    full, part = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for i, t in toks:
        for k in range(1, order + 1):
            if fold[i] != 2:
                full[k].update(grams(t, k))
            if fold[i] == 3:
                part[k].update(grams(t, k))
    n, v = sum(full[1].values()), len(full[1])
    d, fn, fd = sum(f != 2 for f in fold.values()), sum(part[1].values()), sum(f == 3 for f in fold.values())

    def estimates(t, counts, n, d):
        g = [grams(t, k) for k in range(1, order + 1)]
        for j in range(len(t)):
            p, c = [counts[1][g[0][j]] / n], n
            for k in range(2, order + 1):
                c = d if j == 0 else counts[k - 1][g[k - 2][j - 1]]
                p.append(counts[k][g[k - 1][j]] / c if c else 0.0)
            yield (int(np.floor(np.log2(c))) + 1 if c else 0), p
    left = [None] + [Counter({g: c - part[k][g] for g, c in full[k].items()}) for k in range(1, order + 1)]
    events = Counter()
    for i, t in toks:
        if fold[i] == 3:
            for j, (b, p) in enumerate(estimates(t, left, n - fn, d - fd)):
                # bins: the first order's count; estimates above, but counts at a text's begin
                x = np.array([p[0] * (n - fn)] + [q * (d - fd if j == 0 else 1) for q in p[1:]]).round(9)
                scale = np.array([n - fn] + [d - fd if j == 0 else 1] * (order - 1))
                r = bin_estimate(estimate_bins(x)) / scale * (v + 1)
                events[(b, *r.tolist())] += 1
    keys, count = np.array(list(events)), np.array(list(events.values()), dtype=float)
    weights, pooled = em_weights(keys[:, 0].astype(int), np.vstack((np.ones(len(keys)), keys[:, 1:].T)), count)
    out = {}
    for i, t in toks:
        base = sum(np.log10((full[1][(x,)] + 1) / (n + v + 1)) for x in t)
        s = 0.0
        for b, p in estimates(t, full, n, d):
            w = weights.get(b, pooled)
            s += np.log10(w[0] / (v + 1) + sum(a * c for a, c in zip(w[1:], p)))
        out[i] = (fold[i] == 2, len(t), sum(full[1][(x,)] > 0 for x in t), n, base, s)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_match_brute_force(docs, texts, order):
    want = brute_scores(texts, order)
    got = {r.doc_id: r for r in lm_scores(docs, order=order).collect()}
    assert got.keys() == want.keys()
    for i, (held, n, known, train, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-7)
    held = [x for x in want.values() if x[0]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)  # better than the unigram base on held-out texts


def test_em_weights_sum_to_one():
    w, pooled = em_weights(np.array([1, 1, 2]), np.array([[1.0, 1, 1], [0, 8, 3], [9, 0, 0]]), np.array([5.0, 2, 1]))
    assert pooled.sum() == pytest.approx(1) and all(x.sum() == pytest.approx(1) and (x > 0).all() for x in w.values())


@pytest.mark.parametrize("op", [
    lambda d: substring_dedup(d), lambda d: suffix_dedup(d), lambda d: jaccard_components(d), lambda d: lm_scores(d)])
def test_empty_tables(no_docs, op):
    assert op(no_docs).count() == 0


@pytest.mark.parametrize("odd", [None, 5, 2**63 - 1])
def test_jaccard_join_keeps_texts_of_one_id_apart(spark, odd):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, one), (odd, one + " x"), (odd, two + " x"), (2, two), (odd, "alone"), (odd, ""), (odd, two + " x")]
    want = [("1", 1), ("2", 2), (str(odd), 1), (str(odd), 2), (str(odd), 2), (str(odd), odd), (str(odd), odd)]
    for order in (rows, rows[::-1]):
        got = jaccard_components(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(((str(r.doc_id), r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_null_ids_and_repeated_rows(spark, odd_docs):
    cut = substring_dedup(odd_docs).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, cut), key=str) == sorted([(5, 0), (5, 0), (None, 60), (None, 0), (3, 0), (9, 60)], key=str)
    cut = {(r.doc_id, r.n_removed > 0) for r in suffix_dedup(odd_docs).collect()}
    assert cut == {(5, False), (None, True), (None, False), (3, False), (9, True)}
    comp = sorted(((r.doc_id, r.n_shingles) for r in jaccard_components(odd_docs).collect()), key=str)
    assert len(comp) == 6
    assert lm_scores(odd_docs).count() == 6
    items = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(10)))], "item_id int, text string")
    assert sorted((str(r.doc_id), len(r["items"])) for r in contamination(odd_docs, items).collect()) == [
        ("3", 0), ("5", 1), ("5", 1), ("9", 1), ("None", 0), ("None", 1)]
    assert contamination(odd_docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_suffix_dedup_holds_one_bucket_at_a_time(spark, monkeypatch):
    """However much lies in a partition, a task makes arrays of one bucket; more text means more buckets."""
    from basketry.llm import suffix_array as sa
    rows = [(b, 3, k, bytes([b, k % 256]), b"") for b in (2, 5, 9) for k in range(300)]
    import pyarrow as pa
    names = ["bucket", "slot", "kind", "data", "extra"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[lo:lo + 350]]) for lo in range(0, 900, 350)]
    assert list(map(list, sa._by_bucket(iter(batches)))) == [rows[:300], rows[300:600], rows[600:]]
    assert list(sa._by_bucket(iter([]))) == []
    # rows out of fewer, larger buckets are the same
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    docs = spark.createDataFrame([(i, text[i:] + f" {i} " * 40 + text[:200]) for i in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, suffix_dedup(docs).collect()))
    monkeypatch.setattr(sa, "BUCKET_BYTES", 50)
    assert sorted(map(tuple, suffix_dedup(docs).collect())) == want and any(r[3] for r in want)
