"""Packing, URL filter, wavelet shards, language ID, embedding graphs and the pipeline on small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm.hnsw import Graph, layer_of, near_duplicates
from basketry.llm.language_id import identify, page_evidence
from basketry.llm.packing import best_fit, bin_cost, pack_documents, pack_shard
from basketry.llm.url_filter import Rule, domain_of, filter_urls, host_of, host_reputation, path_of, suffix_of
from basketry.llm.wavelet import Shard, pack, read_documents, write_shards

P = pytest.importorskip("public_tokenizers")


# --------------------------------------------------------------- packing --

def check_bins(rows, lengths, capacities):
    by_bin, pieces = {}, {}
    for r in rows:
        by_bin.setdefault(r.bin_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for b in by_bin.values():
        b = sorted(b, key=lambda r: r.bin_start)
        fill = 0
        for r in b:
            assert r.bin_start == fill
            fill += r.length
        assert b[0].capacity == min(c for c in capacities if c >= fill)
    got = sorted(sum(r.length for r in x) for x in pieces.values())
    assert got == sorted(lengths)


def test_packing_keeps_every_token(docs, texts):
    caps = (64, 256, 1024)
    rows = pack_documents(docs, capacities=caps).collect()
    check_bins(rows, [len((t or "").split()) + 1 for _, t in texts], caps)


def test_packing_null_ids_repeats_and_empty(odd_docs, no_docs):
    rows = pack_documents(odd_docs, capacities=(32, 128)).collect()
    assert sum(r.length for r in rows) == 61 + 61 + 61 + 1 + 1 + 62
    assert pack_documents(no_docs).count() == 0


def test_best_fit_takes_the_fullest_bin_and_joint_choice_is_cheapest():
    where, opened = best_fit([60, 50, 40, 30], [100], lambda c: c)
    assert where == [0, 1, 0, 1] and len(opened) == 2
    rng = np.random.RandomState(0)
    lengths = rng.randint(1, 500, size=300)
    where, _, cap = pack_shard(lengths, (128, 512, 1024))
    total = sum(bin_cost(c) for c in dict(zip(where.tolist(), cap.tolist())).values())
    for only in ((512,), (1024,)):
        w, _, c = pack_shard(lengths, only)
        assert total <= sum(bin_cost(x) for x in dict(zip(w.tolist(), c.tolist())).values())


# ------------------------------------------------------------ url filter --

RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/")]


def test_url_parts(spark):
    urls = [("HTTP://A.Example.COM:80/x/Y?q=/z#f", "a.example.com:80", "/x/Y"), ("no scheme", "", ""), (None, "", ""),
            ("ftp://h?x://y/z", "h", ""), ("http://É.de/\nb", "É.de", "/\nb"), ("x://", "", "")]
    got = spark.createDataFrame([(u,) for u, _, _ in urls], "u string").select(host_of(F.col("u")), path_of(F.col("u")))
    assert [tuple(r) for r in got.collect()] == [(h, p) for _, h, p in urls]
    hosts = spark.createDataFrame([("a.b.co.uk",), ("u@b.com:8080",), ("10.0.0.1:9",), ("localhost",)], "h string")
    got = hosts.select(domain_of(F.col("h"), ("co.uk",)), suffix_of(F.col("h"), ("co.uk",))).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("10.0.0.1", "10.0.0.1"),
                                      ("localhost", "localhost")]


def test_rules_and_reputation(spark):
    rows, outcomes = [], []
    for k in range(400):
        host = ["good.net", "bad.net", "x.bad.net", "rare.org"][k % 4] if k % 4 < 3 or k < 8 else "fine.org"
        rows.append((k, f"http://{host}/p{k}", host))
        outcomes.append((k, int("bad" in host) if k % 10 else 0))
    rows += [(900, "https://www.example.com/en/1", "x"), (901, "https://example.com/en/1", "x"),
             (902, "https://shop.com/", "x"), (903, "https://shop.com", "x"), (904, None, "x"), (905, "https://new.bad.net/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    told = spark.createDataFrame(outcomes + [(1, None), (7777, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in filter_urls(pages, told, RULES).collect()}
    assert len(got) == len(rows)
    assert [(got[i].rule, got[i].verdict) for i in (900, 901, 902, 903, 904)] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), (None, "allow"), (None, "allow")]
    assert got[1].verdict == "block" and got[0].verdict == "allow" and got[3].verdict == "allow"
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"))
    rep = {r.host: r for r in host_reputation(judged, told).collect()}
    assert 0.5 < rep["bad.net"].rate < 1 and rep["rare.org"].rate < 0.3
    # a host without labels has its domain's rate and a wide posterior
    assert rep["new.bad.net"].rate > rep["fine.org"].rate and rep["new.bad.net"].bad_bound < rep["bad.net"].bad_bound


def test_url_filter_without_outcomes_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert {r.verdict for r in filter_urls(pages, none, []).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), none, RULES).count() == 0


# --------------------------------------------------------------- wavelet --

@pytest.mark.parametrize("top,n", [(1, 5), (3, 700), (49408, 3000), (70000, 1200), (5, 0)])
def test_wavelet_shard_answers(top, n):
    rng = np.random.RandomState(n)
    ids = rng.randint(0, top, size=n).astype(np.uint32)
    s = Shard(pack(ids, np.arange(2), np.array([n, 0])))
    assert s.tokens().tolist() == ids.tolist() and s.doc_tokens.tolist() == [n, 0]
    for i in range(0, n, max(1, n // 50)):
        assert s.access(i) == ids[i]
    for t in set(ids[:20].tolist()) | {top + 1, -1}:
        assert s.count(t) == int((ids == t).sum())
        assert s.count(t, n // 4, n // 2) == int((ids[n // 4:n // 2] == t).sum())
        assert s.occurrences(t) == np.flatnonzero(ids == t).tolist()


def test_wavelet_shard_of_several_blocks(monkeypatch):
    from basketry.llm import wavelet
    monkeypatch.setattr(wavelet, "UNDO_TOKENS", 64)
    ids = np.random.RandomState(4).zipf(1.2, size=1000).clip(max=60_000).astype(np.uint32)
    ids[100:300] = 7  # blocks of one token
    s = Shard(pack(ids, np.arange(1), np.array([1000])))
    assert s.tokens().tolist() == ids.tolist() == [s.access(i) for i in range(1000)]


@pytest.mark.parametrize("shard_tokens", [1 << 22, 300])
def test_wavelet_round_trip(spark, docs, texts, no_docs, odd_docs, shard_tokens):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = [(100, "a<|endoftext|>b c"), (101, "e\u0301 x\u0085y\u2003z it's 3.14"), (102, "\x1c a\x0bb")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r for r in read_documents(write_shards(more, path, shard_tokens=shard_tokens)).collect()}
    start = 0
    for i, t in list(texts) + odd:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    assert read_documents(write_shards(no_docs, path)).count() == 0
    assert read_documents(write_shards(odd_docs, path)).count() == 6


# ----------------------------------------------------------- language ID --

LETTERS = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}


def test_language_id_accuracy_and_edges(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(300):
        lang = list(LETTERS)[i % 3]
        text = " ".join("".join(rng.choice(list(LETTERS[lang]), 5)) for _ in range(3 + i % 40))
        rows.append((i, text, lang if i % 5 else None, f"s{i % 3}", 0))
    rows += [(900, None, None, None, 0), (901, "", "xx", None, 0), (902, "123 !?", None, "s0", 0), (None, "abc de", "xx", "s0", 0),
             (5, "fghij", "zz", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    pages = spark.createDataFrame(
        [(1, "http://a.b.net/xx/0.html?q=1", "<HTML class=a LANG='xx-YY'>"), (2, "http://a.b.net/7", None), (3, None, "<html>")],
        "page_id long, url string, html string")
    assert {tuple(r) for r in page_evidence(pages).collect()} == {(0, "a.b.net", "xx"), (7, "a.b.net", None)}
    got = identify(docs, page_evidence(pages)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert all(by[i].language == list(LETTERS)[i % 3] and by[i].accepted for i in range(300) if i != 5)
    assert not (by[900].accepted or by[901].accepted or by[902].accepted)
    assert identify(docs.limit(0)).count() == 0
    blank = identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert blank.count() == len(rows) and blank.where("accepted").count() == 0


def test_language_id_uses_every_page_of_a_document(spark):
    rng = np.random.RandomState(4)
    lang = lambda i: list(LETTERS)[i % 2]
    rows = [(i, " ".join("".join(rng.choice(list(LETTERS[lang(i)]), 5)) for _ in range(40)), lang(i), f"s{i % 2}")
            for i in range(200)]
    # the text of the others leaves both languages open; two rows share an id
    rows += [(i, "b g", None, "s9") for i in (1000, 1001, 1001, 1002)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # first pages of all documents: one host and no declared language; the second ones tell the language
    told = lambda name, i: (f"http://{name}.{name}/{i}", f"<html lang={name}>")
    pages = [(f"http://all.org/{i}", "<html>") for i in (*range(200), 1000, 1001)]
    pages += [told(lang(i), i) for i in range(200)]
    pages += [told("xx", 1000), told("yy", 1001), told("xx", 1002), ("http://all.org/1002", "<html>")]
    evidence = page_evidence(spark.createDataFrame([(k, *p) for k, p in enumerate(pages)],
                                                   "page_id long, url string, html string"))
    assert evidence.count() == len(pages)
    got = identify(docs, evidence).collect()
    assert len(got) == len(rows)
    late = sorted((r.doc_id, r.language, round(r.posterior, 6)) for r in got if r.doc_id >= 1000)
    assert [x[:2] for x in late] == [(1000, "xx"), (1001, "yy"), (1001, "yy"), (1002, "xx")]
    assert all(x[2] > 0.9 for x in late) and late[0][2] == late[3][2]  # in any order of pages


def test_language_id_rejects_languages_outside_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang != 'es'").select(
        "doc_id", "text", "lang", "source")
    es = (spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'es' and length(text) > 300")
          .select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source"))
    odd = [(2_000_000, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, None, "s"),
           (2_000_001, "いろはにほへと ちりぬるを わかよたれそ つねならむ。" * 5, None, "s"),
           (2_000_002, "qzx vkj wqq zzxj kvq xjz " * 12, None, "s")]
    mixed = docs.where("length(text) between 500 and 3000")
    parts = [r.text[:1200] for x in ("en", "de") for r in mixed.where(F.col("lang") == x).orderBy("doc_id").limit(5).collect()]
    odd += [(3_000_000 + k, f"{parts[k]}\n{parts[5 + k]}", None, "s") for k in range(5)]
    got = identify(docs.union(es).union(spark.createDataFrame(odd, docs.schema))).select("doc_id", "accepted").collect()
    kept = lambda lo, hi: [r.accepted for r in got if lo <= r.doc_id < hi]
    assert not any(kept(2_000_000, 3_000_000))  # scripts and letters that no label has
    assert np.mean(kept(1_000_000, 2_000_000)) < 0.1  # a language that no label has
    assert np.mean(kept(0, 1_000_000)) > 0.99 and all(kept(3_000_000, 4_000_000))  # known ones stay, mixed ones too


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = page_evidence(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    hidden = docs.withColumn("truth", F.col("lang")).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = identify(hidden, pages).join(hidden.select("doc_id", "truth"), "doc_id").where("doc_id % 2 = 1")
    n, right, kept = got.agg(F.count("*"), F.sum((F.col("language") == F.col("truth")).cast("int")),
                             F.sum(F.col("accepted").cast("int"))).first()
    assert right / n > 0.95 and kept / n > 0.99


# ------------------------------------------------------------ embeddings --

def brute_links(rows, threshold):
    out = {}
    usable = []
    for i, v, label in rows:
        ok = v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
        usable.append((i, np.array(v, dtype=float) / np.sqrt(np.sum(np.square(np.array(v, dtype=float)))) if ok else None, label))
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    n = dict.fromkeys(root, 0)
    for k, (i, v, label) in enumerate(usable):
        for j, u, other in usable[:k]:
            if v is not None and u is not None and label == other and len(u) == len(v) and float(u @ v) >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in root}


@pytest.mark.parametrize("shard_vectors", [8192, 40])
def test_near_duplicates_match_brute_force(spark, shard_vectors):
    rng = np.random.RandomState(5)
    rows = []
    centres = rng.normal(size=(12, 16))
    for i in range(260):
        v = centres[i % 12] + rng.normal(size=16) * (0.03 if i % 3 else 1.0)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(500 + k, rows[4][1], 0) for k in range(30)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] + [1.0] * 15, 1),
             (604, rows[3][1], None), (605, [], 0), (606, [1.0, 2.0], 0), (607, [2.0, 4.0], 0), (608, [float("inf"), 1.0], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table, shard_vectors=shard_vectors).collect()}
    assert got == brute_links(rows, 0.98)
    assert near_duplicates(table.limit(0)).count() == 0
    twice = near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)],
                                                  "vec_id long, embedding array<float>, label int"))
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in twice.collect()) == [
        ("1", 2, 1), ("1", 2, 1), ("None", 2, 1)]


@pytest.mark.parametrize("odd", [None, 5, 2**63 - 1])
def test_near_duplicates_join_nothing_through_an_id(spark, odd):
    rows = [(1, [1.0, 0.0, 0.0], 1), (odd, [1.0, 0.05, 0.0], 1), (odd, [0.05, 1.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 1)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got)) == sorted([
        ("1", 1, 1, True), (str(odd), 1, 1, False), (str(odd), 1, 2, False), ("2", 1, 2, True)])
    alone = spark.createDataFrame([(odd, [1.0], 1), (odd, [2.0], 2), (odd, None, 1)],
                                  "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(alone).collect()] == [
        (odd, 0, odd, True)] * 3


def test_graph_recall_of_nearest_neighbours():
    rng = np.random.RandomState(2)
    v = rng.normal(size=(1500, 24))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    g = Graph(v, layer_of(np.arange(1500))).build()
    q = v[:200]
    ids, sims = g.beam(q, 64, 0, g.descend(q, 0))
    want = np.argsort(-(q @ v.T), axis=1)[:, :10]
    hit = np.mean([len(set(w) & set(i)) / 10 for w, i in zip(want.tolist(), ids.tolist())])
    assert hit >= 0.9


# -------------------------------------------------------------- pipeline --

def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp
    rng = np.random.RandomState(9)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmno"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    clean = [text(rng.randint(40, 200)) for _ in range(30)]
    passage, leak = text(70), text(30)
    near = clean[2].split()
    near[5] = "changed"
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100, clean[1]), (101, " ".join(near)), (102, f"{text(60)} {passage} {text(60)}"),
             (103, f"{text(60)}\n{passage}\n{text(60)}"), (104, f"{text(50)} {leak} {text(50)}"), (105, None), (106, "12 34 !!")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    now, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == list(cp.COLUMNS)
            out.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
            after[name] = {r.doc_id: r.text for r in now.collect()}
        else:
            rows = out.collect()
    base = set(range(30))
    assert set(after["language_id"]) == base | {100, 101, 102, 103, 104}
    assert set(after["jaccard_join"]) == base | {102, 103, 104}
    cut = after["substring_dedup"]
    assert set(cut) == base | {102, 103, 104} and passage in cut[102] and passage not in cut[103]
    assert all(cut[i] == clean[i] for i in base)
    assert set(after["decontamination"]) == base | {102, 103}
    check_bins(rows, [len(t.split()) + 1 for t in after["decontamination"].values()], (512, 1024, 2048, 4096))
    again = cp.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_pipeline_judges_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline as cp
    rng = np.random.RandomState(10)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmno"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    clean = [text(rng.randint(60, 200)) for _ in range(30)]
    passage, leak, alone = text(70), text(30), text(80)
    near = clean[2].split()
    near[5] = "changed"
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(None, alone), (None, alone), (None, " ".join(near)), (None, clean[1]), (None, None), (None, "12 34 !!"),
             (None, f"{text(40)} {leak} {text(40)}"), (40, f"{text(60)} {passage} {text(60)}"), (None, f"{text(60)} {passage}")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:4]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    rows = now.collect()
    assert {r.doc_id for r in rows} == set(range(30)) | {40, None}
    tail = docs[-1][1].split()[:60]
    assert sorted(r.text for r in rows if r.doc_id is None) == sorted([alone, " ".join(tail)])
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_cuts_each_text_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline as cp
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, f"head one {passage} tail one"), (2, f"x {passage} y"), (2, "another text"), (2, "another text"), (2, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in cp.repeated_passages(spark, table, str(tmp_path)).collect())
    assert got == [(1, docs[0][1], len(docs[0][1])), (2, "", 0), (2, "another text", 12), (2, "another text", 12), (2, "x y", 3)]
