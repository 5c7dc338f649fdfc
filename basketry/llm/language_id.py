"""Language identification by Bayesian evidence fusion.

The posterior of a document's language combines four sources:

* text: hashed byte trigrams of its letters under naive Bayes, whole texts, tempered (neighbouring trigrams
  overlap, so they are not independent);
* declared language of its markup, and the suffix of its address: how likely each value is under a language;
* a prior of its host, smoothed hierarchically: all documents -> registered domain -> host.

The three latter are learned by grouped aggregation over all documents, from
the languages that the texts alone suggest. Every page of a document votes for
its own host, suffix and declared language, and a document's own votes are taken
out of its hosts' counts. The log evidence of a document's pages is averaged
(they are not independent) before it meets the text. Only the trigram table is fitted on a sample of labelled
rows, of ``train_rows`` documents on average, chosen by a hash of the id.

A document is rejected when it has no trigram of letters, its best language
has a posterior below ``min_posterior``, or its text is more likely under an
"other" class, which gives every trigram the same log-probability. That bound is
set on the sample, each half held out from the other's table: as far below the
median of the documents' mean log-probability as the lowest ``LOW`` of them
reach, twice. A trigram counts with its best language, so that a text in
several known languages stays; the text is tempered and the class has the prior
``OTHER``, so short texts need stronger evidence to go.

Null or empty text has no trigrams. Null evidence counts as absent. Rows
without a label are not learned from. Repeated rows are judged each (and vote
each). An empty table, or one without labels, gives rows with a null language,
rejected. Only the columns named in the call are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import stored
from .text import LOWER, as_bytes, chunked
from .url_filter import domain_of, suffix_of

TABLE_BITS = 16
TRAIN_ROWS = 4000
TEMPER = 4.0
#: pseudo-counts of the host and domain priors
HOST_STRENGTH, DOMAIN_STRENGTH = 20.0, 50.0
#: prior of the class of unknown languages, share of held-out documents that its bound is taken from
OTHER, LOW = 0.01, 0.005

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[0x80:] = True


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams around every letter, number of them per text)."""
    low = LOWER[np.frombuffer(b"  ".join(texts) + b"  ", dtype=np.uint8)]
    letter = _LETTER[low]
    low = np.where(letter, low, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    left = np.where(at > 0, low[at - 1], 32).astype(np.uint32)
    key = (left << np.uint32(16)) | (low[at] << np.uint32(8)) | low[at + 1]
    key = (key * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    ends = np.cumsum([len(t) + 2 for t in texts])
    n = np.diff(np.append(0, np.searchsorted(at, ends)))
    return key.astype(np.int64), n


def _log_table(counts: np.ndarray) -> np.ndarray:
    """2**TABLE_BITS rows of log-probabilities, smoothed, from a row of counts per language."""
    c = counts + 0.2
    return np.log(c / c.sum(axis=1, keepdims=True)).T.astype(np.float32)


def fit_trigrams(docs: DataFrame, text_col: str, label_col: str, id_col: str,
                 train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, float]:
    """(languages, log-probability table of 2**TABLE_BITS rows, bound) from a bounded sample of labelled rows.

    The bound is the log-probability of a trigram in the class of unknown languages.
    """
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled.count()
    scale = 1 << 20
    limit = scale if rows <= train_rows else max(1, train_rows * scale // rows)
    text = F.col(text_col).cast("string")
    # copies of a text fall in one half
    sample = labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(scale)) < limit).select(
        text.alias("text"), F.col(label_col).cast("string").alias("label"),
        F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"))

    def count(batches):
        import pyarrow as pa
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            labels = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            texts = as_bytes(batch.column(0))
            for lo, hi in chunked(map(len, texts)):
                key, n = trigrams(texts[lo:hi])
                name = np.repeat(np.arange(hi - lo), n)
                for group in set(labels[lo:hi]):
                    own = np.array([x == group for x in labels[lo:hi]])
                    c = np.bincount(key[own[name]], minlength=1 << TABLE_BITS)
                    total[group] = total.get(group, 0) + c
        some = {g: np.flatnonzero(c) for g, c in total.items()}
        yield pa.RecordBatch.from_arrays([
            pa.array([g[0] for g in total], pa.string()), pa.array([g[1] for g in total], pa.int32()),
            pa.array([x.astype("<u4").tobytes() for x in some.values()], pa.binary()),
            pa.array([c[some[g]].astype("<i8").tobytes() for g, c in total.items()], pa.binary())],
            names=["lang", "half", "keys", "data"])

    found: dict[str, np.ndarray] = {}
    for r in sample.repartition(8).mapInArrow(
            count, "lang string, half int, keys binary, data binary").collect():  # eight tasks' tables
        table = found.setdefault(r["lang"], np.zeros((2, 1 << TABLE_BITS)))
        table[r["half"], np.frombuffer(r["keys"], dtype="<u4")] += np.frombuffer(r["data"], dtype="<i8")
    langs = sorted(found)
    if not langs:
        return [], np.zeros((1 << TABLE_BITS, 0), dtype=np.float32), 0.0
    counts = np.array([found[x] for x in langs])
    return langs, _log_table(counts.sum(axis=1)), _bound(sample, langs, counts)


def _bound(sample: DataFrame, langs: list[str], counts: np.ndarray) -> float:
    """Log-probability of a trigram in the class of unknown languages, from halves of the sample held out."""
    tables = sample.sparkSession.sparkContext.broadcast([_log_table(counts[:, 1 - h]) for h in (0, 1)])
    learned = [[bool(counts[i, 1 - h].any()) for i in range(len(langs))] for h in (0, 1)]
    number = {x: i for i, x in enumerate(langs)}

    def held_out(batches):
        import pyarrow as pa
        for batch in batches:
            labels, half = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts, mean = as_bytes(batch.column(0)), []
            for lo, hi in chunked(map(len, texts)):
                key, n = trigrams(texts[lo:hi])
                end = np.cumsum(n)
                by_half = [np.append(0.0, np.cumsum(t[key].max(axis=1), dtype=np.float64)) for t in tables.value]
                for i in range(hi - lo):
                    h = half[lo + i]
                    if n[i] and learned[h][number[labels[lo + i]]]:  # its language is in the other half's table
                        mean.append((by_half[h][end[i]] - by_half[h][end[i] - n[i]]) / n[i])
            yield pa.RecordBatch.from_arrays([pa.array(mean, pa.float64())], names=["mean"])

    low, middle = sample.mapInArrow(held_out, "mean double").agg(
        F.percentile_approx("mean", F.lit(LOW), F.lit(10000)),
        F.percentile_approx("mean", F.lit(0.5), F.lit(10000))).first()
    uniform = -TABLE_BITS * float(np.log(2.0))
    return uniform if low is None else max(2 * low - middle, min(low, uniform))


def identify(docs: DataFrame, evidence: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "lang", host_col: str | None = "source", train_rows: int = TRAIN_ROWS,
             min_posterior: float = 0.5) -> DataFrame:
    """(doc_id, language, posterior, text_language, n_trigrams, accepted) of every row.

    ``evidence`` (doc_id, host, declared; any number of rows per doc_id) is what
    the web pages of a document say. ``host_col`` of the documents stands in
    where no page, or no host of a page, is known.
    """
    spark = docs.sparkSession
    langs, table, bound = fit_trigrams(docs, text_col, label_col, id_col, train_rows)
    n_langs = len(langs)
    table_b = spark.sparkContext.broadcast(table)  # 2**TABLE_BITS floats a language

    def likelihood(batches):
        import pyarrow as pa
        t = table_b.value
        for batch in batches:
            texts = as_bytes(batch.column(2))
            sums, counts, known = [], [], []
            for lo, hi in chunked(map(len, texts)):
                key, n = trigrams(texts[lo:hi])
                total = np.zeros((len(key) + 1, n_langs))
                np.cumsum(t[key], axis=0, dtype=np.float64, out=total[1:])
                end = np.cumsum(n)
                sums.append(total[end] - total[end - n])
                counts.append(n)
                each = np.append(0.0, np.cumsum(t[key].max(axis=1), dtype=np.float64)) if n_langs else np.zeros(len(key) + 1)
                known.append((each[end] - each[end - n]) - bound * n)
            sums = np.concatenate(sums) if sums else np.zeros((0, n_langs))
            counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            known = np.concatenate(known) if known else np.zeros(0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * n_langs, pa.int32()),
                                         pa.array(sums.reshape(-1), pa.float64())),
                pa.array(counts, pa.int64()), pa.array(known, pa.float64())],
                names=["doc_id", "host", "ll", "n", "known"])

    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"),
                       F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(likelihood, "doc_id long, host string, ll array<double>, n long, known double")
    best = F.array_position("ll", F.array_max("ll")).cast("int") if n_langs else F.lit(0)
    # numbered as written: rows that share a doc_id stay apart
    scored = stored(scored.withColumn("vote", F.when(F.col("n") > 0, best)).withColumn(
        "row", F.monotonically_increasing_id()), "language-likelihood")
    if not n_langs:
        none = F.lit(None).cast("string")
        return scored.select("doc_id", none.alias("language"), F.lit(None).cast("double").alias("posterior"),
                             none.alias("text_language"), F.col("n").alias("n_trigrams"), F.lit(False).alias("accepted"))

    # pages of a row by host, and by declared language; ``m`` pages each
    judged = scored.select("row", "doc_id", "host", "vote")
    if evidence is None:
        told = None
        placed = judged.withColumn("page", F.lit(None).cast("string")).withColumn("m", F.lit(1).cast("long"))
    else:
        told = evidence.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").alias("page"), "declared")
        placed = judged.join(told.groupBy("doc_id", "page").agg(F.count("*").alias("m")), "doc_id", "left").withColumn(
            "m", F.coalesce("m", F.lit(1)))
    placed = stored(
        placed.withColumn("host", F.coalesce("page", "host"))
        .withColumn("domain", F.when(F.col("page").isNotNull(), domain_of(F.col("page"))).otherwise(F.col("host")))
        .withColumn("suffix", F.when(F.col("page").isNotNull(), suffix_of(F.col("page"))))
        .groupBy("row", "host", "domain", "suffix", "vote").agg(F.sum("m").alias("m")), "language-hosts")

    def votes(rows, *keys):
        return rows.where("vote is not null").groupBy(*keys).agg(
            F.array(*(F.sum(F.when(F.col("vote") == i + 1, F.col("m")).otherwise(0).cast("double"))
                      for i in range(n_langs))).alias("c"))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    everything = votes(scored.withColumn("m", F.lit(1))).first()
    all_votes = np.array(everything["c"] if everything and everything["c"][0] is not None else [0.0] * n_langs)
    base = ((all_votes + 1.0) / (all_votes + 1.0).sum()).tolist()
    base_lit = F.array(*(F.lit(float(x)) for x in base))

    def smoothed(c, parent, strength):
        return F.zip_with(c, parent, lambda x, p: x + strength * p)

    domain = votes(placed, "domain").select("domain", smoothed(F.col("c"), base_lit, DOMAIN_STRENGTH).alias("d"))
    domain = domain.select("domain", F.transform("d", lambda x: x / total(F.col("d"))).alias("domain_prior"))
    hosts = votes(placed, "host", "domain").withColumnRenamed("c", "host_votes").where("host is not null")

    def likelihoods(rows, col):
        """log P(value | language) of an evidence column, add-one smoothed over its values."""
        c = votes(rows, col).where(F.col(col).isNotNull())
        sums = c.agg(F.count("*").alias("k"), *(F.sum(F.get("c", F.lit(i))).alias(f"s{i}") for i in range(n_langs))).first()
        k = float(sums["k"] or 0)
        logs = [F.log((F.get("c", F.lit(i)) + 1.0) / F.lit(float(sums[f"s{i}"] or 0.0) + k + 1.0)) for i in range(n_langs)]
        return c.select(col, F.array(*logs).alias(f"{col}_log"))

    zero = F.array(*(F.lit(0.0) for _ in langs))
    own = F.transform(F.sequence(F.lit(1), F.lit(n_langs)),
                      lambda i: F.when(i == F.col("vote"), F.col("m").cast("double")).otherwise(0.0))

    def averaged(rows, *logs):
        """Mean of the rows' log evidence over the pages that have it, by row."""
        def mean(col, i):
            return F.sum(F.col("m") * F.get(col, F.lit(i))) / F.sum(F.when(F.col(col).isNotNull(), F.col("m")))
        arrays = [F.array(*(mean(c, i) for i in range(n_langs))).alias(c) for c in logs]
        known = [F.count(c).alias(f"{c}_known") for c in logs]
        return rows.groupBy("row").agg(*arrays, *known).select(
            "row", *(F.when(F.col(f"{c}_known") > 0, F.col(c)).alias(c) for c in logs))

    at = (placed.join(hosts.join(domain, "domain", "left"), ["host", "domain"], "left")
          .join(likelihoods(placed, "suffix"), "suffix", "left"))
    others = F.zip_with(F.coalesce("host_votes", zero), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    at = at.withColumn("w", smoothed(others, F.coalesce("domain_prior", base_lit), HOST_STRENGTH))
    at = at.withColumn("prior", F.transform("w", lambda x: F.log(x / total(F.col("w")))))
    fused = scored.join(averaged(at, "prior", "suffix_log"), "row")
    score = F.zip_with("ll", "prior", lambda a, b: a / TEMPER + b)
    logs = ["suffix_log"]
    if told is not None:
        said = judged.join(told.where("declared is not null").groupBy("doc_id", "declared").agg(
            F.count("*").alias("m")), "doc_id")
        said = said.join(likelihoods(said, "declared"), "declared", "left")
        fused = fused.join(averaged(said, "declared_log"), "row", "left")
        logs.append("declared_log")
    for col in logs:
        score = F.zip_with(score, F.coalesce(col, zero), lambda a, b: a + b)
    fused = fused.withColumn("score", score).withColumn("top", F.array_max("score"))
    posterior = 1.0 / total(F.transform("score", lambda x: F.exp(x - F.col("top"))))
    names = F.array(*(F.lit(x) for x in langs))
    return fused.select(
        "doc_id", F.get(names, F.array_position("score", F.col("top")).cast("int") - 1).alias("language"),
        posterior.alias("posterior"), F.get(names, F.col("vote") - 1).alias("text_language"),
        F.col("n").alias("n_trigrams"),
        ((F.col("n") > 0) & (posterior >= min_posterior)
         & (F.col("known") / TEMPER >= float(np.log(OTHER / (1 - OTHER))))).alias("accepted"))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(doc_id, host, declared) of every page: what it says of the document whose number ends its path.

    ``declared`` is the primary subtag of the html tag's lang attribute. A
    document with several pages has several rows.
    """
    from .url_filter import host_of, path_of
    number = F.regexp_extract(path_of(F.col(url_col)), r"(\d{1,18})[^0-9/]*/?$", 1)
    declared = F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return (pages.select(F.when(number != "", number.cast("long")).alias("doc_id"),
                         F.nullif(host_of(F.col(url_col)), F.lit("")).alias("host"),
                         F.nullif(declared, F.lit("")).alias("declared"))
            .where("doc_id is not null"))
