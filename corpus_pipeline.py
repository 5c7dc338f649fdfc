"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: documents without a recognisable language go;
2. n-gram Jaccard join (5-word shingles, 80 %): the smallest doc_id of each component stays;
3. substring dedup: runs of 50 words or more that also start earlier are cut out; emptied documents go;
4. benchmark decontamination: documents that hold a 10-word window of a benchmark item go;
5. best-fit packing of what is left.

Rows with a null doc_id go through every stage by a key made from their text,
which orders after the ids (up to 2^62); of such rows with one text the Jaccard join keeps one.
Rows that repeat a doc_id are kept or dropped together by the other filters;
the substring dedup cuts each of their texts by itself. Null texts are
rejected by the first stage. Empty tables pass through. Columns of ``docs``
other than those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.exchange import stored
from basketry.llm.jaccard_join import jaccard_components
from basketry.llm.language_id import identify, page_evidence
from basketry.llm.packing import pack_documents
from basketry.llm.positional_index import contamination
from basketry.llm.substring import substring_dedup

#: SQL can't express the fitted language model or the packing; tests compare with brute-force versions
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: shingle words and similarity of near copies, words of a repeated passage and of a benchmark window
SHINGLE, PERCENT, PASSAGE, WINDOW = 5, 80, 50, 10


#: keys of rows without an id: 62 bits of a hash of the text above this
NO_ID = 1 << 62


def _key():
    """What tells a row: its id, or its text where it has none."""
    made = F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    return F.when(F.col("doc_id").isNull(), made).otherwise(F.col("doc_id"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as the operators take them: no id is null."""
    return docs.withColumn("doc_id", _key())


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys`` (column doc_id)."""
    told = keys.select(F.col("doc_id").alias("key")).distinct()
    return docs.withColumn("key", _key()).join(told, "key", "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go."""
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return _kept(docs, identify(_keyed(docs), pages).where("accepted"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, the one with the smallest id."""
    groups = jaccard_components(_keyed(docs), shingle=SHINGLE, percent=PERCENT)
    kept = _kept(docs, groups.where("doc_id = component_id"))
    if docs.where("doc_id is null").isEmpty():
        return kept
    nameless = kept.where("doc_id is null").dropDuplicates(["text"])
    return kept.where("doc_id is not null").unionByName(nameless)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that also start earlier are cut out; emptied documents go."""
    cut = (substring_dedup(_keyed(docs), min_words=PASSAGE, keep_spacing=True)
           .where("n_removed < n_words or n_words = 0")
           .groupBy(F.col("doc_id").alias("key"), "text_md5")
           .agg(F.first("text").alias("kept"), F.max("n_removed").alias("n_removed")))
    changed = F.col("n_removed") > 0
    told = docs.withColumn("key", _key()).withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    return (told.join(cut, ["key", "text_md5"])
            .select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                    F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go."""
    found = contamination(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW, slop=0)
    clean = (found.groupBy("doc_id").agg(F.max(F.size("spans")).alias("n")).where("n = 0"))
    return _kept(docs, clean)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents that are left, with their bins."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents at ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
