"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align
from .hnsw import near_duplicates
from .jaccard_join import jaccard_components
from .language_id import identify, page_evidence
from .lm import lm_scores
from .main_text import main_text
from .packing import pack_documents
from .positional_index import contamination
from .repair import damaged, repair
from .substring import substring_dedup
from .suffix_array import suffix_dedup
from .url_filter import Rule, filter_urls, path_of
from .wavelet import read_documents, write_shards

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 512 to 4096 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"))


URL_RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of pages whose document, the number that ends the path, is labelled.

    Bad: toxic or of low quality.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})[^0-9/]*/?$", 1)
    docs = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    told = labels.where("quality is not null or toxic is not null").select(
        "doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return docs.join(told, "doc_id").select("page_id", "bad")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; host reputation from the labelled documents."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")), URL_RULES).withColumn(
        "bad_bound", F.round("bad_bound", 6))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 90 % similar or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, slop=0)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to wavelet shards and read back from them."""
    import public_tokenizers
    return read_documents(write_shards(_table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, its pages' markup and address, and its host."""
    pages = page_evidence(_table(spark, sf_dir, "pages"))
    return identify(_table(spark, sf_dir, "documents"), pages)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word runs removed; the kept words are told by their hash."""
    return substring_dedup(_table(spark, sf_dir, "documents"), min_words=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a bigram model with deleted interpolation."""
    return lm_scores(_table(spark, sf_dir, "documents"), order=2, folds=7, test_fold=2, em_fold=3)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at cosine 0.98 within their label, with their components."""
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings removed; the remaining bytes are told by their hash."""
    return suffix_dedup(_table(spark, sf_dir, "documents"), min_bytes=100).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every text's byte-level and piece tokens, with corpus-wide link counts."""
    import public_tokenizers as tokenizers
    return align(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"),
                 tokenizers.path("piece_bpe_32k.model"), tokenizers.path("byte_bpe_50k.tiktoken"),
                 tokenizers.PATTERN)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the contract's damage."""
    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without furniture and what pages of a host share."""
    return main_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_best_fit_packing,
    op2_url_filter,
    op3_jaccard_join,
    op4_decontamination,
    op5_wavelet_tokens,
    op6_language_id,
    op7_substring_dedup,
    op8_lm_scoring,
    op9_embedding_dedup,
    op10_suffix_dedup,
    op11_token_alignment,
    op12_conversation_repair,
    op13_html_extraction,
)}
