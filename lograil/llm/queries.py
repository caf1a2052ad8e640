"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lograil.llm import bagsearch, bpe, conversations, hnsw, langid, license, linededup, mixing, passages, quality, simhash, toxicity, warc
from lograil.llm.oracles import ORACLES


def tokenizer_path() -> str:
    """The tokenizer file: LOGRAIL_TOKENIZER, or the installed public one."""
    if path := os.environ.get("LOGRAIL_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), version=2)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(license.document_paths(table(spark, sf_dir, "documents")))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, *toxicity.train(documents, table(spark, sf_dir, "labels")))


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.reports(rows, conversations.damage(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_langid": op5_langid,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_license": op8_license,
    "op9_hnsw": op9_hnsw,
    "op10_passages": op10_passages,
    "op11_toxicity": op11_toxicity,
    "op12_bag_search": op12_bag_search,
    "op13_conversations": op13_conversations,
}

__all__ = ["ORACLES", "QUERIES"]
