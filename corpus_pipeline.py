"""The training-data pipeline: documents through language ID, line dedup, near-dedup, mixing and tokenization.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lograil.llm import bpe, langid, linededup, mixing, simhash
from lograil.llm._common import materialize
from lograil.llm.queries import table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a learned language, or of which none makes up half, go: null and empty texts, and those without a
    letter, too. Repeated rows stay or go together; an empty table gives none."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, and documents of which nothing is left. Null texts stay as they
    are, rows that agree in id and text are one document, an empty table gives none."""
    return linededup.keep_deduped(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard similarity of at least 0.8. Texts without
    words are copies of each other, of repeated rows one stays, null ids come last, an empty table gives none."""
    return simhash.keep_one_alike(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Rows that differ in any column are documents of their own, null texts have
    size 0 and null sources are one source; an empty table gives none."""
    return mixing.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, with the hashes of ids and decoded text; null texts are empty, each row gives one row."""
    return bpe.encode(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("tokenize", tokenize),
]

#: Language ID, SimHash and BPE are beyond SQL; every stage and run() are tested against brute force in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
