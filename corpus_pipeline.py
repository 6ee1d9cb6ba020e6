"""The corpus pipeline: language ID, exact dedup, near-duplicate join, packing.

Each stage works on all rows that the one before it kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkmere.llm.common import cut
from chunkmere.llm.exact_dedup import drop_copies
from chunkmere.llm.language_id import drop_rejected, fit
from chunkmere.llm.ngram_join import drop_near_duplicates
from chunkmere.llm.packing import pack_documents

TOKENIZER, END_ID = "byte_bpe_50k.json", 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told by a margin go, null, empty and letterless texts with them; the model learns from their labels."""
    return drop_rejected(docs, fit(docs.select("text", "lang")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, by sequence."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", near_dedup), ("packing", packing)]

#: Compression and the tokenizers library can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows materialised for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
