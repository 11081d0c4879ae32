"""The corpus pipeline: quality, language, near-duplicates, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reachflow.llm import common, kneser_ney, language, minhash, packing

#: The stages can't be said in SQL (a fitted language model, a kernel classifier, best-fit packing); see tests/llm/.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with text up to their language's perplexity threshold, under the model of trusted texts."""
    return kneser_ney.kept(docs, common.labels(spark, sf_dir))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of the learned languages: those without a letter and without a likely language go. All labelled rows teach."""
    return language.kept(docs, language.trained(docs, every=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group linked at a similarity of 0.8; rows without an id stay."""
    return minhash.kept(docs, similarity=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all pieces of the remaining documents into sequences of 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", languages), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir).select(*docs.columns))
    return STAGES[-1][1](spark, docs, sf_dir)
