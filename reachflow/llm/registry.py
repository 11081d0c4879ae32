"""The registered queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.llm import audit, bpe, common, flac, hard_negatives, kneser_ney, language, licences, minhash, neighbours, packing, sharding, token_files, toxicity

WORD_FILE, RANK_FILE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload as a FLAC stream, decoded with its checksums verified to stored PCM blocks, which are read back."""
    path = common.scratch(spark)
    flac.write_pcm(flac.media(common.documents(spark, sf_dir)), path)
    return flac.features(flac.read_pcm(spark, path))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted texts, and whether its language's threshold keeps it."""
    return kneser_ney.judged(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.packed_documents(common.documents(spark, sf_dir), public_tokenizers.path(WORD_FILE))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the rank file, and the digests of the ids and of their decoding."""
    path = public_tokenizers.path(RANK_FILE)
    tokens = bpe.encoded(common.documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return bpe.digests(tokens, path, public_tokenizers.PATTERN)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and near-duplicate class."""
    return minhash.near_duplicates(common.documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity under the model fitted on the labelled rows outside the held-out fold."""
    docs = common.documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.trained(docs, common.labels(spark, sf_dir)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Simple-8b segments in doc_id order and read back."""
    path = common.scratch(spark)
    token_files.write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path(WORD_FILE))
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language under the model fitted on rows outside the held-out fold."""
    docs = common.documents(spark, sf_dir)
    return language.identified(docs, language.trained(docs))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, from shards written by the external shuffle and read back."""
    path = common.scratch(spark)
    sharding.write_shards(common.documents(spark, sf_dir), path)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return sharding.read_shards(spark, path).select("doc_id", "size", crc, "law", "shard", "slot", "grown_shard")


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence places, labels and score."""
    return licences.licences(common.documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the filters A to E removes from the documents of each language, in all 120 orders."""
    return audit.audit(audit.masks(common.documents(spark, sf_dir), common.labels(spark, sf_dir)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every vector whose id is divisible by 100, for each of its positives."""
    return hard_negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), relabel=hard_negatives.seventh())


QUERIES = (
    op1_flac, op2_kneser_ney, op3_packing, op4_byte_bpe, op5_minhash, op6_toxicity, op7_token_files, op8_language, op9_neighbours, op10_sharding,
    op11_licences, op12_filter_audit, op13_hard_negatives,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL; tests/llm/ holds them against brute-force versions."""
    return {"op5_minhash": minhash.oracle(), "op11_licences": licences.oracle(), "op12_filter_audit": audit.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
