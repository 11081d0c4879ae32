"""Seeded shuffling of documents into shards, by a two-pass external shuffle.

Pass one scatters every record by seeded hashes: to a shard by its id (a jump consistent hash, so that one more shard
takes rows only into itself) and, within the shard, uniformly to one of several buckets of bounded memory. Pass two
permutes each bucket by Fisher-Yates and writes it; the buckets of a shard follow each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.llm import common

SHARDS, SEED, BUCKET_BYTES = 16, 20_240_611, 8_000_000
#: So many buckets have their places broadcast (16 MB).
MOST_BROADCAST = 1_000_000
SHUFFLED = "doc_id long, text string, bucket int, shard int, grown_shard int, slot_in_bucket long"


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: a key's shard under n + 1 shards is its shard under n or the new one."""
    key = keys.astype(np.uint64, copy=True)
    shard, following = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = following[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        following[live] = ((shard[live] + 1) * jump).astype(np.int64)
        live = live[following[live] < shards]
    return shard


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: each place swaps with a uniform one among those not yet settled."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else []
    for i, d in enumerate(np.asarray(draws).tolist()):
        order[i], order[i + d] = order[i + d], order[i]
    return np.array(order, np.int64)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, size, law, shard, bucket, slot_in_bucket, grown_shard: every record, in the order in which to write it.

    The shard follows from doc_id and the number of shards alone (law `key`); rows of equal or null ids share a shard
    and are told apart by their texts within it. Buckets are dealt by a hash of id and text, as many as the total size
    asks for, with a quarter of the room kept for chance, and by the scanned partition, so that rows that repeat as a whole
    don't meet in one. Null texts stay null and have size 1. The order follows from the seed and the layout of the input;
    other columns are left out.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = common.text_bytes(rows)
    buckets = max(1, -(-total * 5 // (4 * bucket_bytes * shards)))
    key = F.xxhash64(F.lit(seed), "doc_id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "text", "bucket")), pa.array(jump_hash(keys, shards), pa.int32()), pa.array(jump_hash(keys, shards + 1), pa.int32())], ["doc_id", "text", "bucket", "shard", "grown_shard"])

    dealt = rows.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int"))
    dealt = dealt.mapInArrow(place, "doc_id long, text string, bucket int, shard int, grown_shard int")

    def permute(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        order = fisher_yates(table.num_rows, zlib.crc32(f"{seed},{shard},{bucket}".encode()))
        return table.take(pa.array(order)).append_column("slot_in_bucket", pa.array(np.arange(table.num_rows), pa.int64()))

    tasks = common.tasks_for(total)  # of whole buckets; coalesce holds the number where a setting raises it
    return dealt.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").applyInArrow(permute, SHUFFLED).coalesce(tasks)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes the shuffled records to `path`; each bucket lies in one file, in its order."""
    shuffled(docs, shards, seed, bucket_bytes).write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, text, size, law, shard, slot (gapless within a shard), grown_shard of a table that write_shards() wrote."""
    rows = spark.read.schema(SHUFFLED).parquet(path)
    sizes = common.narrow(rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = sizes.select("shard", "bucket", before.alias("before"))
    # A row of 16 bytes for each bucket; with very many of them the texts are shuffled to it instead.
    starts = F.broadcast(starts) if sizes.count() <= MOST_BROADCAST else starts
    return rows.join(starts, ["shard", "bucket"]).select("doc_id", "text", text_size(F.col("text")).alias("size"), F.lit("key").alias("law"), "shard", (F.col("before") + F.col("slot_in_bucket")).alias("slot"), "grown_shard")
