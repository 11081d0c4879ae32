"""Token ids as Simple-8b segments in ascending doc_id order, written to a table and read back.

A segment is one binary value: a header of six little-endian 64-bit integers (magic, format version, documents, ids,
blocks, words), the id of each document (and, as bytes, whether it is null), its number of ids, the first word of each
block, then the words. Segments carry their part, a range of ids, and their number in it, so that reading needs no order of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachflow.llm import common, simple8b
from reachflow.llm.wordbpe import encoder

MAGIC, VERSION = 0x53385345474D, 1
SEGMENT = "part int, segment int, before long, n_ids long, blob binary"
END_ID = 1


def to_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The binary form of documents and their little-endian unsigned 32-bit ids."""
    words, index = simple8b.encode(np.frombuffer(b"".join(ids), "<u4").astype(np.uint64))
    head = np.array([MAGIC, VERSION, len(ids), sum(map(len, ids)) // 4, len(index) - 1, len(words)], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array([len(x) // 4 for x in ids], "<i8").tobytes(), index.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def from_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a segment."""
    magic, version, docs, n, blocks, n_words = np.frombuffer(blob, "<i8", 6).tolist()
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a segment of token ids")
    at = 48
    doc_ids = np.frombuffer(blob, "<i8", docs, at).tolist()
    null = np.frombuffer(blob, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(blob, "<i8", docs, at := at + docs)
    index = np.frombuffer(blob, "<i8", blocks + 1, at := at + 8 * docs)
    words = np.frombuffer(blob, "<u8", n_words, at + 8 * (blocks + 1))
    ids = simple8b.decode(words, index, n).astype("<u4")
    return [None if gone else d for d, gone in zip(doc_ids, null, strict=True)], lengths, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes every text (null: empty) and an end id, and writes segments in ascending doc_id order to `path`.

    Null ids come first; rows of one id keep together, in order of their texts' hashes. Other columns are left out. The
    table is committed by Spark, so that a lost executor leaves no half-written segment.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, segment, before = encoder(tokenizer), None, 0, 0
        for rows, texts in common.slices(batches, "text"):
            parts = rows.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # a task may write several parts, one after another
                if parts[i] != part:
                    part, segment, before = parts[i], 0, 0
                ids = [x + end for x in own.encode([t.decode() for t in texts[i:j]])]
                n = sum(map(len, ids)) // 4
                blob = to_segment(rows.column("doc_id")[i:j].to_pylist(), ids)
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before]), pa.array([n]), pa.array([blob], pa.binary())], ["part", "segment", "before", "n_ids", "blob"])
                segment, before = segment + 1, before + n

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tasks = common.tasks_for(common.text_bytes(rows))
    # The second key splits a range of rows of one id, null too; rows that repeat as a whole stay together.
    ranged = rows.repartitionByRange(tasks, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    # Parts are ranges in order; which task writes a part doesn't matter, so that a file may hold several.
    dealt = ranged.withColumn("part", F.spark_partition_id()).coalesce(tasks)
    dealt.mapInArrow(run, SEGMENT).write.option("parquet.enable.dictionary", "false").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of a table that write_tokens() wrote."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # A part has some TASK_BYTES of text, so that the few numbers of all parts are small: 4 million parts make 64 MB.
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, before, blob in zip(*(batch.column(c).to_pylist() for c in ("first", "before", "blob")), strict=True):
                doc_ids, lengths, ids = from_segment(blob)
                ends = np.cumsum(lengths)
                data, start = ids.tobytes(), first + before + ends - lengths
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    rows = segments.join(F.broadcast(starts), "part").select("first", "before", "blob")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
