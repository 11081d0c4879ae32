"""What the operators of this subpackage share: the scratch folder, batches of whole texts, vectorised word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.sources.scratch import narrow, scratch, tasks_for, text_bytes, written  # noqa: F401


#: Texts are taken from an Arrow batch in slices of about so many bytes (one text at least).
SLICE_BYTES = 1_000_000
#: An Arrow batch ends with the row that takes it beyond so many bytes.
BATCH_BYTES = 4_000_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that very long texts don't meet in one batch; a session's smaller limits stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, 513):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with their texts as UTF-8 (null: empty), each of about `most` bytes or of one row."""
    for batch in batches:
        texts = [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]
        begin = total = 0
        for i, text in enumerate(texts):
            if i > begin and total + len(text) > most:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, total = i, 0
            total += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


def run_positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs, run after run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


#: The first k bytes of eight, for k up to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Runs of more bytes are hashed one by one.
LONG_RUN = 256


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of data; no run may be empty.

    Eight bytes after eight go through the finaliser with all before them, so that no sum of powers or other linear
    relation makes two runs alike.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    out = mixed(sizes.astype(np.uint64) * MIX2)
    which, at, left = np.arange(len(starts)), starts, sizes
    long = np.flatnonzero(sizes > LONG_RUN)
    if len(long):
        short = np.flatnonzero(sizes <= LONG_RUN)
        which, at, left = which[short], at[short], left[short]
        for i in long.tolist():
            run = data[starts[i] : starts[i] + sizes[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")
    while len(which):
        block = eight[at].view("<u8")[:, 0] & _FIRST[np.minimum(left, 8)]
        out[which] = mixed(out[which] * MIX1 ^ block)
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return out


def same_runs(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which runs of a and b, of equal sizes above 0, hold the same bytes."""
    if not len(sizes):
        return np.zeros(0, bool)
    differ = a[run_positions(a_starts, sizes)] != b[run_positions(b_starts, sizes)]
    return ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and 64-bit hashes of the runs of word bytes in data."""
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(data) and is_word[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(data)]))
    return edge[::2], run_hashes(data, edge[::2], edge[1::2] - edge[::2])


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a gap after each, and where each begins (and the end)."""
    begins = np.concatenate(([0], np.cumsum([len(t) + len(gap) for t in texts]))).astype(np.int64)
    return np.frombuffer(gap.join(texts) + gap if texts else b"", np.uint8), begins


def free(columns: list[str], name: str) -> str:
    """The name, with as many underscores as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column, by: int):
    """crc32 of the id as decimal text, modulo `by`; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
