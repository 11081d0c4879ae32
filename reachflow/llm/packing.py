"""Best-fit-decreasing packing of token sequences.

The order in which best-fit decreasing takes its items depends on their lengths alone, and so does the open bin that
it picks. The lengths are counted (at most `capacity` counters), the placement of all items of a length is planned at
once on the driver with a segment tree over remaining capacities, and every piece then finds its place from its rank
among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachflow.llm import common
from reachflow.llm.wordbpe import encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are ranked within groups of about so many rows.
RANK_ROWS = 20_000


class RemainingTree:
    """Which remaining capacities have open bins: a segment tree that finds the least such capacity >= a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, items a sequence, offset) that place every item.

    The same as best-fit decreasing one item at a time: once a bin is the tightest one, it stays so for this length
    until it holds no further item. A run of bins in the same state is split at most twice a length, so the number of
    runs is below 4 x capacity, and a run is touched at most once for each of the at most sqrt(2 x capacity) lengths
    that fit in one bin together: the plan's size doesn't depend on the number of items.
    """
    tree, runs, rows, fresh = RemainingTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, bins = capacity, fresh, -(-left // (capacity // length))
                fresh += bins
            else:
                first, bins = runs[remaining].pop()
                tree.add(remaining, -bins)
            each = remaining // length
            used = min(bins, -(-left // each))
            items = min(left, used * each)
            rows.append((length, rank, rank + items, first, each, capacity - remaining))
            full, part = divmod(items, each)
            for at, n, rest in ((first, full, remaining - each * length), (first + full, bool(part), remaining - part * length), (first + used, bins - used, remaining)):
                if n and rest:
                    runs.setdefault(rest, []).append((at, int(n)))
                    tree.add(rest, int(n))
            rank, left = rank + items, left - items
    return rows


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the tokenised texts: doc_id, piece, start, length, ids (binary, little-endian unsigned 32 bits).

    Every text, null as empty, is followed by end_id, so that each row gives one piece at least; only those longer
    than the capacity are cut. Null ids stay null; repeated rows give repeated pieces; other columns are left out.
    """
    common.small_batches(docs.sparkSession)
    width = 4 * capacity
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part, texts in common.slices(batches, "text"):
            doc, piece, start, length, ids = [], [], [], [], []
            for d, x in zip(part.column("doc_id").to_pylist(), own.encode([t.decode() for t in texts]), strict=True):
                x += end
                for k, at in enumerate(range(0, len(x), width)):
                    cut = x[at : at + width]
                    doc.append(d), piece.append(k), start.append(at // 4), length.append(len(cut) // 4), ids.append(cut)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: best-fit decreasing over all of them, by their column length.

    pieces has the columns doc_id, piece and length (1 to capacity), is read twice and must not change in between:
    give a written table. Equal rows are told apart by rank only, so that repeated rows get places of their own; where
    one id may have very many pieces, as null may, a column p_salt of distinct numbers deals them out.
    An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    lengths = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    total = sum(r["count"] for r in lengths)
    rows = plan({r["length"]: r["count"] for r in lengths}, capacity)
    planned = spark.createDataFrame(rows, "p_length long, p_from long, p_to long, p_first long, p_each long, p_offset long")
    groups = max(1, -(-total // RANK_ROWS))
    order = [c for c in ("p_salt", "doc_id", "piece") if c in pieces.columns]
    dealt = pieces.withColumn("p_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    within = Window.partitionBy("length", "p_group")
    sizes = dealt.groupBy("length", "p_group").agg(F.count("*").alias("p_n"))
    before = sizes.select(F.col("length").alias("b_length"), F.col("p_group").alias("b_group"), (F.sum("p_n").over(Window.partitionBy("length").orderBy("p_group")) - F.col("p_n")).alias("p_before"))
    ranked = (
        dealt.withColumn("p_rank", F.row_number().over(within.orderBy(*order)) - 1)
        .join(before, (F.col("length") == F.col("b_length")) & (F.col("p_group") == F.col("b_group")))
        .withColumn("p_rank", F.col("p_rank") + F.col("p_before"))
    )
    at = F.col("p_rank") - F.col("p_from")
    return (
        ranked.join(F.broadcast(planned), (F.col("length") == F.col("p_length")) & (F.col("p_rank") >= F.col("p_from")) & (F.col("p_rank") < F.col("p_to")))
        .withColumn("sequence_id", F.col("p_first") + F.floor(at / F.col("p_each")).cast("long"))
        .withColumn("offset", F.col("p_offset") + F.pmod(at, F.col("p_each")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    slim = common.written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("p_salt")))
    return pack(slim, capacity).drop("p_salt")
