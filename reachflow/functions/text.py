"""Scalar expressions on UTF-8 bytes and keys, and cuts of many texts at once. Offsets are bytes, from 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets; null unless both lie within it, in order and on borders of characters."""
    data = F.encode(text, "UTF-8")
    fits = (start >= 0) & (start <= end) & (end <= F.octet_length(text)) & char_boundary(text, start) & char_boundary(text, end)
    return F.when(fits, F.decode(F.substring(data, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8"))


def char_boundary(text: Column, at: Column) -> Column:
    """Whether a byte offset lies at the begin of a character or at the end of the text."""
    byte = F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), (at + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.when((at < 0) | (at > F.octet_length(text)), False).when(at == F.octet_length(text), True).otherwise(byte.bitwiseAND(192) != 128)


def char_begins(text: Column) -> Column:
    """How many bytes of the text begin a character: those that don't go on with one, as 128 to 191 do."""
    return F.length(F.regexp_replace(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "[\\x{80}-\\x{BF}]", ""))


def joined_in_order(parts: Column) -> Column:
    """The texts of an array of structs (start, text), in order of start, as one."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")


def is_key_prefix(prefix: Column, key: Column) -> Column:
    """Whether an array begins with another."""
    return F.slice(key, 1, F.size(prefix)) == prefix


def key_hash(*parts: Column) -> Column:
    """Digest of a canonical key."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether the first span holds the second, ends included."""
    return (a_start <= b_start) & (b_end <= a_end)


#: Tasks take texts together up to about so many bytes.
SLICE_BYTES = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of about SLICE_BYTES, with the bytes of a column."""
    for batch in batches:
        begin = total = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            total += n
            if total >= SLICE_BYTES or k == batch.num_rows - 1:
                part = batch.slice(begin, k + 1 - begin)
                yield part, [x or b"" for x in part.column(column).to_pylist()]
                begin, total = k + 1, 0


def split_spans(texts: list[bytes], separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, start, end: what stands between separators of one byte in each text, empty parts too, in order."""
    is_separator = np.zeros(256, bool)
    is_separator[list(separators)] = True
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    # A separator behind each text ends its last part.
    end = np.flatnonzero(is_separator[np.frombuffer(b"".join(t + separators[:1] for t in texts), np.uint8)])
    start = np.append(0, end[:-1] + 1)[: len(end)]
    text = np.searchsorted(begins, start, "right") - 1
    return text, start - begins[text], end - begins[text]


def numbers_within(groups: np.ndarray) -> np.ndarray:
    """How many elements of its group stand before each one; equal groups stand together."""
    first = np.append(True, groups[1:] != groups[:-1])[: len(groups)]
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(first, at, 0))
