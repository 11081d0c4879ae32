"""FLAC streams of 8-bit mono samples: written, read with checksums verified, and cut into seekable PCM blocks.

Streams follow the public format: STREAMINFO, a SEEKTABLE with a point for each frame, then frames of one block of
BLOCK samples with a constant, verbatim, fixed or linear-predictor subframe and Rice-coded residuals. Frames are
independent, so that all frames of many streams are coded in lockstep, one array operation for the same sample of each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.llm import common

BLOCK, RATE, ORDER, PRECISION, SHIFT = 192, 8000, 4, 10, 8
PAD = 32
#: Frames of a PCM block.
BLOCK_FRAMES = 256
PCM = "doc_id long, n_bytes long, stream_bytes long, stream_sha256 string, blocks array<struct<sample_offset: long, byte_offset: long, pcm: binary>>"
PCM_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))
#: Bytes of texts, and frames, that are coded at once.
SLICE, FRAMES = 1_000_000, 4096
# Fixed values of the format: the predictors of orders 0 to 4.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]])
CONSTANT, VERBATIM, FIXED_TYPE, LPC_TYPE = 0, 1, 8, 32


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    """The checksum of each byte, most significant bit first."""
    crc = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, (crc << 1) ^ polynomial, crc << 1) & ((1 << bits) - 1)
    return crc


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each run of data."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    crc = np.zeros(len(starts), np.int64)
    for i in range(int(size[0]) if len(size) else 0):
        open_ = int(np.searchsorted(-size, -i, side="left"))
        live = crc[:open_]
        crc[:open_] = ((live << 8) & ((1 << bits) - 1)) ^ table[(live >> (bits - 8)) ^ data[begin[:open_] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)) or not tail:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *tail[::-1]])


_HEADERS: dict[int, bytes] = {}


def frame_header(number: int) -> bytes:
    """Sync code, fixed blocks of 192 samples at 8 kHz, one channel of 8 bits, the frame's number, CRC-8."""
    if number not in _HEADERS:
        head = bytes([0xFF, 0xF8, 0x14, 0x02]) + utf8_number(number)
        crc = 0
        for b in head:
            crc = int(CRC8[crc ^ b])
        if len(_HEADERS) > 100_000:
            _HEADERS.clear()
        _HEADERS[number] = head + bytes([crc])
    return _HEADERS[number]


def predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a linear predictor of ORDER for each row, by the autocorrelation method."""
    y = x.astype(np.float64)
    r = np.stack([(y[:, : BLOCK - k] * y[:, k:]).sum(axis=1) for k in range(ORDER + 1)])
    a, error = np.zeros((ORDER, len(x))), np.maximum(r[0], 1e-9) * 1.0001
    for m in range(ORDER):
        k = (r[m + 1] - (a[:m] * r[m:0:-1]).sum(axis=0)) / error
        a[:m] -= k * a[:m][::-1].copy()
        a[m] = k
        error *= np.maximum(1 - k * k, 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a.T * (1 << SHIFT)), -top - 1, top).astype(np.int64)


def residuals(x: np.ndarray, taps: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """x less its prediction; the columns of the first ORDER samples may not be predicted yet."""
    guess = np.zeros_like(x)
    for j in range(taps.shape[1]):
        guess[:, j + 1 :] += taps[:, j, None] * x[:, : BLOCK - 1 - j]
    return x - (guess >> (shift[:, None] if isinstance(shift, np.ndarray) else shift))


def folded(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def rice_parameter(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The Rice parameter (0 to 14) that suits the mean of folded residuals."""
    return np.clip(np.floor(np.log2(np.maximum(sums / n * 0.72, 1))), 0, 14).astype(np.int64)


def put_bits(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Writes values of equal width at bit positions."""
    for j in range(width):
        bits[at + width - 1 - j] = (values >> j) & 1


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All frames' bytes and the size of each; x: signed samples, a row of BLOCK for each frame."""
    frames, rows = len(x), np.arange(len(x))
    lpc = predictors(x)
    choices = [(k, np.broadcast_to(FIXED[k], (frames, 4)), 0) for k in (0, 1, 2)] + [(-1, lpc, SHIFT)]
    best, kind, order = np.full(frames, 8 + 8 * BLOCK), np.full(frames, VERBATIM), np.zeros(frames, np.int64)
    taps, shift, parameter = np.zeros((frames, 4), np.int64), np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    z = np.zeros((frames, BLOCK), np.int64)
    for k, own, by in choices:
        warm = ORDER if k < 0 else k
        fold = folded(residuals(x, own, by))
        fold[:, :warm] = 0
        n = np.full(frames, BLOCK - warm)
        p = rice_parameter(fold.sum(axis=1), n)
        size = 8 + 8 * warm + (9 + ORDER * PRECISION if k < 0 else 0) + 10 + n * (p + 1) + (fold >> p[:, None]).sum(axis=1)
        win = size < best
        best[win], kind[win], order[win], parameter[win], shift[win] = size[win], LPC_TYPE if k < 0 else FIXED_TYPE, warm, p[win], by
        taps[win], z[win] = own[win], fold[win]
    same = (x == x[:, :1]).all(axis=1)
    best[same], kind[same], order[same] = 16, CONSTANT, 0
    heads = [frame_header(n) for n in numbers.tolist()]
    head_size = np.array([len(h) for h in heads])
    sizes = head_size + (best + 7) // 8 + 2
    starts = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()) * 8, np.uint8)
    at = (starts + head_size) * 8
    code = np.where(kind == FIXED_TYPE, FIXED_TYPE + order, np.where(kind == LPC_TYPE, LPC_TYPE + order - 1, kind))
    put_bits(bits, at, code << 1, 8)
    at = at + 8
    put_bits(bits, at[same], x[same, 0] & 255, 8)
    whole = np.flatnonzero(kind == VERBATIM)
    put_bits(bits, (at[whole, None] + 8 * np.arange(BLOCK)).ravel(), (x[whole] & 255).ravel(), 8)
    for j in range(ORDER):
        own = rows[(kind >= FIXED_TYPE) & (order > j)]
        put_bits(bits, at[own], x[own, j] & 255, 8)
        at[own] += 8
    own = rows[kind == LPC_TYPE]
    put_bits(bits, at[own], np.full(len(own), PRECISION - 1), 4)
    put_bits(bits, at[own] + 4, np.full(len(own), SHIFT), 5)
    at[own] += 9
    for j in range(ORDER):
        put_bits(bits, at[own], taps[own, j] & ((1 << PRECISION) - 1), PRECISION)
        at[own] += PRECISION
    own = rows[kind >= FIXED_TYPE]
    put_bits(bits, at[own], parameter[own], 10)  # coding method 0 and partition order 0 come before it
    at[own] += 10
    p, quotient = parameter[own, None], z[own] >> parameter[own, None]
    lengths = np.where(np.arange(BLOCK) < order[own, None], 0, quotient + 1 + p)
    ends = at[own, None] + np.cumsum(lengths, axis=1)
    used = lengths > 0
    ends, values = ends[used], ((1 << p) | (z[own] & ((1 << p) - 1)))[used]
    p = np.broadcast_to(p, used.shape)[used]
    for j in range(int(p.max()) + 1 if len(p) else 0):
        live = p >= j
        bits[ends[live] - 1 - j] = (values[live] >> j) & 1
    data = np.packbits(bits)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    data[common.run_positions(starts, head_size)] = joined
    crc = checksums(data, starts, sizes - 2, CRC16, 16)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 255
    return data, sizes


#: A metadata block holds less than 2**24 bytes: so many seek points of 18 bytes behind a name of four.
MOST_POINTS = ((1 << 24) - 5) // 18
POINTS = np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
#: Application blocks of this name go on with the seek points of streams that have more frames than a seek table holds.
MORE = b"Seek"


def stream_head(samples: bytes, sizes: list[int]) -> bytes:
    """Marker, STREAMINFO with the MD5 of the samples, and a SEEKTABLE with each frame's sample offset."""
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    points = np.zeros(len(sizes), POINTS)
    points["sample"], points["at"], points["n"] = np.arange(len(sizes)) * BLOCK, np.cumsum([0, *sizes[:-1]]), BLOCK
    blocks = [(0, info)]
    for i in range(0, len(points), MOST_POINTS):
        part = points[i : i + MOST_POINTS].tobytes()
        blocks.append((2, MORE + part) if i else (3, part))
    return b"fLaC" + b"".join(bytes([kind | (128 if k == len(blocks) - 1 else 0)]) + len(body).to_bytes(3, "big") + body for k, (kind, body) in enumerate(blocks))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose size is a positive multiple of BLOCK; unsigned bytes become signed samples."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [encode_frames(x[i : i + FRAMES].astype(np.int64) - 128, numbers[i : i + FRAMES]) for i in range(0, len(x), FRAMES)]
    data, sizes = b"".join(p[0].tobytes() for p in parts), np.concatenate([p[1] for p in parts])
    ends, at, out = np.concatenate(([0], np.cumsum(sizes))), 0, []
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
        out.append(stream_head(signed, sizes[at : at + n].tolist()) + data[ends[at] : ends[at + n]])
        at += n
    return out


def parse_head(stream: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Frame offsets in the stream (with the end), the sample offset of each frame, and the MD5 of the samples."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, md5 = 4, False, [], b""
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            md5 = body[18:34]
            format_ = int.from_bytes(body[10:18], "big")
            if body[:2] != body[2:4] or int.from_bytes(body[:2], "big") != BLOCK or (format_ >> 41 & 7, format_ >> 36 & 31) != (0, 7):
                raise ValueError("only mono streams of 8 bits in blocks of 192 samples are read")
        elif kind == 3 or kind == 2 and body[:4] == MORE:
            points.append(np.frombuffer(body[4 * (kind == 2) :], POINTS))
    if not points:
        raise ValueError("the stream has no seek table")
    points = np.concatenate(points)
    return np.append(points["at"].astype(np.int64) + at, len(stream)), points["sample"].astype(np.int64), md5


class Bits:
    """64 bits from any bit position of an array, for many positions at once; 57 of them are valid."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.words = np.zeros(len(data) + 1, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(data) + 1].astype(np.uint64) << np.uint64(56 - 8 * k)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned values of a width (of one or for each; 0 gives 0) at bit positions."""
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, self.window(at) >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many zero bits come before the next one."""
        count, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            top = (self.window(at[open_] + count[open_]) >> np.uint64(12)).astype(np.float64)
            run = np.minimum(52 - np.frexp(top)[1], 52)
            count[open_] += run
            open_ = open_[run == 52]
        return count


def signed(values: np.ndarray, width: int) -> np.ndarray:
    return values - ((values >> (width - 1)) << width)


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (a row for each frame), frame numbers, and whether both checksums of each frame hold."""
    if not (data[starts] == 0xFF).all() or not (data[starts + 1] == 0xF8).all():
        raise ValueError("a frame does not begin with the sync code")
    lead = data[starts + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(extra == 0, lead, lead & (0x3F >> np.maximum(extra, 0)))
    for k in range(1, 7):
        own = extra >= k
        number[own] = number[own] << 6 | (data[starts[own] + 4 + k] & 0x3F)
    head = 5 + extra
    sound = checksums(data, starts, head, CRC8, 8) == data[starts + head]
    said = data[starts + sizes - 2].astype(np.int64) << 8 | data[starts + sizes - 1]
    sound &= checksums(data, starts, sizes - 2, CRC16, 16) == said
    bits, rows = Bits(data), np.arange(len(starts))
    at = (starts + head + 1) * 8
    code = bits.take(at, 8) >> 1
    at = at + 8
    x = np.zeros((len(starts), BLOCK), np.int64)
    constant, verbatim = rows[code == CONSTANT], rows[code == VERBATIM]
    x[constant] = signed(bits.take(at[constant], 8), 8)[:, None]
    whole = data[(at[verbatim] >> 3)[:, None] + np.arange(BLOCK)] if len(verbatim) else np.zeros((0, BLOCK))
    x[verbatim] = signed(whole.astype(np.int64), 8)
    own = rows[code >= FIXED_TYPE]
    is_lpc = code[own] >= LPC_TYPE
    order = np.where(is_lpc, code[own] - LPC_TYPE + 1, code[own] - FIXED_TYPE)
    if len(own) and order.max() > ORDER:
        raise ValueError("predictors of more than four samples are not read")
    y, at = np.zeros((len(own), BLOCK), np.int64), at[own]
    for j in range(ORDER):
        warm = order > j
        y[warm, j] = signed(bits.take(at[warm], 8), 8)
        at[warm] += 8
    taps, shift = FIXED[np.minimum(order, 4)].copy(), np.zeros(len(own), np.int64)
    lpc = np.flatnonzero(is_lpc)
    width = bits.take(at[lpc], 4) + 1
    shift[lpc] = bits.take(at[lpc] + 4, 5)
    at[lpc] += 9
    taps[lpc] = 0
    for j in range(ORDER):
        live = order[lpc] > j
        taps[lpc[live], j] = signed(bits.take(at[lpc[live]], width[live]), width[live])
        at[lpc[live]] += width[live]
    if (bits.take(at, 2) != 0).any():
        raise ValueError("only Rice coding with parameters of four bits is read")
    part = BLOCK >> bits.take(at + 2, 4)
    at = at + 6
    rice = np.zeros(len(own), np.int64)
    for i in range(BLOCK):
        begins = (i % part == 0) & (i >= order) | (i == order)
        if begins.any():
            rice[begins] = bits.take(at[begins], 4)
            at[begins] += 4
            if (rice == 15).any():
                raise ValueError("escaped partitions are not read")
        live = slice(None) if i >= ORDER else np.flatnonzero(order <= i)
        here, k = at[live], rice[live]
        quotient = bits.zeros(here)
        fold = quotient << k | bits.take(here + quotient + 1, k)
        at[live] = here + quotient + 1 + k
        guess = np.zeros(len(k), np.int64)
        for j in range(min(i, ORDER)):
            guess += taps[live, j] * y[live, i - 1 - j]
        y[live, i] = (guess >> shift[live]) + ((fold >> 1) ^ -(fold & 1))
    x[own] = y
    return x, number, sound


def decode(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """The payload of each stream, its frames' sample offsets and byte offsets; ValueError if a checksum doesn't hold."""
    heads = [parse_head(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    starts = np.concatenate([h[0][:-1] + b for h, b in zip(heads, base, strict=False)]) if streams else np.zeros(0, np.int64)
    sizes = np.concatenate([np.diff(h[0]) for h in heads]) if streams else np.zeros(0, np.int64)
    data, payloads = np.frombuffer(b"".join(streams), np.uint8), []
    for i in range(0, len(starts), FRAMES):
        own, size = starts[i : i + FRAMES], sizes[i : i + FRAMES]
        low, high = own[0], own[-1] + size[-1]
        x, _, sound = decode_frames(data[low:high], own - low, size)
        if not sound.all():
            raise ValueError("a frame's checksum does not hold")
        payloads.append((x + 128).astype(np.uint8).tobytes())
    whole, at, out = b"".join(payloads), 0, []
    for offsets, _, md5 in heads:
        payload = whole[at : at + (len(offsets) - 1) * BLOCK]
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest() != md5:
            raise ValueError("the samples' digest does not hold")
        out.append(payload)
        at += len(payload)
    return out, [h[1] for h in heads], [h[0][:-1] for h in heads]


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary) of every row: its text (null: empty), filled up with blanks to whole blocks, as a stream."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.slices(batches, "text", SLICE):
            filled = [t.ljust(max(BLOCK, -(-len(t) // BLOCK) * BLOCK), bytes([PAD])) for t in texts]
            yield pa.record_batch([rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode(filled), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(streams: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """The rows' doc_id, n_bytes, the bytes and digest of their streams, and blocks: the decoded samples, cut into PCM blocks.

    A block holds block_frames frames, the last one what is left. sample_offset is its first sample, byte_offset where
    its first frame begins in the stream, so that a reader may seek to any block in either form. Null ids stay null,
    repeated rows give equal rows; a null or broken stream, of which a checksum doesn't hold, raises ValueError.
    """
    step = block_frames * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in common.slices(batches, "media", SLICE):
            blocks = []
            for payload, samples, at in zip(*decode(data), strict=True):
                cut = range(0, len(payload), step)
                blocks.append([{"sample_offset": int(samples[k * block_frames]), "byte_offset": int(at[k * block_frames]), "pcm": payload[i : i + step]} for k, i in enumerate(cut)])
            columns = [rows.column("doc_id"), rows.column("n_bytes"), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array(blocks, PCM_BLOCKS)]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "stream_bytes", "stream_sha256", "blocks"])

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def write_pcm(streams: DataFrame, path: str) -> None:
    """Writes the PCM blocks of rows with doc_id, n_bytes and media; a stream's blocks stand in one row, in order."""
    pcm_blocks(streams).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def read_pcm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PCM).parquet(path)


def feature(payload: bytes) -> str:
    """Blocks, energy, sign changes, least and greatest of the signed samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"blocks={len(x) // BLOCK};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};min={x.min()};max={x.max()}"


def features(blocks: DataFrame) -> DataFrame:
    """Digests and features of each row of pcm_blocks(), from the samples of its blocks.

    media_bytes and media_sha256 are of the stored form, the PCM blocks in their order; stream_bytes and stream_sha256 are of
    the stream that they were decoded from. Repeated rows have equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, samples, stored, stored_bytes = batch.column("blocks"), [], [], []
            for i in range(batch.num_rows):
                blocks, digest = lists.slice(i, 1).flatten().field("pcm").to_pylist(), hashlib.sha256()
                for b in blocks:
                    digest.update(b)
                stored.append(digest.hexdigest()), stored_bytes.append(sum(map(len, blocks)))
                samples.append(b"".join(blocks))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(p) for p in samples], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in samples]), pa.array([zlib.crc32(p[-16:]) for p in samples], pa.int64()), pa.array(stored_bytes, pa.int64()), pa.array(stored), pa.array([feature(p) for p in samples]), batch.column("stream_bytes"), batch.column("stream_sha256")]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stream_bytes", "stream_sha256"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stream_bytes long, stream_sha256 string"
    return blocks.mapInArrow(run, schema)
