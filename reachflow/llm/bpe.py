"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine.

Texts are split by the vocabulary's pattern; the transducer of transducer.py encodes each distinct pretoken.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachflow.llm import common
from reachflow.llm.transducer import Transducer

#: When so many pretokens are remembered, they are forgotten.
MOST_WORDS = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """The encoding by its definition, with ranks below a bound: the neighbours of least rank merge, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def of_ranks(ranks: dict[bytes, int]) -> Transducer:
    """The transducer of a rank file: two tokens merge if their concatenation is a token, of that one's rank."""
    name = {rank: token.decode("latin-1") for token, rank in ranks.items()}
    tokens = {token: rank for rank, token in name.items()}

    def merges(a: int, b: int) -> tuple[int, int] | None:
        rank = tokens.get(name[a] + name[b])
        return None if rank is None else (rank, rank)

    def parts(token: int) -> tuple[int, int] | None:
        text = name[token].encode("latin-1")
        if len(text) == 1:
            return None
        pair = merged(text, ranks, token)
        if len(pair) != 2:
            raise ValueError(f"token {token} can't be reached by merges")
        return pair[0], pair[1]

    return Transducer(tokens, merges, parts)


class Utf8Stream:
    """Decodes bytes that arrive in parts: a character's bytes wait until it is whole; what can't be one becomes U+FFFD."""

    #: Fixed values of UTF-8: by lead byte, the bytes that follow and the range of the first of them.
    LEADS = {range(0xC2, 0xE0): (1, 0x80, 0xBF), range(0xE0, 0xE1): (2, 0xA0, 0xBF), range(0xE1, 0xED): (2, 0x80, 0xBF), range(0xED, 0xEE): (2, 0x80, 0x9F), range(0xEE, 0xF0): (2, 0x80, 0xBF), range(0xF0, 0xF1): (3, 0x90, 0xBF), range(0xF1, 0xF4): (3, 0x80, 0xBF), range(0xF4, 0xF5): (3, 0x80, 0x8F)}
    STATES = {byte: rule for span, rule in LEADS.items() for byte in span}

    def __init__(self) -> None:
        self.held, self.wanted, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, part: bytes) -> str:
        if not self.wanted and part.isascii():
            return part.decode("ascii")
        out: list[str] = []
        for byte in part:
            if self.wanted:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.wanted, self.low, self.high = self.wanted - 1, 0x80, 0xBF
                    if not self.wanted:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.wanted, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.STATES:
                self.wanted, self.low, self.high = self.STATES[byte]
                self.held.append(byte)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.wanted = bool(self.held), 0
        self.held.clear()
        return "�" * left


class Codec:
    """Encodes and decodes whole texts; ids of short pretokens are remembered, within a bound."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.transducer, self.split = of_ranks(ranks), regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        names = {rank: token for token, rank in ranks.items()}
        self.token = [names.get(i, b"") for i in range(max(names) + 1)]
        self.decimal = [str(i).encode() for i in range(len(self.token))]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = self.words
        if len(words) > MOST_WORDS:
            words.clear()
        pieces = [self.split.findall(text) for text in texts]
        new = list({p for part in pieces for p in part}.difference(words))
        words.update(zip(new, self.transducer.encode_many([p.encode().decode("latin-1") for p in new]), strict=True))
        return [b"".join(map(words.__getitem__, part)) for part in pieces]

    def parts(self, ids: bytes, many: int = 4096) -> Iterator[str]:
        """The text of ids as it comes, in parts of at most so many ids."""
        stream, values, token = Utf8Stream(), np.frombuffer(ids, "<u4").tolist(), self.token
        for i in range(0, len(values), many):
            part = b"".join(map(token.__getitem__, values[i : i + many]))
            yield stream.feed(part)
        yield stream.close()

    def text_bytes(self, ids: bytes) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def joined(self, ids: bytes) -> bytes:
        """Decimal ids, a space between."""
        return b" ".join(map(self.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This process's codec of the rank file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits) of every row; a null text is empty. Other columns are left out."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for rows, texts in common.slices(batches, "text"):
            yield pa.record_batch([rows.column("doc_id"), pa.array(own.ids([t.decode() for t in texts]), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids: the streamed text, U+FFFD where the ids' bytes are no UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = ["".join(own.parts(x or b"")) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids, a space between), decoded_sha256 (of the streamed decoding) of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            n = [len(x) // 4 for x in ids]
            first = [hashlib.sha256(own.joined(x)).hexdigest() for x in ids]
            second = []
            for x in ids:
                h = hashlib.sha256()
                for part in own.parts(x):
                    h.update(part.encode())
                second.append(h.hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
