"""Encoders, packing and token files against the libraries and plain models."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reachflow.llm import bpe, packing, simple8b, token_files
from reachflow.llm.wordbpe import encoder

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, length string, IDS string"
ROWS = [(5, "The idea: it's 42 — naïve Ünïcode… 中文!", "x", "y"), (5, "The idea: it's 42 — naïve Ünïcode… 中文!", "x", "y"), (1, None, None, None), (2, "", None, None), (9, "word " * 30_000, "", ""), (None, "no id", None, None), (3, "x" * 5000, "a", "b"), (4, "\x1c\x02 \x00<|endoftext|>", "", "")]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_encoder_equals_the_library(library):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCEĞİıſßΣσςÀéüñ0189'’.,!?-—…#$%&*_ \t\n\r\x85\xa0 ́²½中😀👍\x1d\x02srevmld<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["ab" * 3000, "don't she'd", "", "É" * 200]
    got = encoder(WORDS).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeiou thern.'s\n0é中"), max_size=60), max_size=5))
def test_transducer_equals_the_merges(texts):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    enc = getattr(test_transducer_equals_the_merges, "enc", None)
    if enc is None:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
        test_transducer_equals_the_merges.enc = enc
    got = own.ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]
    assert ["".join(own.parts(x, 3)) for x in got] == texts


def test_long_words_leave_the_transducer_in_order(reference):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN).transducer
    for word in ("ab" * 4000, "the" * 2000, "zqx" * 999 + "ing"):
        assert own.encode(word) == reference.encode_ordinary(word)


def test_utf8_stream_waits_for_whole_characters():
    stream, data = bpe.Utf8Stream(), "aé中😀".encode()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.close() == "aé中😀"
    for bad in (b"\xc3", b"\xff", b"\xe4\xb8", b"\xed\xa0\x80", b"\xf0\x9f\x98a", b"\xc0\xaf"):
        stream = bpe.Utf8Stream()
        got = stream.feed(bad) + stream.close()
        assert "�" in got and got.replace("�", "") == bad.decode("utf-8", "ignore")


def test_byte_bpe_of_rows(spark, reference):
    docs = spark.createDataFrame(ROWS, DOCS)
    tokens = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted(map(tuple, bpe.digests(tokens, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for doc, text, *_ in ROWS:
        ids = reference.encode_ordinary(text or "")
        wanted.append((doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == sorted(wanted, key=str)
    assert bpe.digests(bpe.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, index = simple8b.encode(values)
    assert (simple8b.decode(words, index, len(values)) == values).all()


def test_simple8b_is_dense():
    words, _ = simple8b.encode(np.zeros(2048, np.uint64))
    assert len(words) == 2 * -(-1024 // 120)


def test_token_files(spark, tmp_path, library):
    docs = spark.createDataFrame(ROWS, DOCS)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, WORDS)
    rows = sorted(((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in token_files.read_tokens(spark, path).collect()), key=lambda r: r[1])
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in rows] == [r[0] for r in ordered]
    start = 0
    for (doc, at, ids, n), (_, text, *_) in zip(rows, ordered, strict=True):
        assert (at, ids, n) == (start, library(text) + [1], len(ids)), doc
        start += n
    empty = str(tmp_path / "empty")
    token_files.write_tokens(docs.limit(0), empty, WORDS)
    assert token_files.read_tokens(spark, empty).collect() == []
    with pytest.raises(ValueError):
        token_files.from_segment(b"\0" * 48)


def best_fit(lengths: list[int], capacity: int) -> int:
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fitting:
            bins[min(fitting)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_equals_best_fit_decreasing(lengths):
    rows, places = packing.plan(dict(Counter(lengths)), 32), {}
    for length, low, high, first, each, offset in rows:
        for rank in range(low, high):
            places[length, rank] = (first + (rank - low) // each, offset + (rank - low) % each * length)
    assert len(places) == len(lengths)
    bins: dict[int, list[tuple[int, int]]] = {}
    for (length, _), (sequence, offset) in places.items():
        bins.setdefault(sequence, []).append((offset, length))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 32
    assert len(bins) == best_fit(lengths, 32)


def test_packed_rows(spark, library):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = packing.packed_documents(docs, WORDS).collect()
    wanted: Counter = Counter()
    for doc, text, *_ in ROWS:
        ids = library(text) + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[at : at + 2048], "<u4")
            wanted[doc, piece, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    places: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in places.values():
        assert [o for o, _ in sorted(content)] == [sum(n for _, n in sorted(content)[:i]) for i in range(len(content))]
        assert sum(n for _, n in content) <= 2048
    assert len(places) == best_fit([r["length"] for r in rows], 2048)
    assert packing.packed_documents(docs.limit(0), WORDS).collect() == []


def test_words_of_equal_hashes(library, monkeypatch, spark, tmp_path):
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one[:1024], one[1024:], one, one.translate(str.maketrans("ab", "ba")), f"so {one} it {one[1024:]} so", "so it is"]
    want = [library(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(WORDS).encode(texts)] == want
    docs = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], DOCS)
    token_files.write_tokens(docs, str(tmp_path / "ids"), WORDS)
    read = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_files.read_tokens(spark, str(tmp_path / "ids")).collect()}
    assert read == {k: [*ids, 1] for k, ids in enumerate(want)}
    crc = {k: zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for k, ids in enumerate(want) if len(ids) < 2048}
    packed = {r.doc_id: r.ids_crc32 for r in packing.packed_documents(docs, WORDS).collect()}
    assert {k: packed[k] for k in crc} == crc
    own = encoder(WORDS)
    own.forget()
    monkeypatch.setattr("reachflow.llm.common.run_hashes", lambda data, starts, sizes: np.full(len(starts), 5, np.uint64))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts + texts)] == want + want
    own.forget()


def test_run_hashes_tell_runs_apart():
    from reachflow.llm import common

    runs = [bytes([k]) * n for k in (0, 1, 97) for n in (1, 7, 8, 9, 16, 255, 256, 257, 600)] + [b"ab", b"ba", b"\0a", b"a\0"]
    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array([len(r) for r in runs])
    hashes = common.run_hashes(data, np.cumsum(sizes) - sizes, sizes)
    assert len(set(hashes.tolist())) == len(set(runs))
    again = np.frombuffer(b"xy" + b"".join(reversed(runs)), np.uint8)
    assert common.run_hashes(again, 2 + np.cumsum(sizes[::-1]) - sizes[::-1], sizes[::-1]).tolist() == hashes[::-1].tolist()
