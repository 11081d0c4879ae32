"""FLAC streams and shuffled shards: exact round trips and laws."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reachflow.llm import flac, sharding

SCHEMA = "doc_id long, text string, shard string, MEDIA string"
ROWS = [(1, "hello wörld", "a", "b"), (1, "hello wörld", "a", "b"), (2, None, "", ""), (3, "", None, None), (4, "ab " * 60_000, "", ""), (None, "no id", "", ""), (7, "~" * 192, "", "")]


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(192, -(-len(data) // 192) * 192), b" ")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=1, max_size=4))
def test_streams_are_lossless(parts):
    payloads = [p.ljust(max(192, -(-len(p) // 192) * 192), b" ") for p in parts]
    streams = flac.encode(payloads)
    found, samples, offsets = flac.decode(streams)
    assert found == payloads
    for stream, s, at in zip(streams, samples, offsets, strict=True):
        assert s.tolist() == [192 * i for i in range(len(s))]
        assert all(stream[i : i + 2] == b"\xff\xf8" for i in at.tolist())


def test_all_kinds_of_subframes():
    t = np.arange(192 * 40)
    waves = [np.full(len(t), 77), 128 + 90 * np.sin(t / 9), 128 + t % 7, np.random.default_rng(1).integers(0, 256, len(t)), np.where(t % 2, 0, 255)]
    payloads = [w.astype(np.uint8).tobytes() for w in waves]
    streams = flac.encode(payloads)
    assert flac.decode(streams)[0] == payloads
    assert len(streams[0]) < len(payloads[0]) / 5 and len(streams[1]) < len(payloads[1]) * 0.8
    kinds = set()
    for s in streams:
        at, _, _ = flac.parse_head(s)
        for i in at[:-1]:
            extra = 0 if s[i + 4] < 0x80 else 1
            kinds.add(min(s[i + 6 + extra] >> 1, 33) // 8)
    assert {0, 1, 4} <= kinds


def test_broken_streams_are_refused():
    (stream,) = flac.encode([padded("some text " * 40)])
    for at in (len(stream) - 1, len(stream) - 60):
        broken = bytearray(stream)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF" + stream[4:]])


def test_streams_with_more_frames_than_a_seek_table_holds(monkeypatch):
    monkeypatch.setattr(flac, "MOST_POINTS", 3)
    payloads = [padded("abc " * 700), padded("x")]
    assert flac.decode(flac.encode(payloads))[0] == payloads


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20):
        data = flac.utf8_number(n)
        assert data == (chr(n).encode("utf-8", "surrogatepass") if n < 0x110000 else data)


def test_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    media = flac.media(docs)
    flac.write_pcm(media, str(tmp_path / "pcm"))
    blocks = flac.read_pcm(spark, str(tmp_path / "pcm"))
    got = sorted((tuple(r) for r in flac.features(blocks).collect()), key=str)

    def plain(d, t) -> tuple:
        p, stream = padded(t), flac.encode([padded(t)])[0]
        x = [b - 128 for b in p]
        told = f"blocks={len(p) // 192};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};min={min(x)};max={max(x)}"
        sha = hashlib.sha256(p).hexdigest()
        return (d, len((t or "").encode()), len(p), sha, zlib.crc32(p[-16:]), len(p), sha, told, len(stream), hashlib.sha256(stream).hexdigest())

    assert got == sorted((plain(d, t) for d, t, *_ in ROWS), key=str)
    same = {r["stream_sha256"] for r in flac.features(blocks).where("doc_id = 1").collect()}
    assert len(same) == 1
    (long,) = [r["blocks"] for r in blocks.where("doc_id = 4").collect()]
    assert len(long) == 4 and b"".join(bytes(r["pcm"]) for r in long) == padded("ab " * 60_000)
    assert [r["sample_offset"] for r in long] == [192 * flac.BLOCK_FRAMES * i for i in range(len(long))]
    (stream,) = [bytes(r["media"]) for r in media.where("doc_id = 4").collect()]
    for k, r in enumerate(long):  # a reader seeks to the block's first frame
        at = r["byte_offset"]
        x, number, sound = flac.decode_frames(np.frombuffer(stream, np.uint8)[at:], np.array([0]), np.array([flac.parse_head(stream)[0].tolist()[k * flac.BLOCK_FRAMES + 1] - at]))
        assert sound.all() and number[0] == k * flac.BLOCK_FRAMES and (x[0] + 128).astype(np.uint8).tobytes() == bytes(r["pcm"])[:192]
    assert flac.features(flac.pcm_blocks(flac.media(docs.limit(0)))).collect() == []


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    before = sharding.jump_hash(keys, 16)
    after = sharding.jump_hash(keys, 17)
    assert ((before == after) | (after == 16)).all()
    assert abs((after == 16).mean() - 1 / 17) < 0.01
    assert np.bincount(before, minlength=16).min() > 1000


def test_fisher_yates_is_a_permutation_and_uniform():
    assert sharding.fisher_yates(0, 1).tolist() == []
    seen = np.zeros((4, 4))
    for seed in range(4000):
        p = sharding.fisher_yates(4, seed)
        assert sorted(p.tolist()) == [0, 1, 2, 3]
        seen[np.arange(4), p] += 1
    assert abs(seen / 4000 - 0.25).max() < 0.05


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame([*ROWS, *[(i, f"text {i}", "", "") for i in range(100, 400)]], SCHEMA)
    found = []
    for name in ("a", "b"):
        path = str(tmp_path / name)
        sharding.write_shards(docs, path, bucket_bytes=2000)
        found.append(sorted(map(tuple, sharding.read_shards(spark, path).collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == 307
    slots: dict[int, list[int]] = {}
    for _, text, size, law, shard, slot, grown in found[0]:
        assert size == len((text or "").encode()) + 1 and law == "key" and grown in (shard, 16)
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sharding.write_shards(docs.limit(0), str(tmp_path / "empty"))
    assert sharding.read_shards(spark, str(tmp_path / "empty")).collect() == []
