"""Near-duplicates against brute force; sketches; the pipeline."""

from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from reachflow.llm import minhash

SCHEMA = "doc_id long, text string, component string, KEPT string"


def plain_set(text: str | None) -> frozenset:
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(rows: list, similarity: int) -> dict:
    known = {d: plain_set(t) for d, t in rows if d is not None}
    ids, parent = sorted(known), {d: d for d in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = known[a], known[b]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def _texts(seed: int) -> list[tuple[int | None, str | None]]:
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows: list = []
    for base in range(12):
        words = rng.choice(vocabulary, rng.integers(3, 160)).tolist()
        for copy in range(rng.integers(1, 14)):
            own = list(words)
            for _ in range(rng.integers(0, 6)):
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            rows.append((1000 * base + copy, (" ", "\n", "\t ")[copy % 3].join(own).upper() if copy % 2 else " ".join(own)))
    return rows + [(50_000, None), (50_001, ""), (50_002, " \n\t"), (50_003, "one two"), (50_004, "ONE  two"), (50_005, "two one"), (50_006, "long " * 30_000), (50_007, "\xa0 a b c d"), (None, "one two")]


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 512), (2, 3)):  # small blocks: a bucket has many
        monkeypatch.setattr(minhash, "BLOCK_SETS", block), monkeypatch.setattr(minhash, "STAR_SETS", block)
        rows = _texts(seed)
        frame = spark.createDataFrame([(d, t, "c", "k") for d, t in rows], SCHEMA)
        for similarity in (80, 85):
            wanted = plain_components(rows, similarity)
            got = minhash.near_duplicates(frame, similarity).collect()
            assert len(got) == len(rows)
            for r in got:
                if r["doc_id"] is None:
                    assert r["component_id"] is None and r["kept"]
                else:
                    assert r["component_id"] == wanted[r["doc_id"]], r
                    assert r["kept"] == (r["component_id"] == r["doc_id"])
            sizes = {d: len(plain_set(t)) for d, t in rows}
            assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)
            stay = minhash.kept(frame, similarity)
            assert stay.columns == frame.columns
            assert sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] is not None) == sorted(d for d, c in wanted.items() if d == c)


def test_no_rows_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "x")], "doc_id long, text string")
    assert minhash.near_duplicates(frame.limit(0)).collect() == []
    assert sorted(map(tuple, minhash.near_duplicates(frame).collect())) == [(1, 2, 1, True)] * 3 + [(2, 1, 2, True)]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert minhash.sketch(s).max() < np.iinfo(np.uint64).max
    for share in (0.2, 0.5, 0.85):
        errors = []
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
            both = int(share * 500)
            rest = (500 - both) // 2
            a, b = np.sort(pool[: both + rest]), np.sort(np.concatenate((pool[:both], pool[both + rest : both + 2 * rest])))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((minhash.sketch(a) == minhash.sketch(b)).mean() - j)
        assert abs(np.mean(errors)) < 0.03


def test_intersections_by_products():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    got = minhash.intersections([s.tobytes() for s in sets], [s.tobytes() for s in sets[::-1]])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]).all()


def test_pipeline(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, left = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, small)
        assert left.columns == columns
        left = spark.createDataFrame(left.collect(), docs.schema)
    ids = {r["doc_id"] for r in left.collect()}
    assert {r["doc_id"] for r in rows} == ids and 0 < len(ids) < docs.count()
    kept = plain_components([(r["doc_id"], r["text"]) for r in left.collect()], 80)
    assert all(d == c for d, c in kept.items())


def test_stages_take_odd_rows(spark, small):
    """Nulls, empty and long texts, repeated rows, clashing names: no stage fails or invents a row; empty tables stay empty."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, scored_text string, k_symbols long, K_PERPLEXITY string, gone_id long"
    rows = [(None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", 1, "y", 1), (2, "the the " * 20_000, None, None, None, None, None, None, None)]
    rows += [(3, "Thinor of the hand.", "en", "s", 1, "x", 1, "y", 3)] * 2
    frame = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, small)
        assert out.columns == frame.columns, name
        assert {r["doc_id"] for r in out.collect()} <= {None, 1, 2, 3}
        assert stage(spark, frame.limit(0), small).collect() == []
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, small)
    assert {r["doc_id"] for r in packed.collect()} == {None, 1, 2, 3}


def thue_morse(n: int) -> str:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_in_sums_of_powers(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"x {one} y z w v"), (4, f"x {two} y z w v"), (5, one[:200]), (6, two[:200]), (7, one)]
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}
    assert {r.n_shingles for r in got if r.doc_id in (3, 4)} == {2}


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other words of no other text at all"), (1, None), (5, b), (0, a + " end"), (9, "alone words of no text but this"), (9, "second text of the very same id nine")]
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (1, 0), (1, 1), (2, 0), (3, 0), (4, 4), (5, 0), (9, 9), (9, 9)]
