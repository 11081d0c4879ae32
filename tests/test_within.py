"""Queries that find everything about a text in the task that reads it: without a shuffle, and with the rows of the plain operators."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from reachflow.functions.text import split_spans
from reachflow.operators import lexing, rewriting, spans
from reachflow.plans import lexical
from tests.test_whole import by_oracle

ODD = [(1, "a bb\n\n c  ddddddd\n"), (2, ""), (3, None), (4, "\n \n"), (5, "漢字 é\nxxxxxxxxxx yyyyyyyyyyyy\nz"), (None, "w 漢"), (7, " "), (8, "abcdefgh")]


def documents(spark, tmp_path, rows=ODD) -> str:
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_spans():
    texts = ["a b", "", " ", "é\n"]
    found = [(t, texts[t].encode()[s:e].decode()) for t, s, e in zip(*split_spans([t.encode() for t in texts], b"\n "), strict=True)]
    assert found == [(0, "a"), (0, "b"), (1, ""), (2, ""), (2, ""), (3, "é"), (3, "")]
    assert all(len(x) == 0 for x in split_spans([], b" "))


@pytest.mark.parametrize("seed", range(4))
def test_deepest_owners(spark, seed):
    rng = random.Random(seed)
    units = [(rng.randrange(3), s, s + rng.choice([0, 2, 5, 30]), rng.randrange(2), rng.randrange(2), i) for i in range(40) for s in [rng.randrange(40)]]
    pieces = [(rng.randrange(4), s, s + rng.choice([0, 1, 4])) for s in [rng.randrange(40) for _ in range(60)]]
    at = spans.deepest(tuple(np.array(c) for c in zip(*pieces, strict=True)), tuple(np.array(c) for c in zip(*units, strict=True)))
    frame = spark.createDataFrame([(p[0], i, *p[1:]) for i, p in enumerate(pieces)], "source_id long, piece_id long, start long, end long")
    of = spark.createDataFrame([(u[0], u[5], *u[1:5]) for u in units], "source_id long, unit_id long, start long, end long, depth long, kind_rank long")
    assert {i: units[k][5] for i, k in enumerate(at.tolist()) if k >= 0} == {r["piece_id"]: r["owner"] for r in spans.piece_owners(frame, of).collect()}


def test_owners_of_words_are_found_in_place(spark, tmp_path):
    found = __spark_entry__.queries()["j3_piece_owners"](spark, documents(spark, tmp_path))
    assert "Exchange" not in plan(found)
    want = Counter()
    for i, text in ODD:
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            for w in line.split(" "):
                want[(i, at, at + len(w.encode()), k)] += bool(w)
                at += len(w.encode()) + 1
    assert Counter(tuple(r) for r in found.collect()) == +want


def noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["a", "b1", " ", " ", " ", "  ", "\n", "=", "/", "/", "*", "//", "/*", "*/", '"', "\\", "(", ")", ",", ".", ":", "é", "<", "7"]
    return ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(n)] + [" ", "", "   a", "b c d e f g " * 200, "/* a */ " * 30, "a" * 3000 + " b " + "c" * 3000 + " d"]


def frame(spark, seed: int, n: int):
    return spark.createDataFrame(list(enumerate(noise(seed, n))), "source_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_changed_tokens_equal_the_plain_operator(spark, seed):
    rng, sources = random.Random(seed), frame(spark, seed, 400)
    texts = noise(seed, 400)
    gone = [(k, a, min(len(t.encode()), a + rng.choice([1, 1, 2, 5, 20]))) for k, t in enumerate(texts) if t for a in rng.sample(range(len(t.encode())), min(6, len(t.encode()))) if "é" not in t]
    deletions = spark.createDataFrame([(k, i, a, b) for i, (k, a, b) in enumerate(gone)], "source_id long, deletion_id long, start long, end long")
    data = [t.encode() for t in texts]
    text, _, start, end, kind, _ = lexing.cut_texts(data, np.zeros(len(data), np.uint8))
    bad = lexing.changed(data, (text, start, end, kind), tuple(np.array(c) for c in zip(*gone, strict=True)))
    assert set(np.flatnonzero(bad).tolist()) == {r.deletion_id for r in lexing.disturbing(lexing.tokens(sources), deletions).collect()}


def test_runs_that_stay_equal_the_plain_operator(spark):
    rng, texts = random.Random(3), noise(3, 200)
    spaces = [(k, i, m.start(), m.end(), rng.random() < 0.5) for k, t in enumerate(texts) if "é" not in t for i, m in enumerate(re.finditer(" ", t))]
    elements = spark.createDataFrame([(k, 0, *rest) for k, *rest in spaces], "source_id long, list_id long, i long, start long, end long, kept boolean")
    data = [t.encode() for t in texts]
    text, _, start, end, kind, _ = lexing.cut_texts(data, np.zeros(len(data), np.uint8))
    own, i, s, e, kept = (np.array(c) for c in zip(*spaces, strict=True))
    stay = lexing.stays(data, (text, start, end, kind), (own, s, e, kept))
    assert set(zip(own[stay].tolist(), i[stay].tolist(), strict=True)) == {(r.source_id, r.i) for r in lexing.repaired(lexing.tokens(frame(spark, 3, 200)), elements).collect()}


@pytest.mark.parametrize("count", [lexical.disturbing_spaces, lexical.repaired_spaces])
def test_long_texts_go_by_pieces(spark, count):
    """Texts within a task, and by pieces of one byte more than the shortest ones and of fifty."""
    sources = frame(spark, 5, 60)
    whole = count(sources)
    assert "Exchange" not in plan(whole)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, count(sources, 50).collect())) != Counter()


@pytest.mark.parametrize("name", ["x6_disturbing_deletions", "e9_repaired"])
def test_spaces_of_documents(spark, small, tmp_path, name):
    columns, expected = by_oracle(small, name)
    assert Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, small).select(*columns).collect()) == expected
    found = __spark_entry__.queries()[name](spark, documents(spark, tmp_path))
    assert "Exchange" not in plan(found)
    assert found.count() == {"x6_disturbing_deletions": 3, "e9_repaired": 5}[name]


@pytest.mark.parametrize("seed", range(3))
def test_nested_lists_equal_the_plain_operator(spark, seed):
    rng, texts, rows, places = random.Random(seed), [], [], []

    def grow(text: str, parent: int, depth: int) -> str:
        here, n = [], rng.randrange(1, 4)
        for k in range(n):
            place, start = len(rows), len(text)
            rows.append(None)
            leaf = depth == 3 or rng.random() < 0.5
            text += "ab"[: rng.randrange(3)] if leaf else "{"
            if not leaf:
                text = (grow(text, place, depth + 1) if rng.random() < 0.8 else text) + "}"
            here.append((place, leaf, start, len(text), start - 1 if k else -1, len(text) + 1 if k < n - 1 else -1))
            text += "," if k < n - 1 else ""
        for place, leaf, *span in here:
            rows[place] = (len(texts), parent, leaf, leaf and rng.random() < 0.3, *span)
        return text

    for _ in range(30):
        texts.append(grow("", -1, 0))
    columns = tuple(np.array(c) for c in zip(*rows, strict=True))
    gone = rewriting.nested_gone(*columns[1:4])
    none = lambda x: x if x >= 0 else None
    elements = spark.createDataFrame([(t, str(i), str(p) if p >= 0 else None, leaf, s, e, none(a), none(b)) for i, (t, p, leaf, _, s, e, a, b) in enumerate(rows)], "source_id long, node string, parent string, leaf boolean, start long, end long, ahead long, behind long")
    kept = spark.createDataFrame([(str(i),) for i, r in enumerate(rows) if r[3]], "node string")
    sources = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    want = {r.source_id: r.text for r in rewriting.rewritten(sources, rewriting.nested_deletions(elements, kept))[0].collect()}
    text, _, _, _, start, end, ahead, behind = columns
    begin = np.where((behind < 0) & (ahead >= 0), ahead, start)
    got = rewriting.without([t.encode() for t in texts], (text[gone], begin[gone], np.where(behind < 0, end, behind)[gone]))
    assert {k: t.decode() for k, t in enumerate(got)} == want
    assert rewriting.without([], tuple(np.zeros(0, np.int64) for _ in range(3))) == []


def test_nested_lists_of_documents(spark, small, tmp_path):
    columns, expected = by_oracle(small, "e3_nested_lists")
    query = __spark_entry__.queries()["e3_nested_lists"]
    assert Counter(tuple(r) for r in query(spark, small).select(*columns).collect()) == expected
    path = documents(spark, tmp_path, [r for r in ODD if r[0] is not None])
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        want = Counter(db.execute(__spark_entry__.oracle_sql()["e3_nested_lists"]).fetchall())
    found = query(spark, path)
    assert "Exchange" not in plan(found)
    assert Counter(tuple(r) for r in found.collect()) == want
