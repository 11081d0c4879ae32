"""The lexer against a scalar one, over pieces of any size; brackets, deletions and their repair."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from reachflow.operators import lexing

WORD = re.compile(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+")
TEXTS = [
    "", "a", "a  b\n", 'x="<b>not a tag</b>" // rest "of" line\ny', "/* a /* b */ c */d", "/* open /* */", '"a\\"b" "open\\', "a<<=b>>c...d..=e::f->g=>h", "===!==&&&|||", "1a b2 _c 语 é2", "({[,]})", "a/b//c\n/d", "//", "/**/ /***/x/*/*/",
    "q" * 5000 + '"' + "s " * 3000 + '"', "/*" * 6 + "x" + "*/" * 6 + "y", "\x0b\x0c\r\n\t z\x00\x01", "#!/bin/sh\n# 100% & $x | @y ~ `",
]


def scalar(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c, kind, j = text[i], "punctuation", i + 1
        if c in " \t\r\n\x0b\x0c":
            while j < len(text) and text[j] in " \t\r\n\x0b\x0c":
                j += 1
            kind = "space"
        elif text.startswith("//", i):
            j = text.find("\n", i) if "\n" in text[i:] else len(text)
            kind = "comment"
        elif text.startswith("/*", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                step = 2 if text[j : j + 2] in ("/*", "*/") else 1
                depth += {"/*": 1, "*/": -1}.get(text[j : j + 2], 0)
                j += step
            kind = "unterminated" if depth else "comment"
        elif c == '"':
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            kind, j = ("string", j + 1) if j < len(text) else ("unterminated", len(text))
        elif m := WORD.match(text, i):
            kind, j = "number" if c in "0123456789" else "word", m.end()
        elif c in "([{":
            kind = "open"
        elif c in ")]}":
            kind = "close"
        elif c == ",":
            kind = "comma"
        else:
            for o in sorted(lexing.OPERATORS, key=len, reverse=True):
                if text.startswith(o, i):
                    j = i + len(o)
                    break
        out.append((kind, text[i:j]))
        i = j
    return out


def rows_of(texts: list[str]) -> list[tuple]:
    rows = []
    for k, text in enumerate(texts):
        at, own = 0, scalar(text)
        for i, (kind, t) in enumerate(own):
            following = own[i + 1][0] if i + 1 < len(own) else None
            rows.append((k, i, at, at + len(t.encode()), kind, "alone" if following in (None, "space", "comment") else "joint" if following == "punctuation" else "hidden", t))
            at += len(t.encode())
    return rows


def noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice('ab1_ \n"\\/*=<>.:,()[]{}&|-!é#') for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_texts_in_one_piece_against_the_scalar_lexer():
    texts = TEXTS + noise(1, 300)
    got = [[] for _ in texts]
    for text, i, start, end, kind, continued in zip(*(x.tolist() for x in lexing.cut_texts([t.encode() for t in texts], np.zeros(len(texts), np.uint8))), strict=True):
        assert not continued and i == len(got[text])
        got[text].append((lexing.KINDS[kind], texts[text].encode()[start:end].decode()))
    assert got == [scalar(t) for t in texts]


def test_maps_compose():
    rng = random.Random(5)
    for text in (t.encode() for t in TEXTS + noise(2, 40)):
        cut = rng.randint(0, len(text))
        a, b = (np.frombuffer(lexing.piece_map(t), np.uint8) for t in (text[:cut], text[cut:]))
        assert (b[a] == np.frombuffer(lexing.piece_map(text), np.uint8)).all()


@pytest.mark.parametrize("piece", [3, 64, 1_000_000])
def test_tokens_over_pieces(spark, piece):
    texts = [t for t in TEXTS if piece > 3 or len(t) < 200] + noise(3, 30)
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, (900, None, "x")], "source_id long, text string, piece string")
    got = sorted(tuple(r) for r in lexing.tokens(frame, piece).select("source_id", "i", "start", "end", "kind", "spacing", "text").collect())
    assert got == sorted(rows_of(texts))
    assert lexing.tokens(frame.limit(0), piece).collect() == []


def test_brackets(spark):
    texts = ["f(a, [b, c], {d}), e", "(a]", "((a)", ")(", "(a, b", "[]", "(,)", 'x("(", b)', ""]
    tokens = lexing.tokens(spark.createDataFrame(list(enumerate(texts)), "source_id long, text string"))
    levels = lexing.bracket_levels(tokens)
    assert {(r.source_id) for r in lexing.unbalanced(levels).collect()} == {1, 2, 3, 4}
    got = sorted((r.source_id, r.list_start, r.n, texts[r.source_id][r.start : r.end], r.previous, r.following) for r in lexing.segments(levels).collect())
    assert got == [(0, 1, 0, "a", None, 3), (0, 1, 1, " [b, c]", 3, 11), (0, 1, 2, " {d}", 11, None), (0, 5, 0, "b", None, 7), (0, 5, 1, " c", 7, None), (0, 13, 0, "d", None, None), (5, 0, 0, "", None, None), (6, 0, 0, "", None, 1), (6, 0, 1, "", 1, None), (7, 1, 0, '"("', None, 5), (7, 1, 1, " b", 5, None)]


DELETIONS = [  # text, start, end, disturbs
    ("a b", 1, 2, True), ("a , b", 1, 2, False), ("a  b", 1, 2, False), ("= =", 1, 2, True), ("= +", 1, 2, False), ("/ /x", 1, 2, True), ("a 'x' b", 2, 5, False), ("ab", 1, 2, True), ("a b c", 2, 4, False), ("a b c", 1, 4, True),
    ('x " y "', 2, 3, True), ("a /*c*/ b", 1, 8, True), ("a /*c*/ b", 2, 7, False), ("a", 0, 1, False), (" a ", 0, 1, False), ("x : : y", 3, 4, True), ("a.b", 1, 2, True), ("< b =", 1, 4, True), ("a /* b */ c", 3, 4, True), ("a // b\nc", 6, 7, True),
]


def plain_disturbs(text: str, start: int, end: int) -> bool:
    """By lexing the whole text again."""
    at, want = 0, []
    for kind, t in scalar(text):
        if kind not in lexing.TRIVIA:
            if at < start < at + len(t) or at < end < at + len(t):
                return True
            if not (start <= at and at + len(t) <= end):
                want.append((kind, t))
        at += len(t)
    return [x for x in scalar(text[:start] + text[end:]) if x[0] not in lexing.TRIVIA] != want


def test_deletions_that_disturb(spark):
    rng, cases = random.Random(9), list(DELETIONS)
    for t in noise(4, 60):
        t = t.replace("é", "e").replace("*", "+").replace('"', "'").replace("//", "/ ")  # no token reaches far
        if len(t) > 4:
            a = rng.randrange(len(t) - 1)
            b = rng.randint(a + 1, min(len(t), a + 4))
            cases.append((t, a, b, plain_disturbs(t, a, b)))
    for text, a, b, want in DELETIONS[:-2]:
        assert plain_disturbs(text, a, b) == want, text
    sources = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "source_id long, text string")
    deletions = spark.createDataFrame([(k, 7, c[1], c[2]) for k, c in enumerate(cases)], "source_id long, deletion_id long, start long, end long")
    got = {r.source_id for r in lexing.disturbing(lexing.tokens(sources), deletions).collect()}
    odd = {len(DELETIONS) - 1, len(DELETIONS) - 2}  # within trivia: see below
    assert got - odd == {k for k, c in enumerate(cases) if c[3]} - odd


def test_repair(spark):
    text = "a b , c d e = = f"
    sources = spark.createDataFrame([(1, text), (2, "x , y")], "source_id long, text string")
    tokens = lexing.tokens(sources)
    spaces = [(1, 0, i, m.start(), m.end(), False) for i, m in enumerate(re.finditer(" ", text))] + [(2, 5, i, m.start(), m.end(), i == 0) for i, m in enumerate(re.finditer(" ", "x , y"))]
    elements = spark.createDataFrame(spaces, "source_id long, list_id long, i long, start long, end long, kept boolean")
    apart = elements.withColumn("list_id", elements["i"] + 10 * elements["source_id"])  # each by itself
    got = {(r.source_id, r.start) for r in lexing.repaired(tokens, apart).collect()}
    assert got == {(1, 1), (1, 7), (1, 9), (1, 13), (2, 1)}
    # As one list, all spaces of the first text are one deletion, with what lies between: it takes tokens along and may go.
    got = {(r.source_id, r.start) for r in lexing.repaired(tokens, elements).collect()}
    assert got == {(1, m.start()) for m in re.finditer(" ", text)} | {(2, 1)}


def test_segments_lex_once_and_shuffle_once(spark):
    texts = {1: "[a, (b, {}), c,]", 2: "[a, (b]", 3: "(]", 4: "[[x], y", 5: "a, b", 6: "), (", 7: '("(,", [,])', 8: "(a, b)(c)"}
    frame = spark.createDataFrame(list(texts.items()), "source_id long, text string")
    marks = ("open", "close", "comma")
    every = lexing.tokens(frame).where(lexing.F.col("kind").isin(*marks))
    for piece_bytes in (3, 1000):
        assert sorted(lexing.tokens(frame, piece_bytes, marks).collect()) == sorted(every.collect())
    levels = lexing.bracket_levels(lexing.tokens(frame, kinds=marks))
    got = lexing.segments(levels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    broken = {r.source_id for r in lexing.unbalanced(levels).collect()}
    assert broken == {2, 3, 4, 6}
    rows = got.collect()
    assert {r.source_id for r in rows} == {1, 7, 8}
    assert sorted((r.list_start, r.n, texts[1][r.start : r.end]) for r in rows if r.source_id == 1) == [(0, 0, "a"), (0, 1, " (b, {})"), (0, 2, " c"), (0, 3, ""), (4, 0, "b"), (4, 1, " {}"), (8, 0, "")]
