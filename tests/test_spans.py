"""Spans, rewriting, ordinals, groups, diffs, checks and files."""

from __future__ import annotations

import datetime
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from reachflow.functions import text as X
from reachflow.operators import checks, diffs, groups, ordinals, rewriting, spans
from reachflow.sources import files
from reachflow.streaming.growing import grow_reachable


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_and_overlap(spark, seed):
    rng = random.Random(seed)
    outer = [(rng.randrange(2), i, s, s + rng.choice([0, 1, 3, 40, 5000, 10**7]), rng.randrange(3)) for i in range(60) for s in [rng.randrange(0, 6000)]]
    inner = [(rng.randrange(2), i, s, s + rng.choice([0, 1, 7, 300])) for i in range(60) for s in [rng.randrange(0, 6000)]]
    o = spark.createDataFrame(outer, "source_id long, unit_id long, start long, end long, depth long")
    i = spark.createDataFrame(inner, "source_id long, site_id long, start long, end long")
    pairs = {(a, x) for s, a, b, e in inner for t, x, c, f, _ in outer if s == t and c <= b and e <= f}
    got = [(r["site_id"], r["o_unit_id"]) for r in spans.containing(i, o).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    met = {(a, x) for s, a, b, e in inner for t, x, c, f, _ in outer if s == t and max(b, c) < min(e, f)}
    got = [(r["site_id"], r["o_unit_id"]) for r in spans.overlapping(i, o).collect()]
    assert len(got) == len(set(got)) and set(got) == met
    best = {}
    for a, x in pairs:
        _, _, c, f, d = outer[x]
        best.setdefault(a, []).append((f - c, -d, x))
    wanted = {(a, x) for a, v in best.items() for n, d, x in v if (n, d) == min(y[:2] for y in v)}
    assert {(r["site_id"], r["owner"]) for r in spans.innermost_owners(i, o).collect()} == wanted
    one, wrong = spans.unique_owners(i, o)
    assert one.count() + wrong.count() == len(inner)


def test_coalescing_and_pieces(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 6), (1, 5, 9), (2, 1, 1)], "k long, start long, end long")
    assert sorted(map(tuple, spans.coalesced(rows, "k").collect())) == [(1, 0, 3), (1, 5, 9), (2, 1, 1)]
    docs = spark.createDataFrame([(1, "añb中c d"), (2, ""), (3, None), (4, "xyz")], "source_id long, text string")
    gone = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (4, 0, 3), (1, 8, 8)], "source_id long, start long, end long")
    text, pieces = rewriting.rewritten(docs, gone)
    assert {r["source_id"]: r["text"] for r in text.collect()} == {1: "a中c d", 2: "", 3: None, 4: ""}
    assert sorted(map(tuple, pieces.collect())) == [(1, 0, 1, 0, 1), (1, 1, 7, 4, 10)]
    assert rewriting.map_gaps(pieces).collect() == []
    asked = spark.createDataFrame([(1, 7, 0, 1), (1, 8, 0, 4), (1, 9, 1, 4), (1, 10, 6, 9)], "source_id long, range_id long, start long, end long")
    back = {r["range_id"]: (r["orig_start"], r["orig_end"]) for r in spans.to_original(asked, pieces).collect()}
    assert back == {7: (0, 1), 8: (0, 7), 9: (4, 7), 10: (9, None)}


def test_coalescing_puts_nulls_last(spark, tmp_path):
    day = datetime.datetime(2000, 1, 1)
    rows = [(1, None, day), (1, 3, day), (2, 1, None), (2, 2, day), (3, 1, None), (3, None, None), (4, 2, day), (4, 2, day), (5, None, day), (None, 1, day), (None, 1, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = Counter(db.execute(__spark_entry__.oracle_sql()["w8_coalesced"]).fetchall())
    assert Counter(tuple(r) for r in __spark_entry__.queries()["w8_coalesced"](spark, str(tmp_path)).collect()) == want


def test_lists_and_repetitions(spark):
    def cut(gone):
        words = ["a", "bb", "c", "dd", "e"]
        line, at, rows = ", ".join(words), 0, []
        for k, w in enumerate(words):
            rows.append((1, 1, k, at, at + len(w), w in gone))
            at += len(w) + 2
        frame = spark.createDataFrame(rows, "source_id long, list_id long, i long, start long, end long, gone boolean")
        deletions = rewriting.list_deletions(frame, F.col("gone"))
        return rewriting.rewritten(spark.createDataFrame([(1, line)], "source_id long, text string"), deletions)[0].first()["text"]

    assert cut({"a"}) == "bb, c, dd, e"
    assert cut({"c", "dd"}) == "a, bb, e"
    assert cut({"e", "dd"}) == "a, bb, c"
    assert cut({"a", "bb", "c", "dd", "e"}) == ""
    elements = spark.createDataFrame([(1, 1, i, 2 * i, 2 * i + 1, i not in (0, 1, 3)) for i in range(5)] + [(1, 2, 0, 20, 21, False)], "source_id long, rep_id long, i long, start long, end long, kept boolean")
    inputs = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 19, 22)], "source_id long, rep_id long, input_start long, input_end long")
    assert sorted(map(tuple, rewriting.repetition_deletions(elements, inputs).collect())) == [(1, 1, 0, 4), (1, 1, 6, 8), (1, 2, 19, 22)]
    slots = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "source_id long, slot_id long, unit_id long")
    ranges = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 4, 6)], "source_id long, slot_id long, start long, end long")
    assert [tuple(r) for r in rewriting.capture_deletions(slots, ranges, spark.createDataFrame([(1, 5)], "source_id long, unit_id long")).collect()] == [(1, 4, 6)]


def test_nesting(spark):
    rows = spark.createDataFrame([(1, 0, 9), (1, 1, 4), (1, 3, 6), (1, 9, 12), (2, 0, 5), (2, 0, 5)], "k long, start long, end long")
    outer, crossing = spans.outermost(rows, "k")
    assert sorted(map(tuple, outer.collect())) == [(1, 0, 9), (1, 9, 12), (2, 0, 5)] and crossing.collect() == []
    assert [tuple(r) for r in spans.crossings(rows, "k").collect()] == [(1, 3, 6)]
    runs = spans.runs(spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True)], "k long, i long, v boolean"), ["k"], "i", F.col("v"))
    assert sorted((r["first"], r["last"], r["value"]) for r in runs.collect()) == [(0, 1, True), (2, 2, False), (3, 3, True)]
    leaves = spark.createDataFrame([(1, 1, 2, 3), (1, 1, 6, 7)], "source_id long, group_id long, start long, end long")
    braces = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 1, 8), (1, 3, 1, 4)], "source_id long, brace_id long, start long, end long")
    assert [tuple(r) for r in spans.least_enclosing(leaves, braces).collect()] == [(1, 1, 2)]


def test_byte_functions(spark):
    frame = spark.createDataFrame([("añ中b",)], "t string")
    cut = lambda a, b: frame.select(X.byte_slice(F.col("t"), F.lit(a), F.lit(b))).first()[0]
    assert [cut(0, 1), cut(1, 3), cut(3, 7), cut(2, 3), cut(0, 99), cut(3, 3)] == ["a", "ñ", "中b", None, None, ""]
    ok = frame.select(*[X.char_boundary(F.col("t"), F.lit(i)).alias(str(i)) for i in range(-1, 9)]).first()
    assert list(ok) == [False, True, True, False, True, False, False, True, True, False]
    keys = spark.createDataFrame([([1, 2], [1, 2, 3]), ([2], [1, 2]), ([], [1])], "p array<long>, k array<long>")
    assert [r[0] for r in keys.select(X.is_key_prefix(F.col("p"), F.col("k"))).collect()] == [True, False, True]


def test_subtree_shapes_and_orders(spark):
    def shapes(rows):
        return {r["node"]: r["shape"] for r in ordinals.subtree_ranks(spark.createDataFrame(rows, "node long, parent long, leaf string"), "leaf").collect()}

    rows = [(1, None, "r"), (2, 1, "a"), (3, 1, "b"), (4, 2, "x"), (5, 3, "x"), (11, None, "r"), (12, 11, "b"), (13, 11, "a"), (14, 12, "x"), (15, 13, "x"), (16, 13, None)]
    got = shapes(rows[:-1])
    assert got[1] == got[11] and got[4] == got[5] and got[2] != got[3]
    assert shapes(rows)[11] != got[1]
    forest = spark.createDataFrame([(1, None, "b"), (2, None, "a"), (3, 1, "z"), (4, 1, "y"), (5, 3, "q")], "node long, parent long, name string")
    assert {r["node"]: r["id"] for r in ordinals.preorder_ids(forest, "name").collect()} == {2: 0, 1: 1, 4: 2, 3: 3, 5: 4}
    ties = ordinals.sibling_ordinals(spark.createDataFrame([(1, "h"), (1, "h"), (1, "i")], "k long, o string"), ["k"], "o")[1]
    assert [tuple(r) for r in ties.collect()] == [(1, "h", 2)]


def test_merges_and_differences(spark):
    rows = spark.createDataFrame([("k", None, "a", 1), ("k", "x", None, 2), ("m", "x", "a", 3), ("m", "y", "a", 4)], "key string, p string, q string, owner long")
    good, bad = groups.merged(rows, ["key"], ["p", "q"], "owner")
    assert [(r["key"], r["p"], r["q"], list(r["owners"])) for r in good.collect()] == [("k", "x", "a", [1, 2])]
    assert [r["key"] for r in bad.collect()] == ["m"]
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string"), spark.createDataFrame([(2, None), (3, "y"), (4, "w")], "k long, v string")
    assert sorted(map(tuple, diffs.map_difference(a, b, ["k"], ["v"]).collect())) == [(1, "missing"), (3, "changed"), (4, "extra")]
    assert diffs.set_difference(a, a.union(a)).collect() == []
    mentioned = spark.createDataFrame([(1, "s"), (1, None), (2, None)], "e long, site string")
    used = spark.createDataFrame([(1, None)], "e long, site string")
    assert sorted(map(tuple, diffs.subsumed(mentioned, used, ["e"]).collect()), key=str) == [(1, "s"), (2, None)]
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "node long, key string")
    edges = spark.createDataFrame([(1, 2, "t", 4), (1, 3, "u", 5)], "src long, dst long, kind string, ordinal long")
    _, kept, twice = diffs.projected(nodes, edges, spark.createDataFrame([(1,), (2,)], "node long"), ["t"])
    assert [tuple(r) for r in kept.collect()] == [("a", "b", "t", 0)] and twice.collect() == []


def test_one_broken_fact_is_one_violation(spark):
    key = lambda *p: list(p)
    nodes = [(0, None, key("c")), (1, 0, key("c", "a")), (2, 1, key("c", "a", "b"))]
    edges = [(0, 1, "parent", 0), (1, 2, "use", 1)]
    run = lambda n, e: sorted(r["check"] for r in checks.definition_graph(spark.createDataFrame(n, "id long, parent_id long, key array<string>"), spark.createDataFrame(e, "src long, dst long, kind string, n_sites long")).collect())
    assert run(nodes, edges) == []
    assert run([*nodes[:2], (2, 1, key("c", "b"))], edges) == ["key extends parent"]
    assert run(nodes, [(0, 1, "parent", 0), (1, 2, "use", 0)]) == ["edge has a site"]
    assert run(nodes, [*edges, (1, 9, "use", 1)]) == ["known end"]
    units = [(1, 1, None, 0, 9, True), (1, 2, 1, 0, 4, False), (1, 3, 2, 1, 2, False)]
    sources = spark.createDataFrame([(1, 9)], "source_id long, byte_len long")
    inventory = lambda u: sorted(r["check"] for r in checks.unit_inventory(spark.createDataFrame(u, "source_id long, unit_id long, parent_id long, start long, end long, active boolean"), sources).collect())
    assert inventory(units) == []
    assert inventory([*units[:2], (1, 3, 2, 1, 5, True)]) == ["child within parent", "inactive below inactive"]
    assert inventory([(1, 1, None, 0, 8, True)]) == ["root covers text"]
    relations = [(1, 0, "a"), (1, 1, "b")]
    implied = lambda r: checks.implied(spark.createDataFrame(r, "id long, ordinal long, target string"), spark.createDataFrame([(1, ["a", "b"])], "id long, targets array<string>"), ["id"]).count()
    assert implied(relations) == 0 and implied(relations[:1]) == 1 and implied([(1, 0, "b"), (1, 1, "a")]) == 2
    pieces = lambda p: [r["check"] for r in checks.partition_of_text(spark.createDataFrame(p, "source_id long, start long, end long"), sources).collect()]
    assert pieces([(1, 0, 4), (1, 4, 9)]) == [] and pieces([(1, 0, 4), (1, 5, 9)]) == ["pieces touch"] and pieces([(1, 0, 4)]) == ["pieces cover text"]


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes("﻿one\r\ntwo\nthrée\r\n".encode())
    (folder / "b.txt").write_bytes(b"plain")
    sources = files.read_sources(spark, str(folder))
    text, moved = files.normalized(sources)
    got = {r["source_id"].rsplit("/")[-1]: r["text"] for r in text.collect()}
    assert got == {"a.txt": "one\ntwo\nthrée\n", "b.txt": "plain"}
    assert sorted(tuple(r)[1:] for r in moved.where("source_id like '%a.txt'").collect()) == [(0, 3, 3, 6), (4, 14, 8, 18)]
    path = str(tmp_path / "table")
    files.write_new(sources.select("source_id", "text"), path)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(sources.select("source_id", "text"), path)
    seen = sources.select("source_id", "digest")
    assert files.replace_unchanged(text.select("source_id", "text"), path, seen)
    assert spark.read.parquet(path).where("text like '%three%' or text like '%thrée%'").count() == 1
    assert not files.replace_unchanged(sources.select("source_id", "text"), path, seen)


def test_growing_reachability(spark, tmp_path):
    data, out = str(tmp_path / "edges"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2), (5, 6)], "src long, dst long").coalesce(1).write.parquet(data)
    roots = spark.createDataFrame([(1,)], "node long")

    def run(path):
        stream = spark.readStream.schema("src long, dst long").parquet(path)
        query = grow_reachable(stream, roots, out) if path == data else None
        if query:
            query.awaitTermination(60)

    run(data)
    assert sorted(r["node"] for r in spark.read.parquet(f"{out}/nodes").distinct().collect()) == [1, 2]
    assert time.time() > 0
