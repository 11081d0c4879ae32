"""Interned sets, lanes, snapshots, modes and replaced tables against plain versions."""

from __future__ import annotations

import random

import pytest

from reachflow.operators import provenance
from reachflow.sources import scratch
from reachflow.sources.files import Versioned


def test_interned_sets_against_nested_tuples(spark):
    rng = random.Random(4)
    local = [(n, rng.randint(0, 2)) for n in range(120) for _ in range(rng.randint(0, 3))]
    parents = [(n, rng.randrange(n)) for n in range(10, 120) for _ in range(rng.randint(0, 2))]
    contents: dict[int, tuple] = {}
    for n in range(120):
        contents[n] = (tuple(sorted({u for m, u in local if m == n})), tuple(sorted({repr(contents[p]) for m, p in parents if m == n})))
    want = {n: min(m for m in contents if contents[m] == contents[n]) for n in contents}
    frames = spark.createDataFrame([(n,) for n in range(120)], "node long"), spark.createDataFrame(local, "node long, unit long"), spark.createDataFrame(parents, "node long, parent long")
    assert {r.node: r.set_id for r in provenance.interned(*frames).collect()} == want
    assert provenance.interned(*(f.limit(0) for f in frames)).collect() == []


def test_lanes_don_t_see_each_other(spark):
    rules = spark.createDataFrame([("a", 1, 2, 3), ("a", 3, 1, 4), ("b", 1, 2, 5), ("b", 5, 5, 6)], "lane string, left_unit long, right_unit long, required long")
    kept = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 9)], "lane string, unit long")
    assert sorted(tuple(r) for r in provenance.conditional_members(kept, rules).collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("c", 9)]


def test_modes_against_all_paths(spark):
    rng, modes = random.Random(8), ["used", "mentioned", "named"]
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(modes)) for _ in range(90)]
    roots = [(0, "used"), (1, "named"), (2, "mentioned"), (0, "named"), (77, "used")]
    found = {(n, modes.index(m)) for n, m in roots}
    while True:
        more = {(d, max(k, modes.index(c))) for n, k in found for s, d, c in edges if s == n} - found
        if not more:
            break
        found |= more
    want = {n: modes[min(k for m, k in found if m == n)] for n, _ in found}
    got = provenance.reachable_modes(spark.createDataFrame(edges, "src long, dst long, cap string"), spark.createDataFrame(roots, "node long, mode string"), modes).collect()
    assert {r.node: r.mode for r in got} == want and len(got) == len(want)


def test_snapshots(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 11), (3, 4, 12), (2, 5, 13), (6, 7, 14)], "src long, dst long, edge_id long")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    sites = spark.createDataFrame([(11, 100), (13, 100), (13, 101), (12, 102)], "edge_id long, site long")
    surviving = spark.createDataFrame([(101,), (102,)], "site long")
    got = provenance.original_snapshot(edges, nodes(1), nodes(3, 9), nodes(2, 3, 4, 5), sites, surviving)
    assert sorted(r.node for r in got.collect()) == [1, 2, 3, 4, 5]  # 3 is permitted itself; site 100 doesn't lead to it
    got = provenance.original_snapshot(edges, nodes(1, 6), nodes(9), nodes(2, 3, 4), sites, surviving)
    assert sorted(r.node for r in got.collect()) == [1, 2, 6]
    assert sorted(r.node for r in provenance.reduced_snapshot(edges, nodes(1), nodes(6), nodes(3, 7)).collect()) == [1, 2, 5, 6]


def test_candidates_pass_all_or_none(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node long")
    children, edges = spark.createDataFrame([(3,), (None,)], "parent long"), spark.createDataFrame([(2, 1)], "src long, dst long")
    passed, rejected = provenance.childless_or_none(nodes, children, edges.limit(0))
    assert sorted(r.node for r in passed.collect()) == [1, 2] and rejected.isEmpty()
    passed, rejected = provenance.childless_or_none(nodes, children, edges)
    assert passed.isEmpty() and [r.node for r in rejected.collect()] == [2]


def test_materialized_groups(spark):
    kept = spark.createDataFrame([("a",), ("b",)], "unit string")
    local = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, "a")], "set_id long, unit string")
    parents = spark.createDataFrame([(2, 1), (4, 3)], "set_id long, parent_set_id long")
    groups = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 4), (9, 3)], "group_id long, set_id long")
    assert [r.group_id for r in provenance.materialized(kept, local, parents, groups).collect()] == [7]


class Broken(Exception):
    pass


def rows(table) -> list[int]:
    return sorted(r.n for r in table.read().collect())


def test_a_replacement_that_breaks_off_leaves_old_or_new(spark, tmp_path, monkeypatch):
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    table = Versioned(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(frame(1, 2), None) and rows(table) == [1, 2]
    first = table.current()
    assert table.replace(frame(2, 1), first) and table.current() == first  # equal rows need no new version
    assert not table.replace(frame(3), None) and rows(table) == [1, 2]

    def breaks(*_):
        raise Broken

    with monkeypatch.context() as m:  # behind the data, before the manifest
        m.setattr(table, "commit", breaks)
        with pytest.raises(Broken):
            table.replace(frame(3), first)
    assert rows(table) == [1, 2] and table.current() == first
    for k in (2, 3, 4):  # manifests that were begun and not written
        table.fs.create(table.at("_manifests", f"{k:012d}"), False).close()
        assert rows(table) == [1, 2]
    with monkeypatch.context() as m:  # behind the manifest
        m.setattr(table, "sweep", breaks)
        with pytest.raises(Broken):
            table.replace(frame(4), first)
    assert rows(table) == [4]
    second = table.current()
    other = Versioned(spark, str(tmp_path / "t"))
    assert other.replace(frame(5), second) and not table.replace(frame(6), second) and rows(table) == [5]
    assert set(table.listed("versions")) == {second, table.current()}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    one, two = Versioned(spark, str(tmp_path / "t")), Versioned(spark, str(tmp_path / "t"))
    assert one.replace(frame(1), None)
    was = one.current()
    seen = two.newest()
    assert one.replace(frame(2), was)
    monkeypatch.setattr(two, "newest", lambda: seen)  # as read before the other's manifest
    assert not two.replace(frame(3), was)
    assert rows(one) == [2]


def test_edges_of_all_modes_are_written_once(spark, monkeypatch):
    made = []
    real = scratch.bucketed
    monkeypatch.setattr(scratch, "bucketed", lambda df, *more: made.append(df) or real(df, *more))
    edges = spark.createDataFrame([(1, 2, "used"), (2, 3, "named"), (1, 3, "mentioned"), (3, 4, "used")], "src long, dst long, cap string")
    got = provenance.reachable_modes(edges, spark.createDataFrame([(1, "used")], "node long, mode string"), ["used", "mentioned", "named"])
    assert {tuple(r) for r in got.collect()} == {(1, "used"), (2, "used"), (3, "mentioned"), (4, "mentioned")}
    assert len(made) == 1


def test_snapshots_look_up_permitted_nodes_in_rounds(spark, monkeypatch):
    """Neither the permitted nodes nor ids that are not there are joined to all edges."""
    taken = []
    real = provenance.reachable
    monkeypatch.setattr(provenance, "reachable", lambda edges, *more, **named: taken.append(edges) or real(edges, *more, **named))
    edges = spark.createDataFrame([(1, 2, None), (2, 3, 11), (2, 6, 12), (3, 4, None), (4, 5, None)], "src long, dst long, edge_id long")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    sites, surviving = spark.createDataFrame([(11, 100), (11, 101), (12, 101), (None, 101)], "edge_id long, site long"), spark.createDataFrame([(100,), (100,)], "site long")
    got = provenance.original_snapshot(edges, nodes(1), nodes(9), nodes(2, 3, 4, 6, 9), sites, surviving)
    assert sorted(r.node for r in got.collect()) == [1, 2, 3, 4, 9]
    assert "leftsemi" not in taken[0]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rules_are_not_held_to_tell_them_apart(spark, monkeypatch):
    plans = []
    real = provenance.written
    monkeypatch.setattr(provenance, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rules = spark.createDataFrame([("a", 1, 2, 3)] * 3 + [("a", 3, 2, 4)], "lane string, left_unit long, right_unit long, required long")
    kept = spark.createDataFrame([("a", 1), ("a", 2)], "lane string, unit long")
    assert sorted(tuple(r) for r in provenance.conditional_members(kept, rules).collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert "Aggregate" not in plans[0]
