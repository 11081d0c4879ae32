"""Strong components, their facts, and ordinals against an earlier run, on small graphs."""

from __future__ import annotations

import random
import time

import pytest
from reachflow.operators import choice, closure, ordinals


def plain_components(edges, nodes):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    every = set(nodes) | {n for e in edges for n in e}
    reached = {n: reach(n) for n in every}
    return {n: min(m for m in reached[n] if n in reached[m]) for n in every}


@pytest.mark.parametrize("task_edges", [8, 500_000])
def test_strong_components_against_plain_reachability(spark, task_edges):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    edges += [(100 * k + i, 100 * k + (i + 1) % 3) for k in range(1, 9) for i in range(3)] + [(1000, 1001), (1001, 1002), (5, 5)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(7,), (7,), (5000,), (None,)], "node long")
    got = dict(map(tuple, closure.strong_components(frame, nodes, task_edges).collect()))
    assert got == plain_components(edges, [7, 5000])


def test_long_cycle(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    began = time.time()
    found = closure.strong_components(edges, edges.selectExpr("src as node"))
    assert found.where("component = 0").count() == n
    assert time.time() - began < 120


def test_component_facts(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 3), (3, 3), (4, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in range(1, 6)], "node long")
    gates = spark.createDataFrame([(1, 70), (2, 70), (2, 71), (5, 72), (9, 73)], "node long, unit long")
    units, parents = closure.component_facts(closure.strong_components(edges, nodes), edges, gates)
    assert sorted(map(tuple, units.collect())) == [(1, 70), (1, 71), (5, 72)]
    assert sorted(map(tuple, parents.collect())) == [(1, 3), (4, 1)]
    none = closure.strong_components(edges.limit(0), nodes.limit(0))
    assert none.collect() == [] and closure.component_facts(none, edges.limit(0), gates)[1].collect() == []


SHAPE = "node long, parent long, kind string, basis string, raw long"


def test_ordinals_against_an_earlier_run(spark):
    rows = [(1, None, "m", None, 0), (2, 1, "f", "a", 5), (3, 1, "f", "b", 7), (4, 1, "f", "b", 9), (5, 1, "g", "a", 1), (6, 4, "f", "a", 3), (7, 6, "f", "a", 3), (8, 7, "f", "a", 0)]
    first, wrong = ordinals.structural_ordinals(spark.createDataFrame(rows, SHAPE), ["kind"], ["basis"], "raw")
    assert wrong.collect() == []
    assert {r["node"]: r["ordinal"] for r in first.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0}
    # 2, a cohort by itself, goes; numbers change; 90 is new.
    later = [(n + 10, p + 10 if p else None, k, b, r * 2) for n, p, k, b, r in rows if n != 2] + [(90, 11, "f", "c", 1)]
    placed, wrong = ordinals.structural_ordinals(spark.createDataFrame(later, SHAPE), ["kind"], ["basis"], "raw", first.select("identity", "ordinal"))
    assert {r["node"]: r["ordinal"] for r in placed.collect()} == {11: 0, 13: 1, 14: 2, 15: 0, 16: 0, 17: 0, 18: 0, 90: None}
    assert [tuple(r) for r in wrong.collect()] == [(90, "absent")]


def test_ordinals_with_faults(spark):
    rows = [(1, None, "m", "a", 0), (2, 1, "f", "a", 4), (3, 1, "f", "a", 4), (4, 1, "f", "b", 4), (5, 6, "f", "a", 0), (6, 5, "f", "a", 0), (7, 99, "f", "a", 0), (8, 7, "f", "a", 0)]
    placed, wrong = ordinals.structural_ordinals(spark.createDataFrame(rows, SHAPE), ["kind"], ["basis"], "raw")
    assert {r["node"] for r in placed.collect()} == {1, 2, 3, 4}
    assert sorted(map(tuple, wrong.collect())) == [(2, "cohort"), (2, "siblings"), (3, "cohort"), (3, "siblings"), (4, "siblings"), *((n, "ancestors") for n in (5, 6, 7, 8))]
    told = spark.createDataFrame([(r["identity"], 0) for r in placed.collect()], "identity string, ordinal long")
    again = ordinals.structural_ordinals(spark.createDataFrame(rows[:4], SHAPE), ["kind"], ["basis"], "raw", told)[1]
    assert sorted(r["node"] for r in again.where("reason = 'siblings'").collect()) == [2, 3, 4]


def test_mixed_carriers(spark):
    asks = spark.createDataFrame([(0, None), (1, 5), (2, 6), (3, None)], "disj long, trigger long")
    choices = spark.createDataFrame([(0, "unit", 5, 1), (0, "node", 6, 1), (1, "unit", 8, 1), (2, "node", 9, 2), (2, "unit", 9, 3), (3, "unit", 5, 0)], "disj long, domain string, item long, cost long")
    units, nodes = spark.createDataFrame([], "unit long"), spark.createDataFrame([(6,)], "node long")
    # Node 6 serves 0 and wakes 2; unit 5, which 3 picks, is not the node 5 that 1 waits for.
    assert sorted(map(tuple, choice.mixed(asks, choices, ["cost"], units, nodes).collect())) == [(2, "node", 9), (3, "unit", 5)]


def test_identities_deal_rows_once(spark):
    """Leaves never enter the doubling of paths, and the rows that a parent's identity comes to are not shuffled for it."""
    rows = [(1, None, "m", "a", 0), (2, None, "m", "b", 1), *((10 + i, 1 + i % 2, "o", str(i % 3), i) for i in range(20)), *((100 + i, 10 + i % 20, "l", None, i) for i in range(200))]
    rows += [(1000 + i, 999 + i if i else None, "c", "a", 0) for i in range(40)] + [(5000, 4999, "x", "a", 0), (5001, 5000, "x", "a", 0)]
    frame = spark.createDataFrame(rows, SHAPE)
    found = ordinals.identities(frame, ["kind"], ["basis"], "raw")
    got = {r["node"]: r for r in found.collect()}
    assert len(got) == len(rows) and all((r["identity"] is None) == (n in (5000, 5001)) for n, r in got.items())
    assert len({r["identity"] for r in got.values() if r["identity"]}) == len(rows) - 2
    assert all(got[n]["up"] == (got[p]["identity"] if p else "") for n, p, *_ in rows if n < 5000)
    # A chain doubles its paths, two nodes of it do not: the identities are the same.
    again = ordinals.identities(frame.where("node in (1000, 1001)"), ["kind"], ["basis"], "raw")
    assert {r["node"]: r["identity"] for r in again.collect()} == {n: got[n]["identity"] for n in (1000, 1001)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange" not in ordinals.identities(frame, ["kind"], ["basis"], "raw")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
