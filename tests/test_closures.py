"""Closures, gates and choices against plain models on random graphs; permutations and odd inputs change nothing."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reachflow.operators import choice, closure, gates
from reachflow.operators.components import connected_components
from reachflow.operators.retention import SCHEMAS, Facts, retained


def edges_of(rng: random.Random, n: int, m: int) -> list[tuple[int, int]]:
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def reach(edges, roots) -> set:
    out, todo, after = set(), list(roots), defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += after[x]
    return out


def nodes_in(frame, column: str = "node") -> list:
    return sorted(r[column] for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_and_components(spark, seed):
    rng = random.Random(seed)
    edges = edges_of(rng, 40, 45)
    frame = spark.createDataFrame([*edges, *edges[:5], (None, 1), (2, None)], "src long, dst long")
    roots = spark.createDataFrame([(0,), (0,), (7,), (None,), (99,)], "node long")
    assert nodes_in(closure.reachable(frame, roots)) == sorted(reach(edges, [0, 7, 99]))
    assert nodes_in(closure.reachable(frame.orderBy(F.rand(seed)), roots)) == sorted(reach(edges, [0, 7, 99]))
    pairs = {(r["start"], r["node"]) for r in closure.reachable_pairs(frame, roots).collect()}
    assert pairs == {(s, x) for s in (0, 7, 99) for x in reach(edges, [s])}
    both = edges + [(b, a) for a, b in edges]
    found = {r["node"]: r["component"] for r in connected_components(frame, "src", "dst").collect()}
    assert found == {x: min(reach(both, [x])) for x in {y for e in edges for y in e}}
    strong = {r["node"]: r["component"] for r in closure.strong_components(frame.where("src is not null and dst is not null"), spark.range(40).withColumnRenamed("id", "node")).collect()}
    ahead = {x: reach(edges, [x]) for x in range(40)}
    assert strong == {x: min(y for y in ahead[x] if x in ahead[y]) for x in range(40)}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    nodes = spark.createDataFrame([], "node long")
    assert closure.reachable(none, nodes).collect() == []
    assert connected_components(none, "src", "dst").collect() == []
    assert closure.strong_components(none, nodes).collect() == []
    forest = spark.createDataFrame([], "node long, parent long, hit boolean")
    assert closure.nearest_ancestor(forest, F.col("hit")).collect() == []
    assert closure.flag_closure(forest, F.col("hit")).collect() == []


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    keep = closure.written
    monkeypatch.setattr(closure, "written", lambda df, *a: (rounds.append(1), keep(df, *a))[1])
    forest = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1024)], "node long, parent long")
    assert sorted((r["node"], r["depth"]) for r in closure.depths(forest).collect()) == [(i, i) for i in range(1024)]
    assert len(rounds) <= 13


@pytest.mark.parametrize("seed", [3, 4])
def test_forests(spark, seed):
    rng = random.Random(seed)
    parent = {i: (rng.randrange(i) if i and rng.random() < 0.9 else None) for i in range(60)}
    parent |= {60: 61, 61: 62, 62: 60, 63: 61, 64: 64}  # cycles, and a node below one
    hit = {i for i in parent if rng.random() < 0.2} - {60, 61, 62, 63, 64}
    frame = spark.createDataFrame([(i, p, i in hit, None) for i, p in parent.items()], "node long, parent long, hit boolean, ancestor string")

    def above(i):
        seen, x, n = {i}, parent[i], 1
        while x is not None and x not in seen:
            yield x, n
            seen.add(x)
            x, n = parent[x], n + 1

    wanted = {i: next(((x, n) for x, n in above(i) if x in hit), (None, None)) for i in parent}
    got = {r["node"]: (r["ancestor"], r["distance"]) for r in closure.nearest_ancestor(frame, F.col("hit")).collect()}
    assert got == wanted
    deep = {r["node"]: r["depth"] for r in closure.depths(frame).collect()}
    assert deep == {i: None if i >= 60 else len(list(above(i))) for i in parent}
    assert nodes_in(closure.cyclic_nodes(frame)) == [60, 61, 62, 63, 64]
    flags = {r["node"]: (r["below"], r["above"]) for r in closure.flag_closure(frame, F.col("hit")).collect()}
    for i in parent:
        assert flags[i][0] == (i in hit or wanted[i][0] is not None)
        assert flags[i][1] == (i in hit or any(i in [x for x, _ in above(j)] for j in hit))


def test_greatest_fixed_point_keeps_free_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    parents = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2), (3, 4), (5, None)], "node long, parent long")
    dead = spark.createDataFrame([(4,)], "node long")
    assert nodes_in(closure.survivors(nodes, dead, parents)) == [0, 1, 5]


def test_levels_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (6, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    assert {r["node"]: r["level"] for r in closure.levels(edges, nodes).collect()} == {3: 0, 2: 1, 1: 2, 4: None, 5: None, 6: None}
    named = spark.createDataFrame([(0, 1, 5), (0, 2, 3), (2, 1, 9), (1, 3, 1), (3, 0, 1)], "src long, dst long, label long")
    found = {r["node"]: list(r["path"]) for r in closure.least_paths(named, spark.createDataFrame([(0,)], "node long")).collect()}
    assert found == {0: [], 2: [3], 1: [3, 9], 3: [3, 9, 1]}
    merged = closure.atomic_groups(spark.createDataFrame([(5, 1), (3, 1), (3, 2), (4, 2), (9, 7)], "group_id long, anchor long"))
    assert {r["group_id"]: r["merged_id"] for r in merged.collect()} == {3: 3, 4: 3, 5: 3, 9: 9}


@pytest.mark.parametrize("seed", [5, 6])
def test_rules(spark, seed):
    rng = random.Random(seed)
    n = 30
    single = [(rng.randrange(n), rng.randrange(n)) for _ in range(12)]
    double = [(rng.randrange(n), rng.randrange(n), rng.randrange(n)) for _ in range(15)]
    group = [(u, rng.randrange(12)) for u in range(n)]
    kept = {1, 2, 3}
    want = set(kept)
    while True:
        new = {r for t, r in single if t in want} | {r for a, b, r in double if a in want and b in want} | {u for u, g in group if any(v in want and h == g for v, h in group)}
        if new <= want:
            break
        want |= new
    got = gates.required(spark.createDataFrame([(u,) for u in kept], "unit long"), spark.createDataFrame(single, "trigger long, required long"), spark.createDataFrame(double, "left_unit long, right_unit long, required long"), spark.createDataFrame(group, "unit long, group_id long"))
    assert nodes_in(got, "unit") == sorted(want)
    body = [(r, rng.randrange(n), rng.choice(["all", "any"])) for r in range(40) for _ in range(rng.randint(1, 3))]
    heads = [(r, rng.randrange(n)) for r in range(42)]  # the last two have no body
    want = {1, 2, 3}
    while True:
        new = set()
        for r, h in heads:
            every = [f for q, f, k in body if q == r and k == "all"]
            some = [f for q, f, k in body if q == r and k == "any"]
            if set(every) <= want and (not some or set(some) & want):
                new.add(h)
        if new <= want:
            break
        want |= new
    got = gates.fired(spark.createDataFrame([(1,), (2,), (3,)], "fact long"), spark.createDataFrame(heads, "rule long, head long"), spark.createDataFrame(body, "rule long, fact long, kind string"))
    assert nodes_in(got, "fact") == sorted(want)


def test_gated_edges_and_partial_sites(spark):
    edges = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4)], "edge long, src long, dst long")
    sites = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (1, "b", 12), (2, "a", 10), (2, "a", 99), (4, "a", 10)], "edge long, site string, owner long")
    kept = spark.createDataFrame([(10,), (12,)], "owner long")
    roots = spark.createDataFrame([(0,)], "node long")
    found = gates.gated_reachable(edges, sites, kept, roots)
    assert nodes_in(found) == [0, 1, 3]
    assert [tuple(r) for r in gates.partial_sites(edges, sites, kept, found).collect()] == [(2, "a")]
    assert nodes_in(gates.gated_reachable(edges, sites, kept, roots, spark.createDataFrame([(1,)], "node long"))) == [0]
    sets = gates.complete_sets(spark.createDataFrame([(1,), (2,)], "unit long"), spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "set_id long, unit long"), spark.createDataFrame([(13, 10), (13, 11), (14, 12), (15, 13)], "set_id long, parent_set_id long"))
    assert nodes_in(sets, "set_id") == [10, 11, 13, 15]


def plain_choices(disjunctions, choices, kept):
    kept, out, number = set(kept), [], 0
    best = {d: min((rank, item) for e, item, rank in choices if e == d)[1] for d, _ in disjunctions}
    while True:
        made = []
        for d, trigger in sorted(disjunctions):
            if (trigger is None or trigger in kept) and not any(item in kept for e, item, _ in choices if e == d):
                kept.add(best[d])
                made.append((number, d, best[d]))
        if not made:
            return out
        out += made
        number += 1


@pytest.mark.parametrize("seed", range(7, 12))
def test_choices_equal_the_ordered_scan(spark, seed):
    rng = random.Random(seed)
    disjunctions = [(d, rng.choice([None, rng.randrange(12)])) for d in range(15)]
    choices = [(d, item, rng.randrange(3)) for d, _ in disjunctions for item in rng.sample(range(12), rng.randint(1, 4))]
    kept = rng.sample(range(12), 1)
    got = choice.chosen(spark.createDataFrame(disjunctions, "disj long, trigger long"), spark.createDataFrame(choices, "disj long, item long, cost long"), ["cost"], spark.createDataFrame([(k,) for k in kept], "item long"))
    assert sorted(map(tuple, got.collect())) == plain_choices(disjunctions, choices, kept)


def frames(spark, **rows):
    return {name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in rows.items()}


def test_retention_of_two_lanes(spark):
    facts = Facts.of(spark, ["cost"], **frames(
        spark,
        roots=[(1,)],
        edges=[(1, 1, 2), (2, 2, 3), (3, 6, 7), (4, 1, 8)],
        sites=[(2, "s", 102)],
        binding=[(1, 101), (2, 102), (3, 103), (5, 105), (6, 106)],
        delegated=[(8,)],
        single=[(101, 105)],
        groups=[(101, 1), (102, 2), (103, 3), (105, 5), (106, 6)],
        disjunctions=[(0, 105), (1, 999)],
        choices=[(0, 106, 1), (0, 107, 2), (1, 108, 1)],
    ))
    kept = retained(facts)
    assert nodes_in(kept.units, "unit") == [101, 102, 103, 105, 106]
    assert sorted(map(tuple, kept.picks.collect())) == [("unit", 106)]
    assert nodes_in(kept.demanded) == [1, 2, 3]
    assert nodes_in(kept.present) == [1, 2, 3, 5, 6, 7]


def test_retention_of_macro_groups_and_members(spark):
    base = dict(
        roots=[(1,)],
        binding=[(1, 101)],
        selected=[(20, 120)],
        edges=[(1, 1, 20), (2, 1, 30), (3, 1, 40)],
        gates=[(20, 101), (30, 999)],
        parents=[(40, 30)],
        groups=[(101, 1), (120, 2), (130, 3), (131, 4), (140, 5), (141, 6)],
        members2=[(1, 20, 50)],
        classes=[(20, 7), (60, 7)],
        set_units=[(1, 130), (2, 131), (3, 140)],
        set_parents=[(1, 2)],
        triggers=[(20, 1), (99, 2)],
        mgroup_roots=[(1, 1), (2, 3)],
        mgroup_products=[(1, 70), (2, 71)],
        mgroup_owners=[(1, 1, 72), (1, 99, 73)],
        carrier_disjunctions=[(0, None)],
        carrier_choices=[(0, "unit", 141, 2), (0, "node", 80, 1)],
        member_disjunctions=[(0, 20), (1, 70)],
        member_choices=[(0, 90, 1), (1, 91, 1)],
    )
    kept = retained(Facts.of(spark, ["cost"], **frames(spark, **base)))
    # 30 is shut by a unit that isn't kept, 40 by its parent; group 1 is asked for by 20 and complete with its parent set.
    assert nodes_in(kept.units, "unit") == [101, 120, 130, 131]
    assert nodes_in(kept.demanded) == [1, 20, 50, 60, 90]
    assert nodes_in(kept.present) == [1, 20, 50, 60, 70, 72, 80, 90, 91]
    assert sorted(map(tuple, kept.picks.collect())) == [("carrier", 161), ("demanded", 90), ("present", 91)]
    opaque = retained(Facts.of(spark, ["cost"], **frames(spark, **base, opaque=[(20,)])))
    assert nodes_in(opaque.units, "unit") == [101, 120, 130, 131, 140, 141]


def least_by_rounds(edges, roots):
    best, moved = {r: () for r in roots}, True
    while moved:
        moved = False
        for a, b, label in edges:
            if a in best and (b not in best or (*best[a], label) < best[b]):
                best[b], moved = (*best[a], label), True
    return best


@pytest.mark.parametrize("task_edges", [500_000, 30, 0])
def test_least_paths_by_tasks_and_rounds(spark, task_edges):
    """Equal labels, several roots, some of them below others, and parts of the graph that no root reaches."""
    rng = random.Random(11)
    edges = [(c * 100 + rng.randrange(16), c * 100 + rng.randrange(16), rng.randrange(3)) for c in range(5) for _ in range(8 + 9 * c)]
    roots = [0, 100, 103, 200, 301, 305, 999]
    got = closure.least_paths(spark.createDataFrame(edges, "src long, dst long, label long"), spark.createDataFrame([(r,) for r in roots], "node long"), task_edges)
    assert {r["node"]: tuple(r["path"]) for r in got.collect()} == least_by_rounds(edges, roots)


def test_long_least_paths_need_few_rounds(spark):
    n = 3000
    steps = spark.range(n).selectExpr("id AS src", "id + 1 AS dst", "1 AS label").union(spark.range(n).selectExpr("0", "id + 1", "id + 2"))
    found = closure.least_paths(steps, spark.createDataFrame([(0,)], "node long"))
    assert found.where("size(path) = node").count() == n + 1


@pytest.mark.parametrize("set_links", [5_000_000, 0])
def test_contributor_totals(spark, set_links):
    """Sums of closed blocks are those of the pairs; cycles, sets without links, and negative weights count."""
    rng = random.Random(7)
    parents = [(s, rng.randrange(s)) for s in range(1, 60) for _ in range(2)] + [(100, 101), (101, 102), (102, 100), (102, 5), (103, 100)]
    local = [(rng.choice([*range(60), 100, 101, 103, 200]), rng.randrange(300)) for _ in range(900)]
    weights = {u: rng.randrange(-5, 40) for u in range(290)}
    above, moved = {s: {s} for s in {x for p in parents for x in p} | {200}}, True
    while moved:
        moved = False
        for s, p in parents:
            if not above[p] <= above[s]:
                above[s] |= above[p]
                moved = True
    wanted = {}
    for s, of in above.items():
        units = {u for k, u in local if k in of and u in weights}
        if units:
            wanted[s] = (len(units), sum(weights[u] for u in units))
    tables = [spark.createDataFrame(x, c) for x, c in ((local, "set_id long, unit_id long"), (parents, "set_id long, parent_set_id long"), (list(weights.items()), "unit_id long, weight long"))]
    assert {r["set_id"]: (r["n"], r["total"]) for r in closure.contributor_totals(*tables, set_links, 70).collect()} == wanted


def test_components_shuffle_no_table_to_write_it(spark, monkeypatch):
    hints = []
    real = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda self, name, *more: hints.append(name) or real(self, name, *more))
    found = connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 7), (9, 8)], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)}
    assert "rebalance" not in hints


def test_rounds_of_levels_shuffle_what_they_take_off_alone(spark, monkeypatch):
    plans = []
    real = closure.bucketed
    monkeypatch.setattr(closure, "bucketed", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *more))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 2), (3, 0), (4, 9), (5, 5)], "src long, dst long")
        nodes = spark.createDataFrame([(n,) for n in range(7)], "node long")
        assert {tuple(r) for r in closure.levels(edges, nodes).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, None), (6, 0)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(plans) == 3 + 4 and all("hashpartitioning(node" not in p for p in plans[3:])
