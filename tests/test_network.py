"""The network of rules, and retention on it against a plain fixed point of the rules over random facts."""

from __future__ import annotations

import random

import pytest

from reachflow.operators import retention
from reachflow.operators.network import Network
from reachflow.operators.retention import SCHEMAS, Facts, retained


def facts_of(network):
    return {r[0] for r in network.every().collect() if not r[0].startswith("#")}


@pytest.mark.parametrize("split", [1, 65_536])
def test_network_counts_each_fact_once(spark, split):
    arcs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "d"), (None, "x"), ("x", None), ("g", "a")], "fact string, head string")
    gates = spark.createDataFrame([("1", "g", "b"), ("1", "g", "b"), ("1", "g", "late"), ("2", "never", "b"), ("2", "never", None)], "gate string, head string, fact string")
    network = Network(arcs, gates, split=split)
    network.add(spark.createDataFrame([("a",), (None,)], "fact string"))
    assert facts_of(network) == {"a", "b", "c", "d"}
    network.add(spark.createDataFrame([("late",), ("a",)], "fact string"))
    assert facts_of(network) == {"a", "b", "c", "d", "late", "g"}
    assert len(network.every().collect()) == network.every().distinct().count()


def plain(f):
    """(present, demanded, units) by trying all rules over and over."""
    P, D, K, meant, asks, asked, led = set(), {n for n, in f["roots"]}, set(), set(), set(), set(), set()
    known = {p for _, p, _ in f["producers"]} | {x for row in f["meanings"] for x in row}
    sets = {s for s, _ in f["set_units"]} | {x for row in f["set_parents"] for x in row}
    wanted: set = set()
    while True:
        before = [len(x) for x in (P, D, K, meant, asks, asked, led, wanted)]
        P |= D
        K |= {u for n, u in f["binding"] + f["selected"] if n in P}
        P |= {n for n, u in f["binding"] if u in K}
        gone = {g for u, g in f["groups"] if u in K}
        K |= {u for u, g in f["groups"] if g in gone or any(n in P for n, in f["opaque"])}
        K |= {r for t, r in f["single"] if t in K} | {r for a, b, r in f["double"] if a in K and b in K}
        dead = {n for n, u in f["gates"] if u not in K}
        while more := {n for n, p in f["parents"] if p in dead} - dead:
            dead |= more
        sites: dict = {}
        for e, s, o in f["sites"]:
            sites.setdefault(e, {}).setdefault(s, []).append(o in K)
        for lane in (P, D):
            lane |= {d for e, s, d in f["edges"] if s in lane and (d,) not in f["delegated"] and d not in dead and (e not in sites or any(map(all, sites[e].values())))}
            lane |= {r for t, r in f["members"] if t in lane} | {r for a, b, r in f["members2"] if a in lane and b in lane}
        classes = {c for n, c in f["classes"] if n in D}
        D |= {n for n, c in f["classes"] if c in classes}
        triggered = {g for n, g in f["triggers"] if n in P and (n not in known or n in meant)}
        asked |= triggered
        led |= triggered | {g for g, c in f["mgroup_children"] if c in meant}
        wanted |= {s for g, s in f["mgroup_roots"] if g in asked} | {p for s, p in f["set_parents"] if s in wanted}
        K |= {u for s, u in f["set_units"] if s in wanted}
        lacking, size = {s for s, u in f["set_units"] if u not in K}, -1
        while size < len(lacking):
            size = len(lacking)
            lacking |= {s for s, p in f["set_parents"] if p in lacking}
        roots = {g: {s for h, s in f["mgroup_roots"] if h == g} for g, _ in f["mgroup_roots"]}
        made = {g for g, r in roots.items() if r <= sets - lacking}
        P |= {n for g, n in f["mgroup_products"] if g in made} | {m for g, o, m in f["mgroup_owners"] if g in made and o in P}
        meant |= {p for g, p, own in f["producers"] if g in made and (own or g in led)} | {p for p, c in f["meanings"] if c in meant}
        for c, producer, g, opaque in f["clauses"]:
            needs = {x for k, x in f["clause_required"] if k == c}
            if any(n in D for k, n in f["clause_carriers"] if k == c) and (needs or opaque or any(x in asks for k, x in f["clause_children"] if k == c)):
                asks |= needs | {producer} - {None}
                asked |= {g} - {None}
        asks |= {p for n, p in f["demand_triggers"] if n in D}
        D |= asks
        if before == [len(x) for x in (P, D, K, meant, asks, asked, led, wanted)]:
            return P, D, K


def drawn(seed):
    """Random facts; sets and their parents form no cycle, all else may."""
    rng = random.Random(seed)
    node, unit, few = (lambda: rng.randrange(40)), (lambda: rng.randrange(100, 130)), (lambda: rng.randrange(6))

    def rows(n, *makers):
        return list({tuple(m() for m in makers) for _ in range(n)})

    f = {name: [] for name in SCHEMAS}
    f["roots"] = rows(2, node)
    f["edges"] = [(e, node(), node()) for e in range(25)]
    f["sites"] = rows(12, lambda: rng.randrange(25), lambda: rng.choice("ab"), unit)
    f |= {"binding": rows(12, node, unit), "selected": rows(5, node, unit), "delegated": rows(2, node), "opaque": rows(1, node) if seed % 3 == 0 else []}
    f |= {"single": rows(6, unit, unit), "double": rows(6, unit, unit, unit), "groups": rows(8, unit, few), "members": rows(3, node, node), "members2": rows(6, node, node, node)}
    f |= {"parents": rows(6, node, node), "gates": rows(5, node, unit), "classes": rows(6, node, few)}
    f["set_units"] = rows(8, few, unit)
    f["set_parents"] = [(a, b) for a, b in rows(6, lambda: rng.randrange(8), lambda: rng.randrange(8)) if a > b]
    f |= {"triggers": rows(8, node, few), "mgroup_roots": rows(8, few, lambda: rng.randrange(8)), "mgroup_products": rows(6, few, node), "mgroup_owners": rows(6, few, node, node)}
    f["producers"] = [(g, node(), rng.random() < 0.4) for g in range(6)]
    f |= {"meanings": rows(4, node, node), "mgroup_children": rows(4, few, node), "demand_triggers": rows(4, node, node)}
    f["clauses"] = [(c, *rng.choice([(node(), None), (None, few())]), rng.random() < 0.3) for c in range(6)]
    f |= {"clause_carriers": rows(10, few, node), "clause_required": rows(3, few, node), "clause_children": rows(6, few, node)}
    return f


@pytest.mark.parametrize("seed", range(4))
def test_retention_equals_the_plain_rules(spark, seed):
    f = drawn(seed)
    kept = retained(Facts.of(spark, ["cost"], **{k: spark.createDataFrame(v, SCHEMAS[k]).coalesce(1) for k, v in f.items() if v}))
    got = [{r[0] for r in x.collect()} for x in (kept.present, kept.demanded, kept.units)]
    assert got == list(plain(f))
    assert kept.picks.count() == 0


def test_clauses_and_meaning(spark):
    # Group 1 is complete by its unit; its producer 20 means something by itself, and so does 21 above it, which triggers group 2.
    # The clause of group 3 fires by its child 30, which node 1 demands as a producer; clause 2 lacks such a child.
    f = dict(
        roots=[(1,)], binding=[(1, 101)], set_units=[(1, 101), (2, 102), (3, 103), (4, 104)], mgroup_roots=[(1, 1), (2, 2), (3, 3), (4, 4)],
        producers=[(1, 20, True), (2, 22, False), (4, 24, False)], meanings=[(21, 20)], edges=[(1, 1, 21)], triggers=[(21, 2), (24, 4)],
        demand_triggers=[(1, 30)], clauses=[(1, None, 3, False), (2, 40, None, False)], clause_carriers=[(1, 1), (2, 1)], clause_children=[(1, 30), (2, 21)],
    )
    kept = retained(Facts.of(spark, ["cost"], **{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in f.items()}))
    assert sorted(r[0] for r in kept.units.collect()) == [101, 102, 103]
    assert sorted(r[0] for r in kept.demanded.collect()) == [1, 21, 30]


def test_edges_from_nodes_that_no_rule_makes_present_make_no_arcs(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 5, 2), (3, 2, 3), (4, 7, 1), (5, 8, 9)], "edge long, src long, dst long")
    facts = Facts.of(spark, ["cost"], roots=spark.createDataFrame([(1,)], "node long"), edges=edges, member_choices=spark.createDataFrame([(1, 8, 1)], "disj long, item long, cost long"))
    sources = {r.fact for r in retention._rules(facts)[0].where("head like 'P%'").collect()}
    assert sources == {"P1", "P2", "P8"}
