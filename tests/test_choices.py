"""Ordered choices against the plain scan: in rounds, by components and in one task."""

from __future__ import annotations

import random

import pytest
from reachflow.operators import choice


def plain(asks, choices, picks, kept):
    """disj, item that the scan in order picks."""
    items, held, out = {}, set(kept), []
    for disj, item in choices:
        items.setdefault(disj, set()).add(item)
    for disj, trigger in sorted(asks, key=lambda a: a[0]):
        if disj in picks and not items.get(disj, set()) & held and (trigger is None or trigger in held):
            held.add(picks[disj])
            out.append((disj, picks[disj]))
    return out


def run(spark, asks, choices, picks, kept, scan_rows):
    tables = (
        spark.createDataFrame(asks, "disj long, trigger long"), spark.createDataFrame(choices, "disj long, item long"),
        spark.createDataFrame(list(picks.items()), "disj long, item long"), spark.createDataFrame([(k,) for k in kept], "item long"),
    )
    return sorted(map(tuple, choice.wave(*tables, scan_rows=scan_rows).collect()))


@pytest.mark.parametrize("scan_rows", [0, 12, 1_000_000])
def test_wave_is_the_scan_in_order(spark, scan_rows):
    rng = random.Random(scan_rows)
    asks, choices, picks = [], [], {}
    for disj in range(160):
        # Twenty families of items, so that small components stand beside one that all odd indexes share.
        base = 1000 if disj % 2 else 10 * (disj % 40)
        mine = {base + rng.randrange(40 if disj % 2 else 5) for _ in range(rng.randrange(1, 4))}
        asks.append((disj, rng.choice([None, base + rng.randrange(5)])))
        choices += [(disj, i) for i in mine] * rng.randrange(1, 3)
        picks[disj] = min(mine)
    kept = [1003, 21, 777]
    expected = plain(asks, choices, picks, kept)
    assert len(expected) > 20
    assert run(spark, asks, choices, picks, kept, scan_rows) == expected


def test_long_chain(spark):
    # Each one's first choice is what the one before it may pick: every second one picks.
    choices = [(d, d) for d in range(1024)] + [(d, d - 1) for d in range(1, 1024)]
    got = run(spark, [(d, None) for d in range(1024)], choices, {d: d for d in range(1024)}, [], choice.SCAN_ROWS)
    assert got == [(d, d) for d in range(0, 1024, 2)]


def test_many_chains_go_by_components(spark):
    choices = [(100 * c + d, 100 * c + d - k) for c in range(30) for d in range(24) for k in (0, 1) if d >= k]
    nodes = sorted({d for d, _ in choices})
    got = run(spark, [(d, None) for d in nodes], choices, {d: d for d in nodes}, [], 60)
    assert got == [(d, d) for d in nodes if d % 100 % 2 == 0]


def test_nothing_to_choose(spark):
    assert run(spark, [], [], {}, [], 10) == []
    assert run(spark, [(1, None)], [(1, 5)], {1: 5}, [5], 10) == []
    assert run(spark, [(1, 5), (2, None)], [(1, 7), (2, 5)], {1: 7, 2: 5}, [], 10) == [(2, 5)]  # its trigger comes too late


def test_shared_lists_are_choices(spark):
    """Lists that disjunctions share give the picks of all pairs, and have no row for each pair."""
    rng = random.Random(3)
    asks = [(d, rng.choice([None, rng.randrange(12)])) for d in range(300)]
    own = [(d, rng.choice(["unit", "node"]), rng.randrange(12), rng.randrange(40)) for d in range(300) if d % 3]
    offers = [(k, rng.choice(["unit", "node"]), rng.randrange(60), rng.randrange(40)) for k in range(12) for _ in range(25)]
    members = [(d, rng.randrange(12)) for d in range(300) if d % 5]
    every = own + [(d, kind, item, cost) for d, k in members for of, kind, item, cost in offers if of == k]
    asks, own, every = spark.createDataFrame(asks, "disj long, trigger long"), spark.createDataFrame(own, "disj long, domain string, item long, cost long"), spark.createDataFrame(every, "disj long, domain string, item long, cost long")
    members, offers = spark.createDataFrame(members, "disj long, list long"), spark.createDataFrame(offers, "list long, domain string, item long, cost long")
    for units in ([], [(3,), (7,)]):
        there = spark.createDataFrame(units, "unit long"), spark.createDataFrame([(5,)], "node long")
        got = sorted(map(tuple, choice.mixed(asks, own, ["cost"], *there, (members, offers)).collect()))
        assert got and got == sorted(map(tuple, choice.mixed(asks, every, ["cost"], *there).collect()))


def test_lists_are_not_spread(spark):
    none = spark.createDataFrame([], "disj long, item long, cost long")
    members, offers = spark.range(20_000).selectExpr("id AS disj", "id % 2 AS list"), spark.range(20_000).selectExpr("id % 2 AS list", "id AS item", "id AS cost")
    picks = choice.shared_cheapest(none, members, offers, ["cost"])
    links = choice.shared_links(none, members, offers, picks, spark.createDataFrame([(19_998,)], "item long"))
    assert sorted(map(tuple, links.groupBy("item").count().collect())) == [(1, 10_000), (19_998, 10_000)]
