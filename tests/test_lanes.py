"""Lanes of choices, symmetric requirements, unions of sets and lists within lists, on small tables."""

from __future__ import annotations

from reachflow.operators import choice, closure, gates, rewriting
from reachflow.operators.retention import SCHEMAS, Facts, retained


def test_lanes_do_not_see_each_other(spark):
    # 0 is asked for in the present lane alone; 1, which the demanded lane asks for, too, picks a choice of 0 behind it.
    known = dict(
        roots=[(1,)], edges=[(1, 1, 20)], binding=[(20, 120), (70, 120)],
        member_disjunctions=[(0, 70), (1, 20)], member_choices=[(0, 95, 1), (0, 96, 2), (1, 96, 1)],
    )
    kept = retained(Facts.of(spark, ["cost"], **{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in known.items()}))
    assert sorted(r[0] for r in kept.demanded.collect()) == [1, 20, 96]
    assert sorted(r[0] for r in kept.present.collect()) == [1, 20, 70, 95, 96]
    assert sorted(map(tuple, kept.picks.collect())) == [("demanded", 96), ("present", 95)]
    asks = spark.createDataFrame([(0, None)], "disj long, trigger long")
    items = spark.createDataFrame([(0, 5)], "disj long, item long")
    some, none = spark.createDataFrame([(5,)], "node long"), spark.createDataFrame([], "node long")
    assert [tuple(r) for r in choice.lanes(asks, items, items, some, none).collect()] == [("demanded", 0, 5)]


def test_derive_requirements(spark):
    influences = spark.createDataFrame([(1, 2), (1, 2), (None, 3)], "trigger long, required long")
    helpers = spark.createDataFrame([(4, 5), (5, 4), (6, None)], "attribute long, provider long")
    assert sorted(map(tuple, gates.derive_requirements(influences, helpers).collect())) == [(1, 2), (4, 5), (5, 4)]


def test_parent_unions(spark):
    local = spark.createDataFrame([(0, 7), (1, 8), (2, 9), (4, 7)], "set_id long, unit_id long")
    parents = spark.createDataFrame([(3, 0), (3, 1), (4, 1), (4, 2)], "set_id long, parent_set_id long")
    # 3 stands for {0, 1}; 4 has a unit of its own, so that {1, 2} is new; 5 is unknown; a null is no set.
    unions = [(0, 2), (0, 2), (1, 1), (1, 0), (2, 1), (2, 2), (3, 2), (3, 1), (4, 1), (4, 5), (5, None)]
    roots, added, wrong = closure.parent_unions(local, parents, spark.createDataFrame(unions, "union_id long, set_id long"))
    assert sorted(map(tuple, roots.collect())) == [(0, 2), (1, 3), (2, 7), (3, 7)]
    assert sorted(map(tuple, added.collect())) == [(7, 1), (7, 2)]
    assert sorted(r[0] for r in wrong.collect()) == [4, 5]
    empty = [x.limit(0) for x in (local, parents)]
    roots, added, wrong = closure.parent_unions(*empty, spark.createDataFrame([], "union_id long, set_id long"))
    assert roots.collect() == added.collect() == wrong.collect() == []


def test_nested_lists(spark):
    def cut(text, kept):
        """Elements of a text of letters, commas and braces; a brace's list belongs to the element that it ends."""
        rows, open_at = [], []

        def parse(at, parent):
            here, start = [], at
            while True:
                node, leaf = f"{start}", True
                while at < len(text) and text[at] not in ",}":
                    if text[at] == "{":
                        leaf = False
                        at = parse(at + 1, node)
                    at += 1
                here.append([node, parent, leaf and at > start, start, at])
                if at == len(text) or text[at] == "}":
                    break
                at = start = at + 1
            for k, (node, up, leaf, s, e) in enumerate(here):
                rows.append((1, node, up, leaf, s, e, s - 1 if k else None, e + 1 if k < len(here) - 1 else None))
            return at

        parse(0, None)
        elements = spark.createDataFrame(rows, "source_id long, node string, parent string, leaf boolean, start long, end long, ahead long, behind long")
        stays = spark.createDataFrame([(n,) for _, n, _, leaf, s, e, _, _ in rows if leaf and text[s:e] in kept], "node string")
        gone = rewriting.nested_deletions(elements, stays)
        docs = spark.createDataFrame([(1, text)], "source_id long, text string")
        return rewriting.rewritten(docs, gone)[0].first()["text"]

    assert cut("a,x{b,c,y{d,e}},f", {"a", "d"}) == "a,x{y{d}}"
    assert cut("a,x{b,c,y{d,e}},f", {"b", "e", "f"}) == "x{b,y{e}},f"
    assert cut("a,b,c", {"a"}) == "a,"  # the list keeps the separator between two that go
    assert cut("a,b", {"a"}) == "a"
    assert cut("a,x{}", {"a"}) == "a,x{}"


def test_shared_lists_in_retention(spark):
    """Choices from lists that disjunctions share are kept as if each had them for itself."""
    rows = lambda **f: {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in f.items()}
    base = {"roots": [(1,), (2,)], "binding": [(1, 11), (2, 12), (3, 13)], "disjunctions": [(5, 11), (6, 12), (7, 13)]}
    offers, members = [(0, 30, 4), (0, 31, 2), (1, 32, 1)], [(5, 0), (6, 0), (6, 1), (7, 1)]
    # 5 picks 31, which is in a list of 6, too, whose own least is 32; 7 never wakes.
    kept = retained(Facts.of(spark, ["cost"], **rows(**base, choice_lists=members, list_offers=offers)))
    assert sorted(r["unit"] for r in kept.units.collect()) == [11, 12, 31]
