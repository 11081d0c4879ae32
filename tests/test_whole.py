"""Queries over all rows: against their oracles and brute force on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__

TABLES = ("documents", "lineitem", "supplier", "part")


def by_oracle(small: str, name: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        found = db.execute(__spark_entry__.oracle_sql()[name])
        return [c[0] for c in found.description], Counter(found.fetchall())


@pytest.mark.parametrize("name", ["j3_piece_owners", "j9_child_containing", "j21_overlaps", "r12_contributor_union", "c1_greedy_choice", "x3_char_boundaries", "e3_list_deletion"])
def test_all_rows(spark, small, name):
    columns, expected = by_oracle(small, name)
    assert Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, small).select(*columns).collect()) == expected


def test_components_of_all_lines(spark, small):
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    with duckdb.connect() as db:
        pairs = db.execute(f"SELECT l_orderkey * 2, l_partkey * 2 + 1 FROM '{small}/lineitem.parquet'").fetchall()
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r[0]: r[1] for r in __spark_entry__.queries()["r11_components"](spark, small).collect()}
    assert got == {x: top(x) for x in list(up)}


def test_char_begins_and_late_lines(spark, tmp_path):
    texts = ["aé漢😀" * 300, "x", "\x80\x9f é"]
    docs = [(i, t) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_chars"] for r in __spark_entry__.queries()["x3_char_boundaries"](spark, str(tmp_path)).collect()}
    assert got == {i: len(t) for i, t in docs}


def test_inventory_checks_every_line(spark, monkeypatch, tmp_path):
    from reachflow.plans import constraints

    spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    plain = constraints.checks.unit_inventory
    monkeypatch.setattr(constraints.checks, "unit_inventory", lambda units, docs: seen.append(units) or plain(units, docs))
    assert constraints.v11_unit_inventory(spark, str(tmp_path)).collect() == []
    assert sorted(r["unit_id"] for r in seen[0].collect()) == [-1, 0, 1, 2, 3]


def test_inventory_equals_its_oracle(spark, small):
    columns, expected = by_oracle(small, "v11_unit_inventory")
    assert Counter(tuple(r) for r in __spark_entry__.queries()["v11_unit_inventory"](spark, small).select(*columns).collect()) == expected
