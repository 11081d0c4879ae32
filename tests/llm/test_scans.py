"""Licence scans, the audit of filters and hard negatives, each against a plain version."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from reachflow.llm import audit, hard_negatives, licences

DOCS = "doc_id long, text string, lang string, Codes string, held string, n string, label string"


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(d, t, x, "c", "h", "n", "l") for d, t, x in rows], DOCS)


def words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_scan(text: str | None) -> tuple:
    ws, base, found = words(text), [], []
    for into, templates in ((base, licences.BASE), (found, licences.TEMPLATES)):
        for t in templates:
            own = t.words
            for d in range(1 - len(own), len(ws)):
                same = [0 <= d + k < len(ws) and ws[d + k] == w for k, w in enumerate(own)]
                if sum(same) >= t.needed and all(same[k] for k in t.mandatory):
                    into.append((d, t.label, sum(same) / len(own)))
    starts = [b[0] for b in base]
    join = lambda x: ",".join(sorted({m[1] for m in x}))
    return (len(ws), len(base), min(starts, default=None), max(starts, default=None), join(base), join(base + found), max([m[2] for m in base + found], default=0.0))


TEXTS = [
    None, "", " .,;", "Released under the MIT License.", "CC BY-NC 4.0; cc by nc\ncc_by_nc", "cc by nccc by nc cc by nc", "Under-the-mit-licenſe under the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "distributed under the GNU General Public License; see version 3", "under our gnu general public license version 2 or later",
    "APACHE LICENSE VERSION 2, apache licence version 2", "Permission is hereby granted, free of charge, to some person obtaining the copy of this software and associated documentation files",
    "the " * 3000 + "under the mit license", "license " * 50_000 + "apache license version 2", "gnu general public license version 3", "is free and unencumbered software released into", "łicense under the mit license 語 cc by nc",
]


def test_licences_against_plain_scan(spark):
    rng = np.random.default_rng(3)
    known = licences.vocabulary((*licences.BASE, *licences.TEMPLATES))
    texts = TEXTS + [" ".join(rng.choice(known + ["x", "Y7", "é"], rng.integers(1, 200))) for _ in range(40)]
    for t in licences.TEMPLATES:  # with words lost, put in and replaced
        own = t.words
        for k in range(4):
            changed = [w if rng.random() > 0.1 * k else "other" for w in own]
            texts.append(" ".join(["before"] * k + changed + ["under the mit license"] * (k % 2)))
    rows = [(k if k % 5 else None, t, "en") for k, t in enumerate(texts)] + [(1, texts[3], "en"), (1, texts[7], None)]
    got = licences.licences(frame(spark, rows)).collect()
    key = lambda r: (str(r[0]), str(r))
    want = sorted(((d, *plain_scan(t)) for d, t, _ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert licences.licences(frame(spark, [])).collect() == []


def test_licence_plan_has_no_python(spark):
    plan = licences.licences(frame(spark, [(1, "x", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)


def test_mandatory_places():
    t = licences.Template("x", "under the gnu general public license version 3", ("gnu general public license", "version 3"))
    assert t.mandatory == [2, 3, 4, 5, 6, 7] and t.needed == 6
    assert licences.BASE[1].mandatory == [0, 1, 2, 3] and licences.BASE[1].needed == 4


def plain_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    told = {}
    for d, quality, toxic in labels:
        good, bad = told.get(d, (False, False))
        told[d] = (good or quality == 1, bad or toxic == 1)
    found = []
    for d, text, lang in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = any(e is not None and d is not None and e < d and (other or "") == text for e, other, _ in docs)
        fails = (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)
        found.append((lang or "", fails, *(told.get(d, (False, False)) if d is not None else (False, False))))
    out = []
    for part in {f[0] for f in found}:
        own, rows, total = [f[1:] for f in found if f[0] == part], [], {}
        for order in permutations(range(5)):
            left = list(own)
            for step, k in enumerate(order, 1):
                gone, stay = [f for f in left if f[0][k]], [f for f in left if not f[0][k]]
                redundant = sum(f[0][k] for f in own) - len(gone)
                rows.append((part, "".join("ABCDE"[i] for i in order), step, len(stay), len(gone), redundant, sum(f[0][k] and sum(f[0]) == 1 for f in own), sum(f[1] for f in gone), sum(f[2] for f in gone), k))
                total[k] = total.get(k, 0) + len(gone)
                left = stay
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return out


def test_audit_against_replayed_orders(spark):
    rng = np.random.default_rng(5)
    docs = [(None, "a", "en"), (None, "a", "de"), (3, "a", None), (3, "a", "en"), (2, "a", "en"), (7, None, ""), (8, "", "en"), (9, " \n", "en"), (10, "x|y", "de"), (11, "w " * 40_000, "de"), (12, " ".join(f"W{k}" for k in range(120)), "en")]
    base = [" ".join(rng.choice([f"w{k}" for k in range(n)], n + 30)) for n in (60, 90, 400)] + ["AB C# d", "A b"]
    docs += [(int(rng.integers(20, 90)), base[rng.integers(len(base))], ("en", "de", None)[rng.integers(3)]) for _ in range(120)]
    labels = [(int(d), int(rng.integers(2)) if rng.random() < 0.8 else None, int(rng.integers(2))) for d in rng.integers(0, 90, 70)] + [(None, 1, 1), (3, None, None)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(audit.masks(frame(spark, docs), told)).collect())
    assert got == sorted(plain_audit(docs, labels))
    assert audit.audit(audit.masks(frame(spark, []), told)).collect() == []
    none = spark.createDataFrame([], told.schema)
    assert {r.good_lost for r in audit.audit(audit.masks(frame(spark, docs), none)).collect()} == {0}


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 3, 2, 1, 0), ("p", 1, 4, 0, 2)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in audit.audit(counts, "XY").collect()}
    assert len(rows) == 4 and rows["XY", 1].removed == 6 and rows["XY", 2].removed == 0 and rows["XY", 2].redundant == 2
    assert rows["YX", 1].removed == 2 and rows["YX", 2].removed == 4 and rows["YX", 2].kept == 5 and rows["YX", 2].unique_fails == 4 and rows["YX", 2].shapley == 10


def plain_mined(rows: list[tuple]) -> list[tuple]:
    own = []
    for d, v, label in rows:
        if d is None or label is None or v is None or len(v) != 3 or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((d, (label + 1) % 10 if d % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for d, label, x in own:
        if d % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), e, other == label) for e, other, y in own if e != d]
        for p, e, _ in sorted(s for s in scored if s[2])[:5]:
            good = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(d, e, rank, f, -p, -n) for rank, (n, f, _) in enumerate(good, 1)]
    return sorted(out)


@pytest.mark.parametrize("slab", [100, 32_768])
def test_hard_negatives_against_brute_force(spark, slab, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BOXES", 3), monkeypatch.setattr(hard_negatives, "ASKS", 7)
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in rng.normal(0.2, 0.5, 3)], int(rng.integers(0, 4))) for k in range(1500)]
    rows += [(k, [0.5, 0.25, 0.5], k % 2) for k in range(2000, 2600)]  # a third of all rows are one vector
    rows += [(1, None, 1), (None, [1.0, 1.0, 1.0], 1), (3, [1.0, None, 1.0], 1), (5, [1.0, float("nan"), 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1), (8, [1.0], 1), (9, [], 1), (10, [1.0, 1.0, 1.0], None)]
    rows += [(4000, [0.0, 0.0, 0.0], 1), (4100, [-1.0, -1.0, -1.0], 9), (200, [0.1, 0.2, 0.3], 1), (200, [0.1, 0.2, 0.3], 1), (5000, [1e9, -1e9, 3.0], 2), (5001, [1e9, -1e9, 5.0], 2), (5002, [7e8, -7e8, 5.0], 3)]
    table = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<double>, label int, ask string, slab string").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mined(table, relabel=hard_negatives.seventh(), slab=slab).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    plain = plain_mined(rows)
    exact = [r for r in plain if r[0] != 5000]
    assert [r for r in got if r[0] != 5000] == exact and len(exact) > 300
    assert [r[:4] for r in got if r[0] == 5000] == [r[:4] for r in plain if r[0] == 5000]  # scores beyond 53 bits are rounded


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mined(spark.createDataFrame([], schema)).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(100, [1.0, 1.0], 1)], schema)).collect() == []
    got = hard_negatives.mined(spark.createDataFrame([(100, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [1.0, 1.0], 2)], schema)).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 131072, 65536)]


def test_boxes_leave_leaves_out():
    """In few dimensions most leaves are never looked at; a leaf whose bound equals the k-th score is."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(0, 200, (6400, 2)))
    points = points[np.lexsort((points[:, 1], points[:, 0] // 40))]
    parts = np.split(points, 100)
    leaves = pa.table({"label": np.zeros(100, np.int64), "ids": [np.arange(64 * k, 64 * k + 64).tobytes() for k in range(100)], "low": [p.min(axis=0).tobytes() for p in parts], "high": [p.max(axis=0).tobytes() for p in parts], "rows": [p.tobytes() for p in parts]})
    x = np.floor(rng.normal(0, 200, (20, 2)))
    asked = pa.table({"ask": np.arange(20), "anchor": np.full(20, -1), "label": np.ones(20, np.int64), "same": [False] * 20, "k": np.full(20, 10), "least": np.full(20, -np.inf), "most": np.full(20, np.inf), "x": [v.tobytes() for v in x]})
    found, looked = hard_negatives.search(leaves, asked)
    assert looked < 20 * 100 // 4
    scores = x @ points.T
    for k in range(20):
        own = found.filter(pa.compute.equal(found.column("ask"), k))
        order = np.lexsort((np.arange(6400), -scores[k]))[:10]
        assert own.column("id").to_pylist() == order.tolist() and own.column("score").to_pylist() == scores[k][order].tolist()


