"""Quality, toxicity, language and neighbours: plain models, held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reachflow.llm import kneser_ney, language, neighbours, toxicity

ODD = [(None, "no id here", "en", "x"), (901, None, None, "x"), (902, "", "en", "x"), (903, "1234 !!", "en", "x"), (904, "long " * 40_000, "en", "x"), (1, "the same", "en", None), (1, "the same", "en", None)]
SCHEMA = "doc_id long, text string, lang string, SCORE string"


def windows(text: str, n: int) -> list[str]:
    """The n-grams of a text between boundaries."""
    line = "\0" * (n - 1) + text + "\0"
    return [line[i : i + n] for i in range(len(text) + 1)]


def plain_kneser_ney(texts: list[str], order: int):
    """Probabilities of the interpolated modified model, from its definition."""
    grams: list[dict] = [defaultdict(int) for _ in range(order + 1)]
    for t in texts:
        for g in windows(t, order):
            grams[order][g] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    cuts = [None]
    for n in range(1, order + 1):
        of = [0] + [sum(1 for v in grams[n].values() if v == k) for k in (1, 2, 3, 4)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
        raw = (1 - 2 * y * of[2] / of[1] if of[1] else 0.5, 2 - 3 * y * of[3] / of[2] if of[2] else 1.0, 3 - 4 * y * of[4] / of[3] if of[3] else 1.5)
        cuts.append([min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)])
    contexts: list[dict] = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, v in grams[n].items():
            contexts[n][g[:-1]].append(v)

    def p(gram: str, n: int) -> float:
        lower = p(gram[1:], n - 1) if n > 1 else 1 / (len(grams[1]) + 1)
        after = contexts[n].get(gram[:-1])
        if not after:
            return lower
        d = cuts[n]
        own = grams[n].get(gram, 0)
        back = sum(d[min(v, 3) - 1] for v in after)
        return (max(own - (d[min(own, 3) - 1] if own else 0), 0) + back * lower) / sum(after)

    return lambda gram: p(gram, order)


TEXTS = ["the cat sat on the mat.", "The dog sat!", "a cat, a dog and the rest", "été à la mer", "the cat sat on the mat.", "он пошёл в лес", "我们走了"]


def _counts(spark, texts: list[str]):
    found = defaultdict(int)
    for t in texts:
        for g in windows(t, kneser_ney.ORDER):
            found[g] += 1
    return spark.createDataFrame(list(found.items()), "gram string, n long")


def test_probabilities_equal_the_definition(spark):
    asked = sorted({g for t in [*TEXTS, "zebra on the moon", "THE CAT", "", "в лес", "𐍈"] for g in windows(t, kneser_ney.ORDER)})
    p = plain_kneser_ney(TEXTS, kneser_ney.ORDER)
    rows = kneser_ney.model(_counts(spark, TEXTS), spark.createDataFrame([(g,) for g in asked], "gram string")).collect()
    assert sorted(r["gram"] for r in rows) == asked
    for r in rows:
        assert math.isclose(math.exp(r["logp"]), p(r["gram"]), rel_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    every = sorted({c for t in TEXTS for c in t} | {"\0", "ж"})  # one stands for all characters that aren't counted
    rows = spark.createDataFrame([("the" + c,) for c in every], "gram string")
    found = kneser_ney.model(_counts(spark, TEXTS), rows).collect()
    assert math.isclose(sum(math.exp(r["logp"]) for r in found), 1, rel_tol=1e-9)


def test_perplexities_and_limits_equal_plain_ones(spark, monkeypatch):
    """Every document against the plain model of the counted texts, over several blocks; limits from the held-out ones."""
    docs, labels = _corpus(120)
    rows = [*docs, *[(5000 + i, t, "xx", "x") for i, t in enumerate(TEXTS)], (None, "no id", "en", "x"), (7000, None, "en", "x"), (7001, "", "en", "x")]
    known = {d: q for d, q, _ in labels}
    trusted = [r for r in rows if known.get(r[0]) == 1]
    out = lambda d: zlib.crc32(str(d).encode()) % kneser_ney.FOLDS == 0
    p = plain_kneser_ney([t for d, t, *_ in trusted if not out(d)], kneser_ney.ORDER)

    def perplexity(t: str | None) -> float:
        grams = windows(t or "", kneser_ney.ORDER)
        return math.exp(-sum(math.log(p(g)) for g in grams) / len(grams))

    frame = spark.createDataFrame(rows, SCHEMA)
    blocks = kneser_ney.Blocks(frame, 4000)
    assert blocks.table.count() > 3 and set(frame.columns).isdisjoint({blocks.id, blocks.lang})
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 4000)
    got = kneser_ney.judged(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    text = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    assert all(math.isclose(r["perplexity"], perplexity(text[r["doc_id"]]), rel_tol=1e-9) and r["n_symbols"] == len(text[r["doc_id"]] or "") for r in got)
    held = sorted(perplexity(t) for d, t, *_ in trusted if out(d))
    # No trusted text of this language: the quantile of all.
    high = held[-1] + (held[-1] - held[(len(held) - 1) // 2]) * kneser_ney.ERROR / math.sqrt(len(held))
    assert all(math.isclose(r["threshold"], high, rel_tol=1e-9) for r in got if r["lang"] == "xx")


def test_texts_of_any_script_are_told_apart(spark):
    texts = ["мама мыла раму и пела", "папа читал газету дома", "我们沿着河边散步谈论未来", "昨天晚上他们回家看书"]
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate([*texts * 20, "ъыьщэ юяфхц чшж ёйъы эюя", "龘靐齉爩鱻麤龗灪"])], SCHEMA)
    marks = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in kneser_ney.judged(frame, marks).collect()}
    assert len({got[i]["perplexity"] for i in range(4)}) == 4
    assert all(got[i]["kept"] for i in range(80)) and not got[80]["kept"] and not got[81]["kept"]


def _corpus(n: int = 240) -> tuple[list, list]:
    rng = np.random.default_rng(5)
    words = {"en": ["the", "house", "with", "three", "windows", "stands", "near"], "de": ["der", "straße", "über", "schöne", "nicht", "häuser", "und"], "fr": ["le", "château", "près", "été", "où", "très", "belle"]}
    docs, labels = [], []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(rng.choice(words[lang], 40)) + "."
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            text += " you idiot moron"
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        docs.append((1000 + i, text, lang, "x"))
        labels.append((1000 + i, int(not bad), int(toxic)))
    return docs, labels


def test_quality(spark):
    docs, labels = _corpus()
    frame = spark.createDataFrame(docs + ODD, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1000, None, None)], "doc_id long, quality int, toxic int")
    got = kneser_ney.judged(frame, marks).collect()
    assert len(got) == len(docs) + len(ODD)
    kept = {r["doc_id"]: r["kept"] for r in got}
    good = dict((d, q) for d, q, _ in labels)
    assert all(kept[d] == bool(q) for d, q in good.items())
    assert not kept[901] and not kept[902]
    rows = kneser_ney.kept(frame, marks)
    assert rows.columns == frame.columns
    assert sorted(r["doc_id"] for r in rows.collect() if (r["doc_id"] or 0) >= 1000) == sorted(d for d, q in good.items() if q)
    assert kneser_ney.judged(frame.limit(0), marks).collect() == []
    # Without trusted texts, all texts stay.
    assert kneser_ney.judged(frame, marks.limit(0)).where("kept").count() == len(docs) + len(ODD) - 2


def test_repeated_words_go_and_small_languages_have_their_own_limits(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(["the", "ing", "and", "ton", "er", "sh"], 2)) + x for x in ["", "e", "s", "ed", "y", "th", "on"] for _ in range(12)]
    prose = [(i, " ".join(rng.choice(words, int(rng.integers(20, 200)))), "en") for i in range(300)]
    runs = [(1000 + i, " ".join([w] * 90), "en") for i, w in enumerate(words[:20])] + [(1100 + i, " ".join([words[i], words[i + 1]] * 60), "en") for i in range(20)]
    strange = [(2000 + i, " ".join(x.upper() + "#" for x in rng.choice(words, 60)), "xx") for i in range(19)]
    frame = spark.createDataFrame(prose + runs + strange, "doc_id long, text string, lang string")
    trusted = [(i, 1) for i in range(300)] + [(2000 + i, 1) for i in range(19)]
    got = {r["doc_id"]: r for r in kneser_ney.judged(frame, spark.createDataFrame(trusted, "doc_id long, quality int")).collect()}
    assert not any(got[d]["kept"] for d, _, _ in runs)
    assert sum(got[d]["kept"] for d, _, _ in prose) >= 297
    # Two trusted texts of a language count, too; these two are in the fold that gives the limits.
    fewer = {r["doc_id"]: r for r in kneser_ney.judged(frame, spark.createDataFrame(trusted[:300] + [(2002, 1), (2004, 1)], "doc_id long, quality int")).collect()}
    assert fewer[2000]["threshold"] != fewer[0]["threshold"]


def test_repetition_equals_the_definition():
    texts = ["a b a c", "", "x x x", "a", "one two three four five one", "one two three four one"]

    def plain(t: str) -> float:
        w = t.split()
        return (sum(w[i] in w[max(0, i - 4) : i] for i in range(len(w))) + 1) / (len(w) + 20)

    assert kneser_ney.repetition([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def test_toxicity(spark):
    docs, labels = _corpus()
    frame = spark.createDataFrame(docs + ODD, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    fitted = toxicity.trained(frame, marks)
    got = toxicity.scored(frame, fitted).collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    toxic = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) >= 0.95
    none = toxicity.trained(frame, marks.limit(0))
    assert {r["score"] for r in toxicity.scored(frame, none).collect()} == {0.5}
    assert toxicity.scored(frame.limit(0), fitted).collect() == []


def test_follow_the_leader_reaches_zero_weights():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 500, 20)).astype(np.int32) for _ in range(400)]
    y = np.array([int(7 in r) for r in rows])
    rows = [r for r in rows]
    at, w, bias = toxicity.fit(rows, y)
    assert 7 in at.tolist() and w[at.tolist().index(7)] > 0 and len(at) < 250


def test_skip_grams_stay_in_their_text():
    one = toxicity.presence([b"a b c", b"d e"])
    assert [len(x) for x in one] == [3 + 2 + 1, 2 + 1]
    assert (toxicity.presence([b"d e"])[0] == one[1]).all()
    assert (toxicity.presence([b"D  e!"])[0] == one[1]).all()


def test_language(spark):
    docs, _ = _corpus()
    frame = spark.createDataFrame(docs + ODD, SCHEMA)
    fitted = language.trained(frame)
    got = language.identified(frame, fitted).collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    lang = {d: x for d, _, x, _ in docs}
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[901]["lang_pred"] == by[902]["lang_pred"] == by[903]["lang_pred"] == "und"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    stay = language.kept(frame, fitted)
    assert stay.columns == frame.columns and {901, 902, 903}.isdisjoint({r["doc_id"] for r in stay.collect()})
    assert language.trained(frame.limit(0)) is None
    assert {r["lang_pred"] for r in language.identified(frame, None).collect()} == {"und"}


@pytest.mark.parametrize("n_langs", [2, 5])
def test_texts_of_no_learned_language_go(spark, n_langs):
    rng = np.random.default_rng(8)
    parts = [["the", "ing", "and", "tion", "er"], ["sch", "ung", "über", "ein", "keit"], ["eau", "que", "oir", "été", "ment"], ["ción", "ando", "ñas", "los", "ido"], ["ij", "oor", "aan", "lijk", "heid"]][:n_langs]

    def prose(k: int) -> str:
        return " ".join("".join(rng.choice(parts[k], int(rng.integers(1, 3)))) for _ in range(int(rng.integers(5, 120))))

    learned = [(i, prose(i % n_langs), str(i % n_langs)) for i in range(120 * n_langs)]
    clean = [(10_000 + i, prose(i % n_langs), None) for i in range(100)]
    gibberish = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 400)) for _ in range(20)]
    strange = ["Съешь ещё этих мягких французских булок да выпей чаю", "昨天晚上我们沿着河边散步谈论我们国家的未来", "Wczoraj wieczorem poszliśmy na spacer wzdłuż rzeki", "qzxj " * 60, *gibberish]
    asked = [*clean, *((20_000 + i, t, None) for i, t in enumerate(strange))]
    schema = "doc_id long, text string, lang string"
    stay = {r["doc_id"] for r in language.kept(spark.createDataFrame(asked, schema), language.trained(spark.createDataFrame(learned, schema))).collect()}
    assert {d for d in stay if d >= 20_000} == set()
    assert len(stay) >= 99


def test_kernel_equals_the_definition():
    texts = ["the house", "der Häuser", "a", "the house the house"]
    x = language.presence([t.encode() for t in texts])
    k = language.kernel(x, language.unit(x))

    def grams(t: str) -> set:
        b = b"    " + t.lower().encode() + b"    "
        b = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in b)
        return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            ga, gb = grams(a), grams(b)
            assert abs(k[i, j] - len(ga & gb) / math.sqrt(len(ga) * len(gb))) < 0.03


def test_presence_knows_no_neighbours():
    alone = language.presence([b"word"])[0]
    among = language.presence([b"abc", b"word", b"xyz"])[1]
    assert (alone == among).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1500, 16))
    x[500:900] = x[3] + rng.normal(size=(400, 16)) * 0.01  # a dense cluster
    x[900:1200] = x[7]  # equal vectors
    rows = [(i, [float(v) for v in x[i]], "n") for i in range(len(x))]
    odd = [(5000, None, "n"), (5100, [], "n"), (5200, [0.0] * 16, "n"), (5300, [float("nan")] * 16, "n"), (5400, [None, *[1.0] * 15], "n"), (None, [1.0] * 16, "n"), (5500, [1.0] * 3, "n"), (5600, [float("inf"), *[1.0] * 15], "n")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, RANK string")
    got = defaultdict(list)
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), far)).tolist() if i != q][:10]
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(s - far[v]) < 1e-12 for _, v, s in found)
        hit += len({f[1] for f in found} & set(order))
    assert hit / (10 * len(got)) >= 0.95
    assert [v for _, v, _ in got[1000]] == [7, *range(900, 909)]


def test_few_neighbours(spark):
    frame = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in neighbours.nearest(frame).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert neighbours.nearest(frame.limit(0)).collect() == []


def test_letters_are_of_category_l(spark):
    docs = spark.createDataFrame([(1, "½ ² ①", "de"), (2, "Ⅷ 5", "de"), (3, "ein wort", "de"), (4, "中", "zh"), (5, "ª", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identified(docs, language.trained(docs)).collect()}
    assert got[1] == got[2] == "und" and "und" not in (got[3], got[4], got[5])


def test_an_id_counts_once(spark):
    rows = [(3, f"text {k % 2} of one id", "en", 1) for k in range(400)] + [(k, f"ein kurzer text {k}", "de", 0) for k in range(40, 80)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    few = language.trained(docs.dropDuplicates(["doc_id"]).union(docs.limit(0)))
    assert {len(language.trained(docs)["marks"]), len(few["marks"])} == {len(few["marks"])}


def test_every_row_teaches_languages(spark):
    rng = np.random.default_rng(5)
    parts = {"de": ["sch", "ung", "über", "ein"], "en": ["the", "ing", "tion", "er"]}
    rows = [(i, " ".join(rng.choice(parts[x], 6)) + (" zyx" if i % 20 == 0 else ""), x) for i, x in enumerate(["de"] * 1900 + ["en"] * 500)]
    got = language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), every=True)
    assert got["names"].tolist() == ["de", "en"]
    x, langs = np.concatenate(list(language.rows_of([t.encode() for _, t, _ in rows]))), np.array([r[2] for r in rows])
    weight = np.array([len(rows) / (2 * (langs == name).sum()) for name in langs])[:, None]
    base = language.unit(np.unpackbits(got["marks"], axis=1))
    k = language.kernel(x, base).astype(float)
    # A plain weighted ridge regression over all rows gives these scores.
    of, axes = np.linalg.eigh((base @ base.T).astype(float))
    root = axes / np.sqrt(np.maximum(of, 1e-6)) @ axes.T
    phi, target = np.hstack([k @ root, np.ones((len(k), 1))]), np.array([[1.0 if a == name else -1.0 for name in ("de", "en")] for a in langs])
    w = np.linalg.solve(phi.T @ (phi * weight) + language.RIDGE * np.eye(phi.shape[1]), phi.T @ (target * weight))
    assert np.abs(k @ got["w"] + got["b"] - phi @ w).max() < 0.02
    for i, name in enumerate(("de", "en")):
        own = x[langs == name]
        n, count = len(own), own.sum(axis=0)
        assert (np.unpackbits(got["unions"][i]) == ((count >= 0.025 * n) & (count > 0))).all()
        others = (count - 1 >= 0.025 * (n - 1)) & (count > 1)
        share = np.sort((own * others).sum(axis=1) / own.sum(axis=1))[int((n - 1) * language.QUANTILE)]
        assert abs(got["least"][i] - max(0.0, 1 - language.SLACK * (1 - share))) < 1e-3
