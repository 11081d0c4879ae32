"""License scans by a positional index of rare words, with DataFrame functions only.

Every text becomes an array of small numbers, one for each word: the place of a licence word in the vocabulary of all
templates, 0 for any other word. The documents that hold each licence word are counted over the whole table. A file looks
up its words of highest inverse document frequency, as many of each template as a match can't do without; each posting
(word, place in the template) proposes the relative position word - place. At a proposed position the template's words
are intersected with the file's, and its mandatory phrases must stand there as a whole.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachflow.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but digits and, after lower-casing, letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """Words of a licence; `phrases` are mandatory where the template has them, and `least` is the share of words to match."""

    label: str
    text: str
    phrases: tuple[str, ...]
    least: float = 0.7

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> int:
        """How many words have to be at their places."""
        return max(-(-round(self.least * 1000) * len(self.words) // 1000), len(self.mandatory))

    @property
    def mandatory(self) -> list[int]:
        """The places of the words of mandatory phrases."""
        padded = f" {self.text} "
        found = set()
        for phrase in self.phrases:
            before = padded.index(f" {phrase} ")
            begin = len(padded[:before].split())
            found |= set(range(begin, begin + len(phrase.split())))
        return sorted(found)


#: The phrases that count as base places, and their labels.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), 1.0),
    Template("apache-2", "apache license version 2", ("apache license version 2",), 1.0),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), 1.0),
)
#: Sentences of common licences and notices, as words.
TEMPLATES = (
    Template("gpl-3", "under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "this software and associated documentation files")),
    Template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-sa", "under the creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "under the creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    """All words of the templates; a word's number is its place here, from 1."""
    return sorted({w for t in templates for w in t.words})


def words_of(text: Column) -> Column:
    """The words of a text (null: none), lower-cased in A-Z."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAPS, -1), "")


def coded(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, codes (a number for each word, 0 for words of no template) of every row: a written table."""
    known = vocabulary(templates)
    every = F.array(*[F.lit(w) for w in known])
    code = lambda w: F.when(w.isin(known), F.array_position(every, w).cast("smallint")).otherwise(F.lit(0).cast("smallint"))
    return common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).select("doc_id", F.transform("words", code).alias("codes")))


def frequencies(table: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """How many rows of the whole table hold each word of the templates: one number for each of them comes to the driver."""
    known = vocabulary(templates)
    held = table.select(F.explode(F.array_distinct(F.filter("codes", lambda c: c > 0))).alias("code")).groupBy("code").count()
    found = {known[r["code"] - 1]: r["count"] for r in held.collect()}
    return {w: found.get(w, 0) for w in known}


def small_array(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def matches(template: Template, number: dict[str, int], rank: dict[str, int], codes: Column, held: Column) -> Column:
    """array<struct<start, share>>: where the template's words stand in the codes; held: the distinct numbers above 0 of the codes.

    Of the L words of a template `needed` must match, so that a match holds one of any L - needed + 1 of them. A file
    that lacks some looks up that many fewer; these are its words of the template of highest inverse document frequency.
    """
    words, own = template.words, [number[w] for w in template.words]
    rarest = small_array(sorted(own, key=lambda c: (rank[c], c)))  # with repeated words, as each is a place
    there = F.filter(rarest, lambda c: F.array_contains(held, c.cast("smallint")))
    looked_up = F.array_distinct(F.slice(there, 1, F.greatest(F.size(there) - (template.needed - 1), F.lit(0))))
    every = F.forall(small_array(sorted({own[k] for k in template.mandatory})), lambda c: F.array_contains(held, c.cast("smallint")))
    postings = F.create_map(*[x for c in sorted(set(own)) for x in (F.lit(c), small_array([k for k, o in enumerate(own) if o == c]))])
    hits = lambda c: F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: F.get(codes, i) == c)
    at = F.array_distinct(F.flatten(F.transform(looked_up, lambda c: F.flatten(F.transform(hits(c), lambda i: F.transform(F.element_at(postings, c), lambda p: i - p))))))
    places, own_words = F.sequence(F.lit(0), F.lit(len(words) - 1)), small_array(own)
    agrees = lambda d: lambda k: F.coalesce(F.get(codes, d + k) == F.get(own_words, k), F.lit(False))
    whole = F.filter(at, lambda d: F.forall(small_array(template.mandatory), agrees(d))) if template.mandatory else at
    scored = F.transform(whole, lambda d: F.struct(d.alias("start"), (F.size(F.filter(places, agrees(d))) / F.lit(len(words))).alias("share")))
    good = F.filter(scored, lambda m: m["share"] * F.lit(len(words)) >= F.lit(template.needed - 0.5))
    return F.when(every & (F.size(there) >= template.needed), good).otherwise(F.array().cast("array<struct<start:int,share:double>>"))


def scanned(docs: DataFrame, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base (array of start, label), found (array of start, share, label) of every row of docs.

    base: all places where a base phrase stands. found: all places of other templates, with the share of their words.
    A null text counts as empty and has no words and no places. Rows are looked at each by itself, so that ids may be null
    or repeat. Other columns are left out, whatever their names. Two texts of equal words have equal results.
    """
    every = (*base, *templates)
    table, known = coded(docs, every), vocabulary(every)
    number = {w: k for k, w in enumerate(known, 1)}
    frequency = frequencies(table, every)
    rank = {number[w]: k for k, w in enumerate(sorted(known, key=lambda w: (frequency[w], w)))}
    rows = table.withColumn("held", F.array_distinct(F.filter("codes", lambda c: c > 0)))
    place = lambda t: F.transform(matches(t, number, rank, F.col("codes"), F.col("held")), lambda m: F.struct(m["start"].alias("start"), m["share"].alias("share"), F.lit(t.label).alias("label")))
    sides = [F.concat(*[place(t) for t in side]) if side else F.array().cast("array<struct<start:int,share:double,label:string>>") for side in (base, templates)]
    return rows.select("doc_id", F.size("codes").cast("long").alias("n_words"), sides[0].alias("base"), sides[1].alias("found"))


def digest(scans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every scan.

    score is the greatest share of any place, 1 with a base place, 0 without any place.
    """
    names = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda m: m["label"]) for x in c]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    score = F.array_max(F.transform(F.concat("base", "found"), lambda m: m["share"]))
    return scans.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), names("base").alias("base_labels"), names("base", "found").alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"))


def licences(docs: DataFrame, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """digest() of scanned()."""
    return digest(scanned(docs, base, templates))


def oracle(base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same rows in SQL: every place of every template that shares a word, without looking up rare words first."""
    every = [(t, True) for t in base] + [(t, False) for t in templates]
    postings = ", ".join(f"({n}, '{w}', {k}, {str(k in t.mandatory).lower()})" for n, (t, _) in enumerate(every) for k, w in enumerate(t.words))
    about = ", ".join(f"({n}, '{t.label}', {len(t.words)}, {t.needed}, {len(t.mandatory)}, {str(b).lower()})" for n, (t, b) in enumerate(every))
    pattern = re.sub(r"^\[", "[^", GAPS)
    return f"""
WITH postings(t, w, p, must) AS (VALUES {postings}), about(t, label, size, needed, musts, base) AS (VALUES {about}),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM rows_),
places AS (SELECT r, t, i - p AS d, count(*) AS n, count(*) FILTER (must) AS m FROM words JOIN postings USING (w) GROUP BY ALL),
found AS (SELECT r, d, label, base, n / size::DOUBLE AS share FROM places JOIN about USING (t) WHERE n >= needed AND m = musts),
sums AS (SELECT r, count(*) FILTER (base) AS n_base, min(d) FILTER (base) AS first_word, max(d) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM rows_ LEFT JOIN sums USING (r)
"""
