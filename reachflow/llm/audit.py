"""Audit of how filters interact: what each of them removes in every order.

A document's failures are a row of a mask matrix: 0 where it fails a filter, beyond all steps where it passes. An order
is a row of the inverse permutation, the position of each filter. Their min-plus product, the least sum over the filters, is
the step that removes the document in that order. Documents of equal masks are counted first, so that the product is one of
at most 2 ** n masks with n! orders, whatever the number of documents; its steps scatter the counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.llm import common

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words, and the characters that condition D looks for.
SPACE, SIGNS = r"[\x20\x09-\x0D]+", "[#$%&*|]"
FILTERS = "ABCDE"


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text (not null) with these words fails A, B, C, D."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long")
    return [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text).cast("long"), text.rlike(SIGNS)]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (a bit for each filter that fails), n, good, toxic: how many documents of each part fail which filters.

    Each row is a document; a null text counts as empty, a null lang as the empty part. Identical are texts of equal
    SHA-256. A row without a doc_id is never later than another one and is no earlier document either: it passes E; rows
    that repeat both id and text are not earlier than each other. A document is good or toxic if any row of labels with its id
    says so. Other columns are left out.

    Equal rows are counted before anything is joined, and equal texts by their counts alone, so that no group of copies
    meets in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    bits = sum(F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("text"), F.col("words"))))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))
    rows = rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    told = rows.where("doc_id is not null").join(known, "doc_id", "left").select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    told = told.union(rows.where("doc_id is null").select("*", F.lit(False), F.lit(False)))
    # The same id and text may stand in rows of several parts: none of them is the earlier one.
    kind = ["digest", "part", "bits", "good", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    classes = told.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least)
    # A text has one row for each part and label here.
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    classes = classes.withColumn("earlier", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    sides = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("earlier").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("earlier")).alias("n")))).alias("side")
    count = lambda c: F.sum(F.when(F.col(c), F.col("side.n")).otherwise(0)).alias(c)
    return classes.select("part", "good", "toxic", sides).groupBy("part", "side.mask").agg(F.sum("side.n").alias("n"), count("good"), count("toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of each step of every order, from counts (part, mask, n, good, toxic).

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley are longs, zeros included; parts are those of
    counts, so that an empty table has no rows. The filters are letters, bit k of a mask stands for the k-th.
    """
    size = len(filters)
    orders = ["".join(p) for p in permutations(filters)]
    literal = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.array(*[F.lit(o.index(f)) for f in filters]).alias("position")) for o in orders])
    costs = F.array(*[F.when(F.col("mask").bitwiseAND(1 << k) != 0, 0).otherwise(size) for k in range(size)])
    masks_ = common.written(counts).select("part", "mask", "n", "good", "toxic", costs.alias("cost"))
    ranked = masks_.select("*", F.explode(literal).alias("order")).select("*", "order.filter_order", F.array_min(F.zip_with("cost", "order.position", lambda c, p: c + p)).alias("removal"))
    steps = ranked.select("part", "mask", "n", "good", "toxic", "filter_order", "removal", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("at"))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.substring("filter_order", F.col("at") + 1, F.lit(1)))
    steps = steps.withColumn("bit", bit)
    fails, here = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("removal") == F.col("at")
    total = lambda condition, c, name: F.sum(F.when(condition, F.col(c)).otherwise(0)).cast("long").alias(name)
    found = steps.groupBy("part", "filter_order", "at", "bit").agg(
        total(F.col("removal") > F.col("at"), "n", "kept"), total(here, "n", "removed"), total(fails & (F.col("removal") < F.col("at")), "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"), total(here, "good", "good_lost"), total(here, "toxic", "toxic_lost"),
    )
    share = F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long").alias("shapley")
    return found.select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", share)


def oracle() -> str:
    """The same rows in SQL, from every document's failures."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS lo FROM d),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > lo, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.c || b.c || x.c || y.c || z.c AS o FROM letters a, letters b, letters x, letters y, letters z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
s AS (SELECT part, o, step, fails, n, good, toxic, ascii(o[step]) - 64 AS k, coalesce(list_min(list_filter(range(1, 6), lambda i: fails[ascii(o[i]) - 64])), 9) AS gone FROM g, orders, range(1, 6) steps(step)),
c AS (SELECT part, o, step, k, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails[k] AND gone < step THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[k] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM c
"""
