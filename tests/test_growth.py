"""Plans whose work has to grow with the input and no faster, and what they give."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from reachflow.operators import diffs, lexing, rewriting, spans
from reachflow.plans import catalogue


def test_long_lists_take_linear_time(spark):
    n = 120_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("source_id"), F.lit(0).alias("list_id"), F.col("id").alias("i"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 1).alias("end"))
    began = time.time()
    found = rewriting.list_deletions(rows, F.col("i") >= n - 2).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == [(2 * n - 5, 2 * n - 3), (2 * n - 3, 2 * n - 1)]
    assert time.time() - began < 60


def test_deletions_in_long_texts_take_linear_time(spark):
    n = 30_000
    tokens = lexing.tokens(spark.createDataFrame([(1, "a b " * n)], "source_id long, text string"))
    gone = tokens.where("kind = 'space' and start % 20 = 1").select("source_id", F.col("start").alias("deletion_id"), "start", "end")
    began = time.time()
    assert lexing.disturbing(tokens, gone).count() == n // 5
    assert time.time() - began < 40


def test_empty_spans_at_the_end_of_another(spark):
    """Within means both ends included, wherever cells of the other begin and end."""
    outer = spark.createDataFrame([(1, 0, e) for e in (3, 16, 17, 255, 256, 4096)], "source_id long, start long, end long")
    inner = spark.createDataFrame([(1, e, e) for e in (3, 16, 17, 255, 256, 4096)], "source_id long, start long, end long")
    met = {(r["end"], r["o_end"]) for r in spans.containing(inner, outer).collect()}
    ends = (3, 16, 17, 255, 256, 4096)
    assert met == {(a, b) for a in ends for b in ends if a <= b}


def test_points_look_up_used_sizes_only(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("source_id"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 7).alias("end"))
    assert spans._sizes(rows) == [4]
    assert spans.overlapping(rows, rows).count() == 1000 + 2 * 999


def test_earlier_keys_are_ranks(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    found = catalogue.j23_earlier_rules(spark, str(tmp_path)).agg(F.count("*"), F.sum("n_earlier")).first()
    assert tuple(found) == (19_999, 19_999 * 20_000 // 2)
    assert time.time() - began < 20


def test_differences_are_one_aggregate(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,), (None,)], "k long")
    found = diffs.set_difference(a, b)
    assert {tuple(r) for r in found.collect()} == {(1, "missing"), (3, "extra")}
    assert "replicaterows" not in found._jdf.queryExecution().toString().lower()


def test_flags_of_inner_elements(spark):
    rows = [(1, "a", None, False, 0, 20, None, None), (1, "b", "a", False, 0, 9, None, 10), (1, "x", "b", True, 0, 4, None, 5), (1, "y", "b", True, 5, 9, 4, None), (1, "z", "a", True, 10, 20, 9, None)]
    elements = spark.createDataFrame(rows, "source_id long, node string, parent string, leaf boolean, start long, end long, ahead long, behind long")
    cut = lambda *kept: {tuple(r) for r in rewriting.nested_deletions(elements, spark.createDataFrame([(k,) for k in kept], "node string")).collect()}
    assert cut("z") == {(1, 0, 10)}
    assert cut("y") == {(1, 0, 5), (1, 9, 20)}
    assert cut() == {(1, 0, 20)}
    assert cut("x", "y", "z") == set()
