"""Sets of contributors as interned nodes, what is complete or means something through them, closures of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachflow.operators.closure import levels, reachable
from reachflow.operators.gates import complete_sets
from reachflow.sources.scratch import Rounds, keyed, written


def interned(nodes: DataFrame, local: DataFrame, parents: DataFrame) -> DataFrame:
    """node, set_id: nodes have one set_id exactly if they hold the same units and their parents the same sets.

    nodes (node), local (node, unit), parents (node, parent), without cycles; repeated rows count once. The least node of
    a set is its id, so that no numbers have to be dealt. Level by level, parents first, whole sorted lists are compared,
    not only hashes of them; a level is one shuffle, whatever its size.
    """
    every = nodes.select("node").union(local.select("node")).union(parents.select("node")).union(parents.select(F.col("parent").alias("node"))).where("node is not null").distinct()
    placed = levels(parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")), every)
    units = local.groupBy("node").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    own = written(placed.join(units, "node", "left").select("node", "level", F.coalesce("units", F.array().cast(units.schema["units"].dataType)).alias("units")))
    above = written(parents.select("node", "parent").distinct())
    done: list[DataFrame] = []
    for level in sorted(r["level"] for r in own.select("level").distinct().collect()):  # one number for each level
        here = own.where(F.col("level") == level)
        if done:
            known = reduce(DataFrame.union, done).withColumnRenamed("node", "parent")
            sets = above.join(here.select("node"), "node", "left_semi").join(known, "parent").groupBy("node").agg(F.array_sort(F.collect_set("set_id")).alias("sets"))
            here = here.join(sets, "node", "left")
        else:
            here = here.withColumn("sets", F.array().cast(f"array<{own.schema['node'].dataType.simpleString()}>"))
        here = here.withColumn("sets", F.coalesce("sets", F.array().cast(here.schema["sets"].dataType)))
        ids = here.groupBy("units", "sets").agg(F.min("node").alias("set_id"))
        done.append(written(here.join(ids, ["units", "sets"]).select("node", "set_id")))
    return reduce(DataFrame.union, done) if done else every.select("node", F.col("node").alias("set_id"))


def materialized(kept: DataFrame, local: DataFrame, parents: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id: groups (group_id, set_id) of which all sets are complete: their units kept (unit), their parents complete."""
    complete = complete_sets(kept, local, parents)
    return groups.select("group_id").distinct().join(groups.join(complete, "set_id", "left_anti"), "group_id", "left_anti")


def conditional_members(kept: DataFrame, rules: DataFrame) -> DataFrame:
    """lane, unit: what left and right units of one lane require, rules (lane, left_unit, right_unit, required), kept (lane, unit).

    Lanes don't see each other's units. Rounds look at the rules that new units touch, until none adds one.
    """
    # A rule that stands twice tells nothing new: rules are never held to tell them apart.
    rules, found = written(rules), written(kept.select("lane", "unit").where("unit is not null").distinct())
    fresh = found
    while not fresh.isEmpty():
        touched = rules.join(fresh.withColumnRenamed("unit", "left_unit"), ["lane", "left_unit"], "left_semi").union(rules.join(fresh.withColumnRenamed("unit", "right_unit"), ["lane", "right_unit"], "left_semi"))
        both = touched.join(found.withColumnRenamed("unit", "left_unit"), ["lane", "left_unit"], "left_semi").join(found.withColumnRenamed("unit", "right_unit"), ["lane", "right_unit"], "left_semi")
        fresh = written(both.select("lane", F.col("required").alias("unit")).distinct().join(found, ["lane", "unit"], "left_anti"))
        found = written(found.union(fresh))
    return found


def original_snapshot(edges: DataFrame, roots: DataFrame, definitions: DataFrame, permitted: DataFrame, sites: DataFrame, surviving: DataFrame) -> DataFrame:
    """node: what the permitted definitions and the roots reach along edges whose sites survive, entering permitted nodes only.

    edges (src, dst, edge_id), sites (edge_id, site), surviving (site). An edge without a site or an id always counts, one with
    sites if any of them survives. Nodes are looked up in the permitted ones when they are reached, not for every edge.
    """
    lives = surviving.select("site", F.lit(True).alias("lives")).distinct()
    dead = sites.join(lives, "site", "left").where("edge_id is not null").groupBy("edge_id").agg(F.max("lives").alias("lives")).where("lives is null").select("edge_id")
    some = edges.where("src is not null and dst is not null")
    hashed = F.xxhash64("edge_id").alias("h")  # sorted by one number, whatever ids are made of
    gated = some.where("edge_id is not null").select("src", "dst", "edge_id", hashed).join(dead.select("edge_id", hashed), ["h", "edge_id"], "left_anti")
    open_ = some.where("edge_id is null").select("src", "dst").union(gated.select("src", "dst"))
    entered = keyed(permitted.select("node"), "node")
    seeds = definitions.select("node").join(entered, "node", "left_semi")
    return reachable(open_, seeds.union(roots.select("node")).distinct(), entered=entered)


def reduced_snapshot(edges: DataFrame, roots: DataFrame, definitions: DataFrame, outputless: DataFrame) -> DataFrame:
    """node: what the definitions and roots reach along edges, without the outputless nodes and what only they lead to."""
    none = outputless.select("node").distinct()
    open_ = edges.join(none.withColumnRenamed("node", "src"), "src", "left_anti").join(none.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return reachable(open_, definitions.select("node").union(roots.select("node")).distinct().join(none, "node", "left_anti"))


def outputless(candidates: DataFrame, meaning: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """node: candidates that mean nothing in the output; with kept, of those that a rewrite keeps."""
    own = candidates if kept is None else candidates.join(kept, "node", "left_semi")
    return own.select("node").distinct().join(meaning, "node", "left_anti")


def childless_or_none(candidates: DataFrame, children: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates (node) if none has a child (parent) or a generated edge (src), else nothing; and those that have."""
    busy = children.select(F.col("parent").alias("node")).union(generated.select(F.col("src").alias("node"))).distinct()
    rejected = written(candidates.join(busy, "node", "left_semi").select("node").distinct())
    return candidates.select("node").distinct().where(F.lit(rejected.isEmpty())), rejected


def reachable_modes(edges: DataFrame, roots: DataFrame, modes: list[str]) -> DataFrame:
    """node, mode: the strongest mode in which each node is evaluated; modes from the strongest to the weakest.

    roots (node, mode), edges (src, dst, cap): an edge hands on the weaker of its source's mode and its cap. A node evaluated
    in a stronger mode is not entered again in a weaker one, which that one covers. Edges are written once, by source, for all modes.
    """
    rank = F.create_map(*[x for k, m in enumerate(modes) for x in (F.lit(m), F.lit(k))])
    steps = keyed(edges.select("src", "dst", F.element_at(rank, F.col("cap")).alias("cap")).where("src is not null and dst is not null and cap is not null"), "src")
    seeds = written(roots.select("node", F.element_at(rank, F.col("mode")).alias("k")).where("node is not null"))
    found = Rounds()
    for k, mode in enumerate(modes):
        start = seeds.where(F.col("k") == k).select("node").distinct()
        if k:
            # Stronger nodes have gone along their stronger edges; those capped at this mode are left.
            weaker = steps.where(F.col("cap") == k).join(found.every().select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
            start = start.union(weaker).distinct().join(found.every(), "node", "left_anti")
        fresh = found.add(start.select("node", F.lit(mode).alias("mode")))
        while not fresh.isEmpty():
            reached = steps.where(F.col("cap") <= k).join(fresh.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
            fresh = found.add(reached.join(found.every(), "node", "left_anti").select("node", F.lit(mode).alias("mode")))
    return found.every()
