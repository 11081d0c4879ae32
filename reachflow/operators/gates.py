"""Rules with several conditions: gated edges, requirements, conjunctions and alternatives, run to their fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachflow.operators.closure import reachable
from reachflow.sources.scratch import Rounds, keyed, written


def site_states(sites: DataFrame, kept: DataFrame) -> DataFrame:
    """edge, site, whole, some: whether all, and whether any, of a site's owners are kept; sites (edge, site, owner), kept (owner)."""
    marked = sites.join(kept.select("owner", F.lit(True).alias("in")).distinct(), "owner", "left")
    return marked.groupBy("edge", "site").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("whole"), F.bool_or(F.coalesce("in", F.lit(False))).alias("some"))


def open_edges(edges: DataFrame, sites: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges (edge, src, dst, ...) without sites, and those with a site of which every owner is kept."""
    states = site_states(sites, kept).groupBy("edge").agg(F.bool_or("whole").alias("opened"))
    return edges.join(states, "edge", "left").where("opened is null or opened").drop("opened")


def gated_reachable(edges: DataFrame, sites: DataFrame, kept: DataFrame, roots: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """node: what the roots reach along open edges whose end isn't lost."""
    steps = open_edges(edges, sites, kept)
    if lost is not None:
        steps = steps.join(lost.select(F.col("node").alias("dst")), "dst", "left_anti")
    return reachable(steps, roots)


def partial_sites(edges: DataFrame, sites: DataFrame, kept: DataFrame, reached: DataFrame) -> DataFrame:
    """edge, site: violations, sites with some but not all owners kept on an edge from a reached node that no site opens."""
    states = site_states(sites, kept)
    shut = states.groupBy("edge").agg(F.bool_or("whole").alias("opened")).where("not opened").select("edge")
    asked = edges.join(reached.withColumnRenamed("node", "src"), "src", "left_semi").join(shut, "edge", "left_semi").select("edge")
    return states.where("some and not whole").join(asked, "edge", "left_semi").select("edge", "site")


def derive_requirements(influences: DataFrame, helpers: DataFrame) -> DataFrame:
    """trigger, required: the influences and, both ways, each helper's attribute and provider; for required()'s single rules.

    influences (trigger, required), helpers (attribute, provider). Rows with a null are left out, repeated ones count once.
    """
    there = helpers.select(F.col("attribute").alias("trigger"), F.col("provider").alias("required"))
    back = helpers.select(F.col("provider").alias("trigger"), F.col("attribute").alias("required"))
    return influences.select("trigger", "required").union(there).union(back).where("trigger is not null and required is not null").distinct()


def required(kept: DataFrame, single: DataFrame, double: DataFrame, groups: DataFrame) -> DataFrame:
    """unit: the least set with kept in which every rule holds.

    single (trigger, required); double (left_unit, right_unit, required): both ask for the third; groups (unit,
    group_id): any member asks for all. Each round takes the consequences of the units that are new.
    """
    single, groups = keyed(single, "trigger"), written(groups.select("unit", "group_id"))
    double = written(double.select("left_unit", "right_unit", "required"))
    found = Rounds()
    new = found.add(kept.select("unit").distinct())
    while not new.isEmpty():
        every = found.every()
        by_one = single.join(new.withColumnRenamed("unit", "trigger"), "trigger", "left_semi").select(F.col("required").alias("unit"))
        left = double.join(new.withColumnRenamed("unit", "left_unit"), "left_unit", "left_semi").join(every.withColumnRenamed("unit", "right_unit"), "right_unit", "left_semi")
        right = double.join(new.withColumnRenamed("unit", "right_unit"), "right_unit", "left_semi").join(every.withColumnRenamed("unit", "left_unit"), "left_unit", "left_semi")
        touched = groups.join(new, "unit", "left_semi").select("group_id").distinct()
        whole = groups.join(touched, "group_id", "left_semi").select("unit")
        fresh = by_one.union(left.select("required")).union(right.select("required")).union(whole).where("unit is not null").distinct()
        new = found.add(fresh.join(every, "unit", "left_anti"))
    return found.every()


def fired(facts: DataFrame, rules: DataFrame, body: DataFrame) -> DataFrame:
    """fact: the least set with facts closed under the rules.

    rules (rule, head). body (rule, fact, kind): kind `all` must every one hold, of kind `any` one at least if there
    is one. A rule without a body holds at once. Counts of what still lacks decide, on the rules that new facts touch.
    """
    need = rules.join(body.where("kind = 'all'").distinct().groupBy("rule").agg(F.count("*").alias("need")), "rule", "left").join(body.where("kind = 'any'").select("rule", F.lit(True).alias("choice")).distinct(), "rule", "left")
    need = written(need.select("rule", "head", F.coalesce("need", F.lit(0)).alias("need"), F.coalesce("choice", F.lit(False)).alias("choice")))
    body = keyed(body.select("rule", "fact", "kind").distinct(), "fact")
    at_once = need.where("need = 0 and not choice").select(F.col("head").alias("fact"))
    found = Rounds()
    fresh = found.add(facts.select("fact").union(at_once).distinct())
    while not fresh.isEmpty():
        touched = body.join(fresh, "fact", "left_semi").select("rule").distinct()
        held = body.join(touched, "rule", "left_semi").join(found.every(), "fact", "left_semi")
        state = held.groupBy("rule").agg(F.count_if(F.col("kind") == "all").alias("have"), F.bool_or(F.col("kind") == "any").alias("chosen"))
        heads = need.join(state, "rule").where("have = need and (chosen or not choice)").select(F.col("head").alias("fact")).distinct()
        fresh = found.add(heads.join(found.every(), "fact", "left_anti"))
    return found.every()


def complete_sets(kept: DataFrame, local: DataFrame, parents: DataFrame) -> DataFrame:
    """set_id: contributor sets of which all local units are kept and all parents complete (local: set_id, unit; parents: set_id, parent_set_id)."""
    sets = local.select("set_id").union(parents.select("set_id")).union(parents.select("parent_set_id")).distinct()
    rules = sets.select(F.col("set_id").alias("rule"), F.concat(F.lit("s"), "set_id").alias("head"))
    of_units = local.select(F.col("set_id").alias("rule"), F.concat(F.lit("u"), "unit").alias("fact"), F.lit("all").alias("kind"))
    of_sets = parents.select(F.col("set_id").alias("rule"), F.concat(F.lit("s"), "parent_set_id").alias("fact"), F.lit("all").alias("kind"))
    found = fired(kept.select(F.concat(F.lit("u"), "unit").alias("fact")), rules, of_units.union(of_sets))
    return rules.join(found.withColumnRenamed("fact", "head"), "head", "left_semi").select(F.col("rule").alias("set_id"))
