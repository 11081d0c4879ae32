"""Further integrity constraints, of roots, shapes, paths, slots, rules and meaning; every row is a violation (check, key, detail).

All of them are joins and grouped counts. Null keys meet nothing: a null reference is a violation of its `known` check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.operators.checks import together, violation
from reachflow.operators.closure import contributor_union
from reachflow.operators.diffs import set_difference


def unknown(rows: DataFrame, column: str, known: DataFrame, key: str, check: str) -> DataFrame:
    """Rows whose column names nothing in known (key)."""
    names = known.select(F.col(key).alias("u_known")).distinct()
    return violation(rows.join(names, F.col(column) == F.col("u_known"), "left_anti"), check, F.col(column))


def not_once(rows: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Keys that several rows have."""
    return violation(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), check, F.concat_ws("/", *keys), F.col("n"))


def roots(listed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """listed (node): one at least, each once, known, and without an edge that leads to it; nodes (node), edges (src, dst)."""
    return together([
        violation(listed.agg(F.count("*").alias("n")).where("n = 0"), "some root", F.lit("roots")),
        not_once(listed, ["node"], "root once"),
        unknown(listed, "node", nodes, "node", "known root"),
        violation(listed.select("node").distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_semi"), "root without parents", F.col("node")),
    ])


def node_shapes(nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """nodes (node, tag, args: their number) against shapes (tag, least, most): a dimension of a few rows."""
    rows = nodes.join(shapes, "tag", "left")
    return together([
        violation(rows.where("least is null"), "known tag", F.col("node"), F.col("tag")),
        violation(rows.where("args < least or args > most"), "number of arguments", F.col("node"), F.col("args")),
    ])


def instances(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """nodes (node, definition, args) against definitions (definition, arity): known, and as many arguments as it takes."""
    rows = nodes.join(definitions, "definition", "left")
    return together([
        violation(rows.where("arity is null"), "known definition", F.col("node"), F.col("definition")),
        violation(rows.where("args <> arity"), "arguments of the definition", F.col("node"), F.col("args")),
    ])


def allocation_paths(links: DataFrame, parents: DataFrame) -> DataFrame:
    """links (node, parent, ordinal), parents (parent, fan_out): one parent a node, one link an ordinal, ordinals from 0 below the fan-out."""
    several = links.groupBy("node").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi")).where("lo <> hi")
    rows = links.join(parents, "parent", "left")
    return together([
        violation(several, "one parent", F.col("node"), F.col("hi")),
        not_once(links.select("parent", "ordinal", "node").distinct(), ["parent", "ordinal"], "ordinal once"),
        violation(rows.where("fan_out is null or ordinal < 0 or ordinal >= fan_out"), "ordinal below fan-out", F.col("node"), F.col("ordinal")),
    ])


def matched_once(edges: DataFrame, partners: DataFrame, keys: list[str], excepted: Column) -> DataFrame:
    """Edges that don't have exactly one partner of equal keys, but for the excepted ones."""
    n = partners.groupBy(*keys).agg(F.count("*").alias("n"))
    found = edges.where(~excepted).join(n, keys, "left").where("coalesce(n, 0) <> 1")
    return violation(found, "one partner", F.concat_ws("/", *keys), F.coalesce("n", F.lit(0)))


def entries_in_lists(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """entries (list_id, i, start, end), lists (list_id, list_start, list_end): known list, inside it, in order and apart from each other."""
    rows = entries.join(lists, "list_id", "left")
    before = F.max("end").over(Window.partitionBy("list_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    name = F.concat_ws("/", "list_id", "i")
    return together([
        violation(rows.where("list_start is null"), "known list", name),
        violation(rows.where("start < list_start or end > list_end"), "entry within list", name),
        violation(entries.withColumn("i_before", before).where("start < i_before"), "entries apart", name),
    ])


def slots_in_templates(slots: DataFrame, templates: DataFrame) -> DataFrame:
    """slots (slot, template, start, end, parent_slot), templates (template, t_start, t_end): inside a known template, below a slot of the same one."""
    rows = slots.join(templates, "template", "left")
    above = slots.select(F.col("slot").alias("parent_slot"), F.col("template").alias("p_template")).distinct()
    nested = slots.where("parent_slot is not null").join(above, "parent_slot", "left")
    return together([
        violation(rows.where("t_start is null"), "known template", F.col("slot"), F.col("template")),
        violation(rows.where("start < t_start or end > t_end"), "slot within template", F.col("slot")),
        violation(nested.where("p_template is null or p_template <> template"), "parent of the same template", F.col("slot"), F.col("parent_slot")),
    ])


def repetitions(reps: DataFrame, elements: DataFrame) -> DataFrame:
    """reps (rep_id, least, most), elements (rep_id): as many elements as the bounds allow (null: no bound), none of an unknown repetition."""
    n = reps.join(elements.groupBy("rep_id").agg(F.count("*").alias("n")), "rep_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return together([
        violation(n.where("n < least"), "too few elements", F.col("rep_id"), F.col("n")),
        violation(n.where("n > most"), "too many elements", F.col("rep_id"), F.col("n")),
        unknown(elements, "rep_id", reps, "rep_id", "known repetition"),
    ])


def capture_slots(slots: DataFrame, inputs: DataFrame) -> DataFrame:
    """slots (slot), inputs (slot): every slot has an input, every input a known slot."""
    return together([
        violation(slots.join(inputs.select("slot"), "slot", "left_anti"), "slot has an input", F.col("slot")),
        unknown(inputs, "slot", slots, "slot", "known slot"),
    ])


def macro_rules(rules: DataFrame, selected: DataFrame) -> DataFrame:
    """rules (macro, rule, ordinal), selected (macro, rule): ordinals from 0 without gaps in each macro; a selected rule is one of its macro's."""
    place = F.row_number().over(Window.partitionBy("macro").orderBy("ordinal", "rule")) - 1
    return together([
        violation(rules.withColumn("place", place).where("place <> ordinal"), "rules contiguous", F.concat_ws("/", "macro", "rule"), F.col("ordinal")),
        violation(selected.join(rules.select("macro", "rule"), ["macro", "rule"], "left_anti"), "selected rule of its macro", F.concat_ws("/", "macro", "rule")),
    ])


def externals(facts: DataFrame, loaded: DataFrame) -> DataFrame:
    """facts (path, crate), loaded (crate): every path once, in a crate that is loaded exactly once."""
    n = facts.join(loaded.groupBy("crate").agg(F.count("*").alias("n")), "crate", "left").where("coalesce(n, 0) <> 1")
    return together([not_once(facts, ["path"], "path once"), violation(n, "one crate", F.col("path"), F.coalesce("n", F.lit(0)))])


def opaque_edges(edges: DataFrame, root: DataFrame, sites: DataFrame, owners: DataFrame) -> DataFrame:
    """edges (edge, dst) lead to root (node); their sites (edge, owner, start, end), one at least, lie within owners (owner, o_start, o_end)."""
    rows = sites.join(owners, "owner", "left")
    return together([
        violation(edges.join(root.select(F.col("node").alias("dst")), "dst", "left_anti"), "leads to the root", F.col("edge"), F.col("dst")),
        violation(edges.join(sites.select("edge"), "edge", "left_anti"), "edge has a site", F.col("edge")),
        violation(rows.where("o_start is null or start < o_start or end > o_end"), "site within owner", F.col("edge"), F.col("owner")),
    ])


def products(members: DataFrame, groups: DataFrame, group_roots: DataFrame) -> DataFrame:
    """members (product, mgroup), groups (mgroup), group_roots (mgroup): one known group a product, a root for each group."""
    return together([
        not_once(members.distinct(), ["product"], "one group a product"),
        unknown(members, "mgroup", groups, "mgroup", "known group"),
        violation(groups.join(group_roots, "mgroup", "left_anti"), "group has a root", F.col("mgroup")),
    ])


def permitted_provenance(local: DataFrame, parents: DataFrame, permitted: DataFrame) -> DataFrame:
    """Units of a set, or of those above it, that permitted (unit_id) lacks; local (set_id, unit_id), parents (set_id, parent_set_id)."""
    found = contributor_union(local, parents).join(permitted.select("unit_id").distinct(), "unit_id", "left_anti")
    return violation(found, "permitted unit", F.col("set_id"), F.col("unit_id"))


def output_meaning(outputs: DataFrame, meanings: DataFrame) -> DataFrame:
    """outputs (output, class), meanings (class): every output has a class, every class that occurs a meaning."""
    used = outputs.where("class is not null")
    return together([
        violation(outputs.where("class is null"), "output has a class", F.col("output")),
        violation(used.select("class").distinct().join(meanings, "class", "left_anti"), "class has a meaning", F.col("class")),
    ])


def ancestor_sets(claimed: DataFrame, closed: DataFrame) -> DataFrame:
    """claimed and closed (unit, ancestor): pairs that stand on one side only."""
    return violation(set_difference(closed.select("unit", "ancestor"), claimed.select("unit", "ancestor")), "ancestor set", F.concat_ws(">", "unit", "ancestor"), F.col("side"))


def sites_match(kind: Column, own: Column, other: Column) -> Column:
    """Whether two arrays of sites match: a direct call's are contained in the other's, any other kind's are the same ones."""
    inside = F.forall(own, lambda x: F.array_contains(other, x))
    return F.when(kind == "DirectCall", inside).otherwise(inside & F.forall(other, lambda x: F.array_contains(own, x)))
