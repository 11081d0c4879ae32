"""Integrity constraints as queries: every row is a violation (check, key, detail); a sound input gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.operators.closure import cyclic_nodes, reachable


def violation(rows: DataFrame, check: str, key: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def definition_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, parent_id, key array), edges (src, dst, kind, n_sites): one root, unique keys that extend the parent's, known ends, sites."""
    key = F.to_json("key")
    parents = nodes.select(F.col("id").alias("p_id"), F.col("key").alias("p_key"))
    below = nodes.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("p_id"), "left")
    extends = (F.size("key") == F.size("p_key") + 1) & (F.slice("key", 1, F.size("p_key")) == F.col("p_key"))
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return together([
        violation(nodes.where("parent_id is null").agg(F.count("*").alias("n")).where("n <> 1"), "one root", F.lit("roots"), F.col("n")),
        violation(nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "unique key", key, F.col("n")),
        violation(nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "unique id", F.col("id"), F.col("n")),
        violation(below.where("p_id is null"), "known parent", F.col("id"), F.col("parent_id")),
        violation(below.where(F.col("p_id").isNotNull() & ~extends), "key extends parent", F.col("id"), key),
        violation(ends.distinct().join(nodes.select("id"), "id", "left_anti"), "known end", F.col("id")),
        violation(edges.where("kind <> 'parent' and n_sites = 0"), "edge has a site", F.concat_ws(">", "src", "dst"), F.col("kind")),
    ])


def endpoint_types(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """edges (src_tag, dst_tag, kind, n_sites) of a shape that shapes (kind, src_tag, dst_tag, site_optional) doesn't have, or that lack a needed site.

    shapes is a dimension of a few rows for each kind.
    """
    known = edges.join(shapes, ["kind", "src_tag", "dst_tag"], "left")
    return together([
        violation(known.where("site_optional is null"), "endpoint types", F.col("kind"), F.concat_ws(">", "src_tag", "dst_tag")),
        violation(known.where("not site_optional and n_sites = 0"), "site needed", F.col("kind"), F.concat_ws(">", "src_tag", "dst_tag")),
    ])


def all_reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root leads to."""
    return violation(nodes.select("node").join(reachable(edges, roots), "node", "left_anti"), "reachable", F.col("node"))


def acyclic(forest: DataFrame) -> DataFrame:
    """Nodes on or below a cycle of one parent relation."""
    return violation(cyclic_nodes(forest), "acyclic", F.col("node"))


def parent_links(links: DataFrame, edges: DataFrame) -> DataFrame:
    """links (node, parent) and edges (node, parent): exactly one edge for each link, none otherwise."""
    a, b = links.where("parent is not null").groupBy("node", "parent").agg(F.count("*").alias("n_links")), edges.groupBy("node", "parent").agg(F.count("*").alias("n_edges"))
    both = a.join(b, ["node", "parent"], "full").select("node", "parent", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    return violation(both.where("n_edges <> 1 or n_links = 0"), "one edge a link", F.concat_ws(">", "node", "parent"), F.col("n_edges"))


def unique_slots(relations: DataFrame, keys: list[str]) -> DataFrame:
    return violation(relations.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "unique slot", F.concat_ws("/", *keys), F.col("n"))


def contiguous(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) - 1
    return violation(rows.withColumn("place", place).where(F.col("place") != F.col(ordinal)), "contiguous ordinals", F.concat_ws("/", *keys), F.col(ordinal))


def implied(relations: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """Relations (keys, ordinal, target) that differ from those that payload (keys, targets array) implies, in order."""
    wanted = payload.select(*keys, F.posexplode("targets").alias("ordinal", "wanted"))
    both = relations.select(*keys, F.col("ordinal").cast("int").alias("ordinal"), "target").join(wanted, [*keys, "ordinal"], "full")
    return violation(both.where("not (target <=> wanted)"), "implied relations", F.concat_ws("/", *keys, "ordinal"), F.col("wanted"))


def unit_inventory(units: DataFrame, sources: DataFrame) -> DataFrame:
    """units (source_id, unit_id, parent_id, start, end, active), sources (source_id, byte_len): one root over the text, nesting, inactive below inactive."""
    roots = units.where("parent_id is null")
    per = sources.join(roots.groupBy("source_id").agg(F.count("*").alias("n"), F.min("start").alias("s"), F.max("end").alias("e")), "source_id", "left")
    p = units.select(F.col("source_id").alias("p_source"), F.col("unit_id").alias("p_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("active").alias("p_active"))
    below = units.where("parent_id is not null").join(p, (F.col("source_id") == F.col("p_source")) & (F.col("parent_id") == F.col("p_id")), "left")
    name = F.concat_ws("/", "source_id", "unit_id")
    return together([
        violation(per.where("n is null or n <> 1"), "one root", F.col("source_id"), F.coalesce("n", F.lit(0))),
        violation(per.where("n = 1 and (s <> 0 or e <> byte_len)"), "root covers text", F.col("source_id"), F.col("e")),
        violation(below.where("p_id is null"), "known parent", name, F.col("parent_id")),
        violation(below.where("start < p_start or end > p_end"), "child within parent", name),
        violation(below.where("active and not p_active"), "inactive below inactive", name),
        violation(units.where("start > end or start < 0"), "ordered span", name),
    ])


def partition_of_text(pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """pieces (source_id, start, end): each begins where the one before ends, the first at 0, the last ends with the text."""
    w = Window.partitionBy("source_id").orderBy("start", "end")
    marked = pieces.withColumn("v_before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    ends = sources.join(pieces.groupBy("source_id").agg(F.max("end").alias("e")), "source_id", "left")
    return together([
        violation(marked.where("start <> v_before"), "pieces touch", F.concat_ws("/", "source_id", "start"), F.col("v_before")),
        violation(ends.where("coalesce(e, 0) <> byte_len"), "pieces cover text", F.col("source_id"), F.col("e")),
    ])


def group_partition(units: DataFrame, groups: DataFrame) -> DataFrame:
    """Every unit (unit) is in exactly one group (unit, group_id)."""
    n = units.select("unit").join(groups.groupBy("unit").agg(F.count("*").alias("n")), "unit", "left")
    return together([
        violation(n.where("coalesce(n, 0) <> 1"), "one group a unit", F.col("unit"), F.coalesce("n", F.lit(0))),
        violation(groups.join(units.select("unit"), "unit", "left_anti"), "known unit", F.col("unit"), F.col("group_id")),
    ])


def closed_retention(kept: DataFrame, parents: DataFrame, groups: DataFrame, root: DataFrame) -> DataFrame:
    """kept (unit), parents (unit, parent), groups (unit, group_id), root (unit): the root and all parents are kept, groups wholly or not at all."""
    kept = kept.select("unit").distinct()
    state = groups.select("unit", "group_id").distinct().join(kept.withColumn("in", F.lit(1)), "unit", "left").groupBy("group_id").agg(F.count("*").alias("n"), F.count("in").alias("k"))
    return together([
        violation(root.join(kept, "unit", "left_anti"), "root kept", F.col("unit")),
        violation(parents.where("parent is not null").join(kept, "unit", "left_semi").join(kept.withColumnRenamed("unit", "parent"), "parent", "left_anti"), "parent kept", F.col("unit"), F.col("parent")),
        violation(state.where("k > 0 and k < n"), "whole group", F.col("group_id"), F.col("k")),
    ])


def some_member_kept(owners: DataFrame, members: DataFrame, kept: DataFrame) -> DataFrame:
    """Every kept owner (unit) keeps a member at least; members (owner, unit)."""
    live = members.join(kept, "unit", "left_semi").select(F.col("owner").alias("unit")).distinct()
    return violation(owners.join(kept, "unit", "left_semi").join(live, "unit", "left_anti"), "a member kept", F.col("unit"))


def classified(members: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Every member has exactly one class row."""
    n = members.select(*keys).distinct().join(classes.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
    return violation(n.where("coalesce(n, 0) <> 1"), "one class", F.concat_ws("/", *keys), F.coalesce("n", F.lit(0)))
