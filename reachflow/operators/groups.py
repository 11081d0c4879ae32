"""Grouping of edges and facts: unions of sites, merges that must agree, counts, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_edges(edges: DataFrame, keys: list[str], site: str = "site", evidence: str | None = None) -> DataFrame:
    """keys, sites (sorted, distinct, without null), n_sites; with evidence: the single one, else `Multiple`."""
    sites = F.array_sort(F.collect_set(site)).alias("sites")
    # The size of the set and the least and greatest evidence say it in one aggregate, where distinct counts would expand each row.
    out = [sites]
    if evidence:
        out.append(F.when(F.min(evidence) < F.max(evidence), F.lit("Multiple")).otherwise(F.max(evidence)).alias("evidence"))
    grouped = edges.groupBy(*keys).agg(*out)
    return grouped.select(*keys, "sites", F.size("sites").cast("long").alias("n_sites"), *(["evidence"] if evidence else []))


def merged(rows: DataFrame, keys: list[str], optional: list[str], owner: str) -> tuple[DataFrame, DataFrame]:
    """Rows of equal keys as one: nulls of the optional columns are filled from the others, owners collected.

    The second frame has the keys whose optional values conflict; those are not merged.
    """
    least = [F.min(c).alias(f"n_{c}") for c in optional]
    values = [F.max(c).alias(c) for c in optional]
    every = rows.groupBy(*keys).agg(*values, *least, F.array_sort(F.collect_set(owner)).alias("owners"))
    agree = F.lit(True)
    for c in optional:
        agree = agree & F.col(f"n_{c}").eqNullSafe(F.col(c))
    return every.where(agree).select(*keys, *optional, "owners"), every.where(~agree).select(*keys)


def compared_counts(observed: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """keys, observed, required: violations, where the numbers of rows differ (0 for a missing side)."""
    a = observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    b = required.groupBy(*keys).agg(F.count("*").alias("required"))
    both = a.join(b, keys, "full").select(*keys, F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("required", F.lit(0)).alias("required"))
    return both.where("observed <> required")


def reason_counts(roots: DataFrame, reasons: list[str]) -> DataFrame:
    """One row with the number of roots of each reason."""
    return roots.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in reasons])


def cohorts(rows: DataFrame, identity: list[str], member: str) -> DataFrame:
    """identity, size, least member: rows of equal identity, nulls being equal to each other."""
    return rows.groupBy(*identity).agg(F.count("*").alias("size"), F.min(member).alias("first_member"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark drops the others before the shuffle."""
    return rows.withColumn("f_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("f_turn = 1").drop("f_turn")


def trait_completeness(items: DataFrame, impls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requirements, conditionals and missing items of implementations.

    items (trait_id, item, has_default), impls (impl_id, trait_id, item, member). A member requires its trait's item;
    an implementation together with an item without default requires the member; an implementation that lacks such an
    item is a violation, one that lacks an item with default is not.
    """
    names = impls.select("impl_id", "trait_id").distinct().join(items, "trait_id").join(impls.select("impl_id", "item", "member"), ["impl_id", "item"], "left")
    requirement = names.where("member is not null").select(F.col("member").alias("trigger"), F.col("item").alias("required"))
    conditional = names.where("member is not null and not has_default").select(F.col("impl_id").alias("left_unit"), F.col("item").alias("right_unit"), F.col("member").alias("required"))
    return requirement, conditional, names.where("member is null and not has_default").select("impl_id", "item")
