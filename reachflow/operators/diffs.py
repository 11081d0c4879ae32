"""Comparison of tables and graphs by canonical keys: differences as rows, and the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The rows of one side only, as side `missing` (expected only) or `extra`; rows count once, nulls are equal."""
    named = expected.withColumn("d_side", F.lit(1)).unionByName(actual.withColumn("d_side", F.lit(2)))
    sides = named.groupBy(*expected.columns).agg(F.min("d_side").alias("d_least"), F.max("d_side").alias("d_most")).where("d_least = d_most")
    return sides.select(*expected.columns, F.when(F.col("d_least") == 1, "missing").otherwise("extra").alias("side"))


def map_difference(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, side: keys of one side only, and `changed` where any value differs (nulls are equal)."""
    a = expected.select(*keys, F.struct(*values).alias("a_value"), F.lit(True).alias("a_in"))
    b = actual.select(*keys, F.struct(*values).alias("b_value"), F.lit(True).alias("b_in"))
    both = a.join(b, keys, "full")
    side = F.when(F.col("b_in").isNull(), "missing").when(F.col("a_in").isNull(), "extra").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "changed")
    return both.select(*keys, side.alias("side")).where("side is not null")


def first_difference(differences: DataFrame, keys: list[str]) -> DataFrame:
    """The difference of least key."""
    return differences.orderBy(*keys, "side").limit(1)


def graph_difference(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """part, key, side over roots, then nodes, then edges, each a table with a column key; order by rank, key for the first.

    Keys of different kinds are compared as they are, and become JSON in the result.
    """
    out = None
    mixed = len({t[part].schema["key"].dataType.simpleString() for t in (expected, actual) for part in ("roots", "nodes", "edges")}) > 1
    key = F.to_json(F.struct("key")).alias("key") if mixed else F.col("key")
    for rank, part in enumerate(("roots", "nodes", "edges")):
        rows = set_difference(expected[part].select("key"), actual[part].select("key")).select(F.lit(rank).alias("rank"), F.lit(part).alias("part"), key, "side")
        out = rows if out is None else out.unionByName(rows)
    return out


def subsumed(mentioned: DataFrame, used: DataFrame, keys: list[str], site: str = "site") -> DataFrame:
    """The rows of mentioned (keys, site) of which no used row has the same keys and site; a null site equals a null site."""
    named = used.select(*[F.col(c).alias(f"u_{c}") for c in [*keys, site]]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in [*keys, site]]
    return mentioned.join(named, on, "left_anti")


def subset_violations(selected: DataFrame, permitted: DataFrame, keys: list[str]) -> DataFrame:
    """The selected rows that aren't permitted."""
    return selected.join(permitted.select(*keys).distinct(), keys, "left_anti")


def projected(nodes: DataFrame, edges: DataFrame, chosen: DataFrame, zeroed: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Key-only nodes and edges of the chosen nodes, and violations: keys that several chosen nodes have.

    nodes (node, key), edges (src, dst, kind, ordinal), chosen (node); kinds of zeroed lose their ordinal.
    """
    kept = nodes.join(chosen, "node", "left_semi").select("node", "key")
    ends = edges.join(kept.select(F.col("node").alias("src"), F.col("key").alias("src_key")), "src").join(kept.select(F.col("node").alias("dst"), F.col("key").alias("dst_key")), "dst")
    ordinal = F.when(F.col("kind").isin(zeroed), F.lit(0)).otherwise(F.col("ordinal")).alias("ordinal")
    return kept.select("key"), ends.select("src_key", "dst_key", "kind", ordinal).distinct(), kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
