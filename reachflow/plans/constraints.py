"""Queries of integrity constraints over the ordinary tables, some with faults made on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachflow.operators import checks
from reachflow.plans.registered import query
from reachflow.sources.relations import lines, table


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT 'known parent' AS \"check\", count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'edge has a site', count(*) FROM customer WHERE c_custkey % 50 = 0")
def v1_definition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: the tree world-region-nation-customer with keys as paths; one nation is left out and some edges lack sites."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r, n = F.concat(F.lit("r"), F.col("r_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    world = spark.createDataFrame([(0, None, ["w"])], "id long, parent_id long, key array<string>")
    regions = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.array(F.lit("w"), r).alias("key"))
    nations = named.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("r_regionkey") + 1).cast("long").alias("parent_id"), F.array(F.lit("w"), r, n).alias("key"))
    people = customer.join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = people.select((F.col("c_custkey") + 1000).cast("long").alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.array(F.lit("w"), r, n, F.concat(F.lit("c"), F.col("c_custkey"))).alias("key"))
    nodes = world.union(regions).union(nations.where("id <> 103")).union(leaves)
    edges = leaves.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("use").alias("kind"), F.when((F.col("id") - 1000) % 50 == 0, 0).otherwise(1).cast("long").alias("n_sites"))
    return _counted(checks.definition_graph(nodes, edges))


@query("SELECT 'one edge a link' AS \"check\", count(*) AS n FROM orders WHERE o_orderkey % 31 = 0 OR o_orderkey % 37 = 0")
def v5_parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: links of orders to customers of which some lack their edge and some have two."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("parent"))
    return _counted(checks.parent_links(links, links.where("node % 31 <> 0").union(links.where("node % 37 = 0 and node % 31 <> 0"))))


@query("SELECT 'unique slot' AS \"check\", CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def v6_unique_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: line numbers that an order has several times."""
    return checks.unique_slots(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations) SELECT 'implied relations' AS \"check\", CAST(count(*) AS BIGINT) AS n FROM r WHERE turn % 4 = 3 AND conv_id % 3 = 0 HAVING count(*) > 0")
def v7_implied_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: roles of a conversation's turns against the list that the conversation implies; some turns lie."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ordinal"))
    payload = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "role"))), lambda x: x["role"]).alias("targets"))
    lie = (F.col("turn") % 4 == 3) & (F.col("conv_id") % 3 == 0)
    relations = rows.select("conv_id", "ordinal", F.when(lie, F.lit("liar")).otherwise(F.col("role")).alias("target"))
    return _counted(checks.implied(relations, payload, ["conv_id"]))


@query("SELECT 'root covers text' AS \"check\", count(*) AS n FROM documents WHERE doc_id % 17 = 0 AND doc_id % 19 <> 0 AND strlen(text) > 0 UNION ALL SELECT 'one root', count(*) FROM documents WHERE doc_id % 19 = 0")
def v11_unit_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of documents and lines; some roots are short by a byte and some are missing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("byte_len"))
    cut = F.when((F.col("source_id") % 17 == 0) & (F.col("byte_len") > 0), F.col("byte_len") - 1).otherwise(F.col("byte_len"))
    null = F.lit(None).cast("long")
    roots = docs.where("source_id % 19 <> 0").select("source_id", F.lit(-1).cast("long").alias("unit_id"), null.alias("parent_id"), F.lit(0).cast("long").alias("start"), cut.alias("end"), F.lit(True).alias("active"))
    rows = lines(spark, sf_dir).where("source_id % 17 <> 0 and source_id % 19 <> 0").select("source_id", F.col("line").alias("unit_id"), F.lit(-1).cast("long").alias("parent_id"), "start", "end", F.lit(True).alias("active"))
    found = checks.unit_inventory(roots.unionByName(rows), docs)
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT 'one group a unit' AS \"check\", count(*) AS n FROM orders WHERE o_orderkey % 23 = 0 UNION ALL SELECT 'known unit', 1")
def v18_group_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V18, of which groups partition units: groups that leave some orders out and name an unknown one."""
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"))
    groups = units.where("unit % 23 <> 0").select("unit", (F.col("unit") % 100).alias("group_id")).union(spark.createDataFrame([(-5, 0)], "unit long, group_id long"))
    return _counted(checks.group_partition(units, groups))


@query("SELECT 'a member kept' AS \"check\", CAST(c_custkey AS VARCHAR) AS key, '' AS detail FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def v26_some_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich customers of whom no open order is kept."""
    orders = table(spark, sf_dir, "orders")
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("unit"))
    members = orders.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") + 10**12).alias("unit"))
    kept = owners.union(orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey") + 10**12))
    return checks.some_member_kept(owners, members, kept)
