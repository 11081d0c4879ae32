"""A query over groups of products with output meaning and demand clauses, within the rules of retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.operators.retention import Facts, retained
from reachflow.plans.registered import query
from reachflow.sources.relations import key_edges, node, table, table_of


@query("""WITH great AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 490000), nat AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
c AS (SELECT c_custkey AS u, c_nationkey AS n, r, c_mktsegment AS seg, c_acctbal AS bal FROM customer JOIN nat ON n = c_nationkey), dc AS (SELECT * FROM c WHERE u IN (SELECT o_custkey FROM great)),
trig AS (SELECT DISTINCT n, r FROM dc WHERE seg = 'MACHINERY'),
sets AS (SELECT n AS s, u FROM c WHERE seg = 'BUILDING' AND bal > 9000 UNION ALL SELECT 100 + r, u FROM c WHERE seg = 'BUILDING' AND bal > 9900),
k1 AS (SELECT u FROM dc UNION SELECT u FROM sets WHERE s IN (SELECT n FROM trig UNION SELECT 100 + r FROM trig)), lacking AS (SELECT DISTINCT s FROM sets WHERE u NOT IN (SELECT u FROM k1)),
made AS (SELECT * FROM nat WHERE n NOT IN (SELECT s FROM lacking) AND 100 + r NOT IN (SELECT s FROM lacking)), meant AS (SELECT DISTINCT r FROM made WHERE n % 2 = 0 OR n IN (SELECT n FROM trig)),
fired AS (SELECT n FROM dc WHERE seg = 'HOUSEHOLD' AND u IN (SELECT o_custkey FROM great WHERE o_orderpriority = '1-URGENT')),
k3 AS (SELECT u FROM k1 UNION SELECT u FROM c WHERE seg = 'AUTOMOBILE' AND bal > 9500 AND n IN (SELECT n FROM fired)),
k AS (SELECT u FROM k3 UNION SELECT u FROM c WHERE seg = 'FURNITURE' AND bal > 9500 AND r IN (SELECT r FROM meant) AND r IN (SELECT r FROM c WHERE u IN (SELECT u FROM k3))),
pc AS (SELECT * FROM c WHERE u IN (SELECT u FROM k)),
rows AS (SELECT 'unit' AS what, 'customer' AS table_name, u AS id FROM pc UNION SELECT 'present', 'customer', u FROM pc UNION SELECT 'present', 'nation', n FROM pc UNION SELECT 'present', 'region', r FROM pc UNION SELECT 'present', 'orders', o_orderkey FROM great
 UNION SELECT 'present', 'supplier', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n FROM made)
 UNION SELECT 'demanded', 'customer', u FROM dc UNION SELECT 'demanded', 'nation', n FROM dc UNION SELECT 'demanded', 'region', r FROM dc UNION SELECT 'demanded', 'orders', o_orderkey FROM great)
SELECT what, table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM rows GROUP BY ALL""")
def r28_meaning_and_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What great orders keep where nations and regions are producers of groups.

    A nation's group has its rich building customers and its region's; machinery customers ask for it, and it gives the
    nation's suppliers. An even nation means something once its group is complete, an odd one if it was asked for, too,
    and a region through its nations; such a region asks for its rich furniture customers. A clause of each nation asks
    for its rich automobile customers once an urgent order demands one of its household customers.
    """
    edges = key_edges(spark, sf_dir).where("kind in ('orders-customer', 'customer-nation', 'nation-region')").select(F.struct("src", "dst").alias("edge"), "src", "dst")
    great = table(spark, sf_dir, "orders").where("o_totalprice > 490000")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n")).select(node("customer", "c_custkey").alias("node"), "n", "r", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    nation, region = node("nation", "n"), node("region", "r")

    def rich(segment: str, least: int, set_id: str) -> DataFrame:
        return customers.where((F.col("seg") == segment) & (F.col("bal") > least)).selectExpr(f"{set_id} AS set_id", "node AS unit")

    numbers = nations.select("n").union(nations.selectExpr("300 + n")).union(nations.selectExpr("200 + r").distinct())
    facts = Facts.of(
        spark,
        ["cost"],
        roots=great.select(node("orders", "o_orderkey").alias("node")),
        edges=edges,
        binding=customers.select("node", F.col("node").alias("unit")),
        set_units=rich("BUILDING", 9000, "n").union(rich("BUILDING", 9900, "100 + r")).union(rich("FURNITURE", 9500, "200 + r")).union(rich("AUTOMOBILE", 9500, "300 + n")),
        set_parents=nations.select(F.col("n").alias("set_id"), (F.lit(100) + F.col("r")).alias("parent_set_id")),
        mgroup_roots=numbers.select(F.col("n").alias("mgroup"), F.col("n").alias("set_id")),
        mgroup_products=table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("mgroup"), node("supplier", "s_suppkey").alias("node")),
        triggers=customers.where("seg = 'MACHINERY'").select("node", F.col("n").alias("mgroup")).union(nations.select(region, F.expr("200 + r")).distinct()),
        producers=nations.select(F.col("n").alias("mgroup"), nation.alias("producer"), (F.col("n") % 2 == 0).alias("intrinsic")),
        meanings=nations.select(region.alias("producer"), nation.alias("child")),
        demand_triggers=great.where("o_orderpriority = '1-URGENT'").select(node("orders", "o_orderkey").alias("node"), node("customer", "o_custkey").alias("producer")),
        clauses=nations.select(F.col("n").alias("clause"), F.lit(None).cast("long").alias("producer"), F.expr("300 + n").alias("mgroup"), F.lit(False).alias("opaque")),
        clause_carriers=nations.select(F.col("n").alias("clause"), nation.alias("node")),
        clause_children=customers.where("seg = 'HOUSEHOLD'").select(F.col("n").alias("clause"), F.col("node").alias("child")),
    )
    kept = retained(facts)
    sums = F.count("*").alias("n"), F.sum(F.expr("node div 8")).alias("id_sum")
    parts = [rows.groupBy(table_of().alias("table_name")).agg(*sums).select(F.lit(what).alias("what"), "table_name", "n", "id_sum") for what, rows in (("present", kept.present), ("demanded", kept.demanded), ("unit", kept.units.withColumnRenamed("unit", "node")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
