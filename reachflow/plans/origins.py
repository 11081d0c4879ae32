"""Queries over contributor sets, complete groups, lanes, snapshots, meaning and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.operators import closure, provenance
from reachflow.plans.registered import query
from reachflow.sources.relations import EDGES_SQL, TABLE_SQL, key_edges, node, table, table_of
from reachflow.sources.scratch import written


def _count_by_table(found: DataFrame) -> DataFrame:
    return found.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


@query("""WITH region_ AS (SELECT r_regionkey * 8 AS node, [left(r_name, 1)] AS units FROM region), r AS (SELECT node, min(node) OVER (PARTITION BY units) AS set_id FROM region_),
nation_ AS (SELECT n_nationkey * 8 + 1 AS node, [left(n_name, 1)] AS units, set_id AS up FROM nation JOIN r ON r.node = n_regionkey * 8), n AS (SELECT node, min(node) OVER (PARTITION BY units, up) AS set_id FROM nation_),
customer_ AS (SELECT c_custkey * 8 + 2 AS node, list_sort(list_distinct([c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'low' ELSE c_mktsegment END])) AS units, list_sort(list_distinct([a.set_id, b.set_id])) AS up FROM customer JOIN n a ON a.node = c_nationkey * 8 + 1 JOIN n b ON b.node = (c_custkey % 25) * 8 + 1),
c AS (SELECT node, min(node) OVER (PARTITION BY units, up) AS set_id FROM customer_),
order_ AS (SELECT o_orderkey * 8 + 5 AS node, list_sort(list_distinct([o_orderpriority, o_orderstatus])) AS units, set_id AS up FROM orders JOIN c ON c.node = o_custkey * 8 + 2), o AS (SELECT node, min(node) OVER (PARTITION BY units, up) AS set_id FROM order_)
SELECT CAST(node AS BIGINT) AS node, CAST(set_id AS BIGINT) AS set_id FROM (SELECT * FROM r UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c UNION ALL SELECT * FROM o)""")
def r13_interned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of units and parents, interned: regions, nations, customers of two nations each, and orders."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    local = region.select(node("region", "r_regionkey").alias("node"), F.substring("r_name", 1, 1).alias("unit"))
    local = local.union(nation.select(node("nation", "n_nationkey"), F.substring("n_name", 1, 1)))
    local = local.union(customer.select(node("customer", "c_custkey"), "c_mktsegment")).union(customer.where("c_acctbal < 0").select(node("customer", "c_custkey"), F.lit("low")))
    local = local.union(orders.select(node("orders", "o_orderkey"), "o_orderpriority")).union(orders.select(node("orders", "o_orderkey"), "o_orderstatus"))
    links = [nation.select(node("nation", "n_nationkey").alias("node"), node("region", "n_regionkey").alias("parent")), orders.select(node("orders", "o_orderkey"), node("customer", "o_custkey"))]
    links += [customer.select(node("customer", "c_custkey"), node("nation", key)) for key in ("c_nationkey", "c_custkey % 25")]
    parents = links[0].union(links[1]).union(links[2]).union(links[3])
    return provenance.interned(local.select("node"), local, parents)


@query("""WITH bad AS (SELECT o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000))
SELECT CAST(c_nationkey AS BIGINT) AS group_id FROM customer WHERE c_custkey % 40 = 0 GROUP BY 1 HAVING bool_and(c_custkey NOT IN (SELECT c FROM bad))""")
def r15_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of which every fortieth customer is complete: all its orders, of whose largest lines the suppliers all are solvent."""
    kept = table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").cast("string").alias("unit"))
    local = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(node("orders", "l_orderkey").alias("set_id"), F.col("l_suppkey").cast("string").alias("unit")).distinct()
    parents = table(spark, sf_dir, "orders").select(node("customer", "o_custkey").alias("set_id"), node("orders", "o_orderkey").alias("parent_set_id"))
    customers = table(spark, sf_dir, "customer")
    groups = customers.where("c_custkey % 40 = 0").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_nationkey").cast("long").alias("group_id"), node("customer", "c_custkey").alias("set_id"))
    empty = customers.where("c_custkey % 40 = 0").select(F.col("c_nationkey").cast("long").alias("group_id")).distinct().join(groups, "group_id", "left_anti")
    return provenance.materialized(kept, local, parents, groups).union(empty)


@query("""WITH RECURSIVE rules AS (SELECT l_linestatus AS lane, l_partkey AS a, l_suppkey + 1000000 AS b, (l_partkey * 7 + l_suppkey) % (SELECT max(p_partkey) FROM part) + 1 AS req FROM lineitem),
seeds AS (SELECT 'F' AS lane, p_partkey AS unit FROM part WHERE p_size > 45 UNION SELECT 'O', p_partkey FROM part WHERE p_size < 4 UNION SELECT x.lane, s_suppkey + 1000000 FROM supplier, (VALUES ('F'), ('O')) x(lane)),
found(lane, unit) AS (SELECT lane, unit FROM seeds UNION SELECT f.lane, r.req FROM found f JOIN rules r ON r.lane = f.lane AND r.a = f.unit)
SELECT lane, CAST(unit AS BIGINT) AS unit FROM found""")
def r21_conditional_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a part and its supplier together require, in the lane of the line's status alone."""
    rows = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("most"))))  # one row
    rules = rows.select(F.col("l_linestatus").alias("lane"), F.col("l_partkey").cast("long").alias("left_unit"), (F.col("l_suppkey") + 1_000_000).cast("long").alias("right_unit"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("most") + 1).cast("long").alias("required"))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    kept = part.where("p_size > 45").select(F.lit("F").alias("lane"), F.col("p_partkey").cast("long").alias("unit")).union(part.where("p_size < 4").select(F.lit("O"), F.col("p_partkey").cast("long")))
    kept = kept.union(supplier.select(F.explode(F.array(F.lit("F"), F.lit("O"))), (F.col("s_suppkey") + 1_000_000).cast("long")))
    return provenance.conditional_members(kept, rules)


_SNAPSHOT_SQL = "permitted AS (SELECT DISTINCT dst AS node FROM edges WHERE dst % 8 <> 4 OR dst // 8 % 3 = 0)"


@query(f"""WITH RECURSIVE {EDGES_SQL}, {_SNAPSHOT_SQL}, roots AS (SELECT l_orderkey * 64 + l_linenumber * 8 + 6 AS node FROM lineitem WHERE l_quantity >= 45),
open_ AS (SELECT src, dst FROM edges WHERE dst IN (SELECT node FROM permitted) AND (src % 8 <> 6 OR dst % 8 <> 3 OR src IN (SELECT l_orderkey * 64 + l_linenumber * 8 + 6 FROM lineitem WHERE l_returnflag = 'R'))),
reach(node) AS (SELECT CAST(node AS BIGINT) FROM roots UNION SELECT CAST(node AS BIGINT) FROM permitted WHERE node % 8 < 2 UNION SELECT o.dst FROM reach r JOIN open_ o ON o.src = r.node)
SELECT {TABLE_SQL} AS table_name, count(*) AS n, sum(node) AS node_sum FROM reach GROUP BY 1""")
def r26_original_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What long lines, regions and nations reach within permitted rows (a third of the parts), suppliers by returned lines only."""
    edges = key_edges(spark, sf_dir).withColumn("edge_id", F.when(F.col("kind") == "lineitem-supplier", F.struct("src", "dst")))  # the others have no sites
    permitted = written(edges.where("dst % 8 <> 4 or floor(dst / 8) % 3 = 0").select(F.col("dst").alias("node")).distinct())
    lines = table(spark, sf_dir, "lineitem").withColumn("node", node("lineitem", "l_orderkey * 8 + l_linenumber"))
    sites = edges.where("kind = 'lineitem-supplier'").select("edge_id", F.col("src").alias("site"))
    surviving = lines.where("l_returnflag = 'R'").select(F.col("node").alias("site"))
    roots = lines.where("l_quantity >= 45").select("node")
    return _count_by_table(provenance.original_snapshot(edges, roots, permitted.where("node % 8 < 2"), permitted, sites, surviving))


@query(f"""WITH RECURSIVE {EDGES_SQL}, none AS (SELECT CAST(c_custkey AS BIGINT) * 8 + 2 AS node FROM customer WHERE c_acctbal < 0), defs AS (SELECT CAST(o_orderkey AS BIGINT) * 8 + 5 AS node FROM orders WHERE o_totalprice > 300000),
reach(node) AS (SELECT node FROM defs UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node WHERE e.dst NOT IN (SELECT node FROM none))
SELECT {TABLE_SQL} AS table_name, count(*) AS n, sum(node) AS node_sum FROM reach GROUP BY 1""")
def r27_reduced_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What great orders reach, without customers in debt and what only they lead to."""
    none = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(node("customer", "c_custkey").alias("node"))
    definitions = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(node("orders", "o_orderkey").alias("node"))
    return _count_by_table(provenance.reduced_snapshot(key_edges(spark, sf_dir), definitions.limit(0), definitions, none))


_MEANING_SQL = f"{EDGES_SQL}, m(node) AS (SELECT CAST(o_orderkey AS BIGINT) * 8 + 5 FROM orders WHERE o_totalprice > 350000 UNION SELECT e.dst FROM m JOIN edges e ON e.src = m.node WHERE e.kind <> 'nation-region')"


@query(f"WITH RECURSIVE {_MEANING_SQL} SELECT CAST(c_custkey AS BIGINT) * 8 + 2 AS node FROM customer WHERE CAST(c_custkey AS BIGINT) * 8 + 2 NOT IN (SELECT node FROM m)")
def r18_outputless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that mean nothing, as no great order leads to them."""
    return provenance.outputless(_customers(spark, sf_dir), _meaning(spark, sf_dir))


@query(f"WITH RECURSIVE {_MEANING_SQL} SELECT CAST(c_custkey AS BIGINT) * 8 + 2 AS node FROM customer WHERE c_acctbal > 0 AND CAST(c_custkey AS BIGINT) * 8 + 2 NOT IN (SELECT node FROM m)")
def r19_outputless_after_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the customers that a rewrite keeps, those with money, the ones that mean nothing."""
    kept = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(node("customer", "c_custkey").alias("node"))
    return provenance.outputless(_customers(spark, sf_dir), _meaning(spark, sf_dir), kept)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("node"))


def _meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select(node("orders", "o_orderkey").alias("node"))
    return closure.reachable(key_edges(spark, sf_dir).where("kind <> 'nation-region'"), seeds)


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), s AS (SELECT CAST(s_suppkey AS BIGINT) AS node FROM supplier), busy AS (SELECT DISTINCT l_suppkey AS node FROM lineitem)
SELECT 'customers' AS of, node, true AS accepted FROM c UNION ALL SELECT 'suppliers', node, false FROM s WHERE node IN (SELECT node FROM busy) UNION ALL SELECT 'suppliers', node, true FROM s WHERE NOT EXISTS (SELECT 1 FROM s t JOIN busy USING (node))""")
def p7_childless_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, who all pass; suppliers, of whom none passes, as some have lines, and those that do."""
    orders, lineitem = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("parent")), table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("parent"))
    idle = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node")).join(orders.withColumnRenamed("parent", "node"), "node", "left_anti")
    out = None
    for name, candidates, children in (("customers", idle, orders), ("suppliers", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node")), lineitem)):
        for rows, accepted in zip(provenance.childless_or_none(candidates, children, children.select(F.col("parent").alias("src")).limit(0)), (True, False), strict=True):
            part = rows.select(F.lit(name).alias("of"), "node", F.lit(accepted).alias("accepted"))
            out = part if out is None else out.union(part)
    return out


@query(f"""WITH RECURSIVE {EDGES_SQL}, caps AS (SELECT src, dst, CASE WHEN kind LIKE 'lineitem-%' AND src // 8 % 4 = 0 THEN 1 WHEN kind = 'nation-region' THEN 2 ELSE 0 END AS cap FROM edges),
roots AS (SELECT src AS node, CASE WHEN src // 64 % 10 = 0 THEN 0 ELSE 1 END AS k FROM edges WHERE kind = 'lineitem-orders' AND src // 64 % 5 = 0),
reach(node, k) AS (SELECT node, k FROM roots UNION SELECT c.dst, greatest(r.k, c.cap) FROM reach r JOIN caps c ON c.src = r.node)
SELECT node, ['used', 'mentioned', 'named'][min(k) + 1] AS mode FROM reach GROUP BY node""")
def r25_evaluated_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest mode in which every row is evaluated, from lines in two modes along edges that weaken them."""
    edges = key_edges(spark, sf_dir)
    cap = F.when(F.col("kind").like("lineitem-%") & (F.floor(F.col("src") / 8) % 4 == 0), "mentioned").when(F.col("kind") == "nation-region", "named").otherwise("used")
    mode = F.when(F.floor(F.col("src") / 64) % 10 == 0, "used").otherwise("mentioned")
    roots = edges.where("kind = 'lineitem-orders' and floor(src / 64) % 5 = 0").select(F.col("src").alias("node"), mode.alias("mode"))
    return provenance.reachable_modes(edges.select("src", "dst", cap.alias("cap")), roots, ["used", "mentioned", "named"])
