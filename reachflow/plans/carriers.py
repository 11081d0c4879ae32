"""Queries over mixed carriers, ordinals against an earlier run, and facts of strong components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.operators import choice, closure, ordinals
from reachflow.plans.registered import query
from reachflow.sources.relations import node, table
from reachflow.sources.scratch import written


@query("""WITH RECURSIVE c AS (SELECT CAST(c_custkey AS BIGINT) AS disj, CAST(s_suppkey AS BIGINT) * 2 AS item, s_acctbal AS cost FROM customer JOIN supplier ON s_nationkey = c_nationkey
 UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT) * 2 + 1, c_acctbal FROM customer),
d AS (SELECT disj, list(item) AS items, arg_min(item, (cost, item)) AS pick, CASE WHEN disj % 3 > 0 THEN (disj * 7 % 25) * 2 + 1 END AS trig, row_number() OVER (ORDER BY disj) AS i FROM c GROUP BY disj),
w(i, kept, disj, pick) AS (SELECT CAST(0 AS BIGINT), (SELECT list(CAST(s_suppkey AS BIGINT) * 2) FROM supplier WHERE s_suppkey % 50 = 0), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
 UNION ALL SELECT d.i, CASE WHEN list_has_any(w.kept, d.items) OR NOT (d.trig IS NULL OR list_contains(w.kept, d.trig)) THEN w.kept ELSE list_append(w.kept, d.pick) END, CASE WHEN list_has_any(w.kept, d.items) OR NOT (d.trig IS NULL OR list_contains(w.kept, d.trig)) THEN NULL ELSE d.disj END, d.pick FROM w JOIN d ON d.i = w.i + 1)
SELECT disj AS cust_key, CASE WHEN pick % 2 = 1 THEN 'node' ELSE 'unit' END AS domain, pick // 2 AS item FROM w WHERE disj IS NOT NULL""")
def c2_mixed_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers pick a supplier of their nation or the nation itself, whichever costs less; two of three wait for a nation to be picked."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = F.col("c_custkey").cast("long").alias("disj")
    choices = customer.select(key, F.lit("node").alias("domain"), F.col("c_nationkey").cast("long").alias("item"), F.col("c_acctbal").alias("cost"))
    offers = supplier.select(F.col("s_nationkey").cast("long").alias("list"), F.lit("unit").alias("domain"), F.col("s_suppkey").cast("long").alias("item"), F.col("s_acctbal").alias("cost"))
    members = customer.select(key, F.col("c_nationkey").cast("long").alias("list"))
    asks = customer.select(key).select("disj", F.when(F.col("disj") % 3 > 0, F.col("disj") * 7 % 25).alias("trigger"))
    there = supplier.where("s_suppkey % 50 = 0").select(F.col("s_suppkey").cast("long").alias("unit"))
    found = choice.mixed(asks, choices, ["cost"], there, choices.select(F.col("item").alias("node")).limit(0), (members, offers))
    return found.select(F.col("disj").alias("cust_key"), "domain", "item")


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, kind, name, basis, raw: customers, their orders, and the orders' lines."""
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_returnflag").alias("l_returnflag"))  # keys repeat
    none = F.lit(None)
    rows = customer.select(node("customer", "c_custkey").alias("node"), none.cast("long").alias("parent"), F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("name"), none.cast("string").alias("basis"), F.lit(0).cast("long").alias("raw"))
    rows = rows.union(orders.select(node("orders", "o_orderkey"), node("customer", "o_custkey"), F.lit("order"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("long")))
    return rows.union(lines.select(node("lineitem", "l_orderkey * 8 + l_linenumber"), node("orders", "l_orderkey"), F.lit("line"), "l_linestatus", "l_returnflag", F.col("l_linenumber").cast("long")))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS ordinal FROM orders),
k AS (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) - 1 AS ordinal FROM k)
SELECT CAST(c_custkey AS BIGINT) * 8 + 2 AS node, CAST(0 AS BIGINT) AS ordinal FROM customer
UNION ALL SELECT CAST(o_orderkey AS BIGINT) * 8 + 5, ordinal FROM o WHERE o_orderpriority NOT LIKE '1%'
UNION ALL SELECT (CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 8 + 6, l.ordinal FROM l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority NOT LIKE '1%' AND l_returnflag <> 'R'""")
def w2_expected_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders and returned lines go, which are whole cohorts of their siblings; the rest keep the ordinals of all rows, found by identities, though all numbers have changed."""
    every = written(_definitions(spark, sf_dir))
    universe = ordinals.structural_ordinals(every, ["kind", "name"], ["basis"], "raw")[0].select("identity", "ordinal")
    urgent = every.where("kind = 'order' and basis like '1%'").select(F.col("node").alias("gone"))
    left = every.where("basis is null or not (kind = 'order' and basis like '1%') and not (kind = 'line' and basis = 'R')").join(urgent, F.col("parent") == F.col("gone"), "left_anti")
    moved = left.select((F.col("node") * 3 + 1).alias("node"), (F.col("parent") * 3 + 1).alias("parent"), "kind", "name", "basis", (F.col("raw") * 5).alias("raw"))
    placed = ordinals.structural_ordinals(moved, ["kind", "name"], ["basis"], "raw", universe)[0]
    return placed.select(F.expr("(node - 1) div 3").alias("node"), F.col("ordinal").cast("long").alias("ordinal"))


_PARENTS_SQL = "n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS src, (s_suppkey * s_suppkey) % n AS dst FROM supplier, n UNION SELECT s_suppkey, (3 * s_suppkey + 1) % n FROM supplier, n)"


@query(f"""WITH RECURSIVE {_PARENTS_SQL}, ends AS (SELECT src AS node FROM e UNION SELECT dst FROM e), reach(a, b) AS (SELECT node, node FROM ends UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
comp AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1)
SELECT 'gate' AS fact, CAST(component AS BIGINT) AS component, CAST(s_nationkey AS BIGINT) AS value FROM supplier JOIN comp ON node = s_suppkey GROUP BY ALL
UNION ALL SELECT 'parent', CAST(a.component AS BIGINT), CAST(b.component AS BIGINT) FROM e JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component <> b.component GROUP BY ALL""")
def r5_component_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations (gates) of the strong components of a graph over suppliers, and the components above them."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.col("s_nationkey").cast("long").alias("unit"))
    n = supplier.count()
    edges = supplier.select(F.col("s").alias("src"), F.explode(F.array(F.col("s") * F.col("s") % n, (3 * F.col("s") + 1) % n)).alias("dst")).distinct()
    components = closure.strong_components(edges, supplier.select(F.col("s").alias("node")))
    gates, parents = closure.component_facts(components, edges, supplier.select(F.col("s").alias("node"), "unit"))
    return gates.select(F.lit("gate").alias("fact"), "component", F.col("unit").alias("value")).union(parents.select(F.lit("parent"), "component", "parent"))
