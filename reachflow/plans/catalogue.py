"""The queries of the reference's operators over the ordinary tables, and their DuckDB oracles.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachflow.functions import text as X
from reachflow.operators import checks, choice, closure, diffs, gates, groups, ordinals, rewriting, spans
from reachflow.operators.components import connected_components
from reachflow.plans.registered import oracle_sql, queries, query  # noqa: F401
from reachflow.sources.relations import CHAIN_SQL, EDGES_SQL, LINES_SQL, TABLE_SQL, key_edges, lines, node, table, table_of, user_chain
from reachflow.sources.scratch import written

# Reachability and fixed points.


def _large_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49")
    return rows.select(node("lineitem", "l_orderkey * 8 + l_linenumber").alias("node"))


_RETURNS_SQL = "roots AS (SELECT (l_orderkey * 8 + l_linenumber) * 8 + 6 AS node FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)"


@query(f"WITH RECURSIVE {EDGES_SQL}, {_RETURNS_SQL}, reach(node) AS (SELECT node FROM roots UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node) SELECT {TABLE_SQL} AS table_name, count(*) AS n_nodes, CAST(min(node) AS BIGINT) AS first_node FROM reach GROUP BY 1")
def r1_reachable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What large returned lines reach along foreign keys, by table."""
    found = closure.reachable(key_edges(spark, sf_dir), _large_returns(spark, sf_dir))
    return found.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r1_reachable_rows(spark, sf_dir)


@query(f"WITH RECURSIVE {EDGES_SQL}, up(node) AS (SELECT o_orderkey * 8 + 5 FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT e.dst FROM up u JOIN edges e ON e.src = u.node WHERE e.kind IN ('orders-customer', 'customer-nation')), down(node) AS (SELECT s_suppkey * 8 + 3 FROM supplier WHERE CAST(s_nationkey AS BIGINT) * 8 + 1 IN (SELECT node FROM up) UNION SELECT e.src FROM down d JOIN edges e ON e.dst = d.node WHERE e.kind = 'lineitem-supplier') SELECT 1 AS stage, count(*) AS n_nodes, CAST(sum(node) AS BIGINT) AS node_sum FROM up UNION ALL SELECT 2, count(*), CAST(sum(node) AS BIGINT) FROM down")
def r2_two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: urgent orders up to their nations, then those nations' suppliers down to their lines."""
    edges = key_edges(spark, sf_dir)
    first = edges.where(F.col("kind").isin("orders-customer", "customer-nation"))
    bridge = edges.where("kind = 'supplier-nation'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    second = edges.where("kind = 'lineitem-supplier'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(node("orders", "o_orderkey").alias("node"))
    upper, lower = closure.two_stage_reachable(first, roots, bridge, second)
    sums = (F.count("*").alias("n_nodes"), F.sum("node").alias("node_sum"))
    return upper.agg(*sums).select(F.lit(1).alias("stage"), "n_nodes", "node_sum").unionByName(lower.agg(*sums).select(F.lit(2).alias("stage"), "n_nodes", "node_sum"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, kept AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0),
opened AS (SELECT e.src, e.dst FROM edges e JOIN orders o ON e.kind = 'orders-customer' AND e.src = o.o_orderkey * 8 + 5
 WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey GROUP BY l.l_returnflag HAVING bool_and(l.l_suppkey IN (SELECT s_suppkey FROM kept)))
 UNION ALL SELECT src, dst FROM edges WHERE kind <> 'orders-customer'),
reach(node) AS (SELECT o_orderkey * 8 + 5 FROM orders WHERE o_orderstatus = 'F' UNION SELECT e.dst FROM reach r JOIN opened e ON e.src = r.node)
SELECT {TABLE_SQL} AS table_name, count(*) AS n_nodes, CAST(sum(node) AS BIGINT) AS node_sum FROM reach GROUP BY 1""")
def r3_gated_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order leads to its customer if for one return flag (a site) all suppliers of its lines (owners) are solvent."""
    edges = key_edges(spark, sf_dir).withColumn("edge", F.struct("src", "dst"))
    sites = table(spark, sf_dir, "lineitem").select(node("orders", "l_orderkey").alias("src"), F.col("l_returnflag").alias("site"), F.col("l_suppkey").alias("owner"))
    of_orders = edges.where("kind = 'orders-customer'").select("src", "edge")
    kept = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("owner"))
    roots = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(node("orders", "o_orderkey").alias("node"))
    found = gates.gated_reachable(edges, sites.join(of_orders, "src").select("edge", "site", "owner"), kept, roots)
    return found.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n_nodes"), F.sum("node").alias("node_sum"))


@query("WITH kept AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), sites AS (SELECT l_orderkey, l_returnflag, bool_and(l_suppkey IN (SELECT s_suppkey FROM kept)) AS whole, bool_or(l_suppkey IN (SELECT s_suppkey FROM kept)) AS some FROM lineitem GROUP BY 1, 2), shut AS (SELECT l_orderkey FROM sites GROUP BY 1 HAVING NOT bool_or(whole)) SELECT s.l_orderkey AS order_key, s.l_returnflag AS site FROM sites s JOIN shut USING (l_orderkey) JOIN orders o ON o.o_orderkey = s.l_orderkey AND o.o_orderstatus = 'F' WHERE s.some AND NOT s.whole")
def r3_partial_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of unopened edges with some but not all owners kept, as violation rows."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_returnflag").alias("site"), F.col("l_suppkey").alias("owner"))
    kept = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("owner"))
    reached = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"))
    return gates.partial_sites(edges, sites, kept, reached).select(F.col("edge").alias("order_key"), "site")


@query(f"WITH RECURSIVE {EDGES_SQL}, gone(node) AS (SELECT CAST(n_nationkey AS BIGINT) * 8 + 1 FROM nation WHERE n_regionkey = 1 UNION SELECT p_partkey * 8 + 4 FROM part WHERE p_size > 45 UNION SELECT e.src FROM gone g JOIN edges e ON e.dst = g.node), every AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT {TABLE_SQL} AS table_name, count(*) AS n_nodes, CAST(sum(node) AS BIGINT) AS node_sum FROM every WHERE node NOT IN (SELECT node FROM gone) GROUP BY 1")
def r4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that survive when a region's nations and large parts go with all that names them."""
    edges = key_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    dead = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(node("nation", "n_nationkey").alias("node")).union(table(spark, sf_dir, "part").where("p_size > 45").select(node("part", "p_partkey")))
    left = closure.survivors(nodes, dead, edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")))
    return left.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n_nodes"), F.sum("node").alias("node_sum"))


def _supplier_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small directed graph with cycles: s leads to s * s mod n and to 3 * s + 1 mod n."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    n = F.lit(s.count())
    return s.select(F.col("s").alias("src"), F.explode(F.array(F.pmod(F.col("s") * F.col("s"), n), F.pmod(3 * F.col("s") + 1, n))).alias("dst"))


_STEPS_SQL = "n AS (SELECT count(*) AS n FROM supplier), steps AS (SELECT s_suppkey AS src, (s_suppkey * s_suppkey) % n AS dst FROM supplier, n UNION SELECT s_suppkey, (3 * s_suppkey + 1) % n FROM supplier, n)"


@query(f"WITH RECURSIVE {_STEPS_SQL}, nodes AS (SELECT src AS node FROM steps UNION SELECT dst FROM steps), reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, s.dst FROM reach r JOIN steps s ON s.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1")
def r5_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of a small cyclic graph over suppliers."""
    steps = _supplier_steps(spark, sf_dir)
    return closure.strong_components(steps, steps.select(F.col("src").alias("node")).union(steps.select("dst")))


@query("""WITH base AS (SELECT o_custkey AS unit FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
nations AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey IN (SELECT unit FROM base)),
whole AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = count(DISTINCT CASE WHEN c_custkey IN (SELECT unit FROM base) THEN c_mktsegment END)),
suppliers AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM whole))
SELECT 'customer' AS kind, count(*) AS n FROM base UNION ALL SELECT 'nation', count(*) FROM nations UNION ALL SELECT 'supplier', count(*) FROM suppliers""")
def r20_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that fire when all required facts hold and any of the alternatives.

    A great order's customer is a fact; a customer gives its nation and its nation's segment; a nation with all
    its segments gives its suppliers.
    """
    customers = table(spark, sf_dir, "customer")
    facts = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("c"), "o_custkey").alias("fact")).distinct()
    name = F.concat(F.lit("c"), F.col("c_custkey"))
    nation = F.concat(F.lit("n"), F.col("c_nationkey"))
    segment = F.concat(F.lit("m"), F.col("c_nationkey"), F.lit("-"), F.col("c_mktsegment"))
    nations = customers.select(nation.alias("rule"), nation.alias("head"), name.alias("fact"), F.lit("any").alias("kind"))
    segments = customers.select(segment.alias("rule"), segment.alias("head"), name.alias("fact"), F.lit("any").alias("kind"))
    segments_of = customers.select(F.col("c_nationkey").alias("s_nationkey"), "c_mktsegment").distinct()
    every = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(segments_of, "s_nationkey")
    supplier = F.concat(F.lit("s"), F.col("s_suppkey"))
    suppliers = every.select(supplier.alias("rule"), supplier.alias("head"), F.concat(F.lit("m"), "s_nationkey", F.lit("-"), "c_mktsegment").alias("fact"), F.lit("all").alias("kind"))
    body = nations.union(segments).union(suppliers)
    found = gates.fired(facts, body.select("rule", "head").distinct(), body.select("rule", "fact", "kind"))
    kind = F.when(F.substring("fact", 1, 1) == "c", "customer").when(F.substring("fact", 1, 1) == "n", "nation").when(F.substring("fact", 1, 1) == "s", "supplier")
    kinds = spark.createDataFrame([("customer",), ("nation",), ("supplier",)], "kind string")
    return kinds.join(found.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def r6_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that great orders require; several conditions at once, so tests hold it against a plain model instead of SQL.

    An order requires its customer; a customer with the first part of its nation's region requires the nation; the
    lines of an order are kept together.
    """
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = node("lineitem", "l_orderkey * 8 + l_linenumber")
    kept = lineitem.where("l_quantity = 50 and l_discount = 0.1").select(line.alias("unit"))
    single = lineitem.select(line.alias("trigger"), node("orders", "l_orderkey").alias("required")).union(orders.select(node("orders", "o_orderkey"), node("customer", "o_custkey")))
    customers = table(spark, sf_dir, "customer")
    double = orders.join(customers, orders.o_custkey == customers.c_custkey).select(node("orders", "o_orderkey").alias("left_unit"), node("customer", "c_custkey").alias("right_unit"), node("nation", "c_nationkey").alias("required"))
    units = lineitem.select(line.alias("unit"), F.col("l_orderkey").alias("group_id"))
    found = gates.required(kept, single, double, units)
    return found.groupBy(table_of("unit").alias("table_name")).agg(F.count("*").alias("n_units"), F.sum("unit").alias("unit_sum"))


@query(f"WITH {CHAIN_SQL} SELECT node AS event_id, (last_value(CASE WHEN event_type = 'purchase' THEN node END IGNORE NULLS) OVER w) IS NOT NULL AS has_purchase, last_value(CASE WHEN event_type = 'purchase' THEN node END IGNORE NULLS) OVER w AS purchase_id FROM chain WINDOW w AS (PARTITION BY user_id ORDER BY ts, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def r9_nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier purchase in each user's chain of events, by pointer doubling."""
    found = closure.nearest_ancestor(user_chain(spark, sf_dir), F.col("event_type") == "purchase")
    return found.select(F.col("node").alias("event_id"), F.col("ancestor").isNotNull().alias("has_purchase"), F.col("ancestor").alias("purchase_id"))


@query(f"WITH {CHAIN_SQL} SELECT node AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, node) - 1 AS depth FROM chain")
def w13_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ancestors of each event in its user's chain."""
    return closure.depths(user_chain(spark, sf_dir)).select(F.col("node").alias("event_id"), "depth")


@query(f"WITH {CHAIN_SQL} SELECT node AS event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, node) AS below, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM chain")
def r22_flag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event or one before it, and whether it or one behind it, is an error."""
    return closure.flag_closure(user_chain(spark, sf_dir), F.col("event_type") == "error").select(F.col("node").alias("event_id"), "below", "above")


@query("WITH RECURSIVE f AS (SELECT p_partkey AS node, CASE p_partkey % 5 WHEN 1 THEN p_partkey + 1 WHEN 2 THEN p_partkey - 1 WHEN 3 THEN p_partkey - 1 WHEN 4 THEN p_partkey + 1 END AS parent FROM part), ends(node) AS (SELECT node FROM f WHERE parent IS NULL UNION SELECT f.node FROM f JOIN ends e ON f.parent = e.node) SELECT node FROM f WHERE node NOT IN (SELECT node FROM ends)")
def r24_cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each five parts two name each other, one hangs below them, one below the root: the first three are on or below a cycle."""
    k = F.col("p_partkey")
    parent = F.when(k % 5 == 1, k + 1).when((k % 5 == 2) | (k % 5 == 3), k - 1).when(k % 5 == 4, k + 1)
    return closure.cyclic_nodes(table(spark, sf_dir, "part").select(k.alias("node"), parent.alias("parent")))


@query()
def r11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of orders and parts that share a line; the recursive SQL is quadratic, so tests hold it against brute force."""
    return shared_components(table(spark, sf_dir, "lineitem"))


def shared_components(rows: DataFrame) -> DataFrame:
    return connected_components(rows.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


@query("WITH RECURSIVE p AS (SELECT s_suppkey AS set_id, s_suppkey // 2 AS parent_set_id FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 0), up(set_id, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT u.set_id, p.parent_set_id FROM up u JOIN p ON p.set_id = u.node), cl AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS unit_id FROM lineitem), un AS (SELECT DISTINCT u.set_id, c.unit_id FROM up u JOIN cl c ON c.set_id = u.node) SELECT set_id, count(*) AS n_units, CAST(sum(p_size) AS BIGINT) AS total_size FROM un JOIN part ON p_partkey = unit_id GROUP BY 1")
def r12_contributor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of all lines of a supplier and of all its forebears in a dag of suppliers, their number and total size."""
    return forebears_parts(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def forebears_parts(spark: SparkSession, sf_dir: str, of: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("set_id"))
    parents = s.select("set_id", F.floor(F.col("set_id") / 2).alias("parent_set_id")).union(s.select("set_id", F.floor(F.col("set_id") / 3))).distinct()
    local = of.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("unit_id")).distinct()
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_size").alias("weight"))
    found = closure.contributor_totals(local, parents, sizes)
    return found.select("set_id", F.col("n").alias("n_units"), F.col("total").alias("total_size"))


@query()
def t5_least_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least path of step labels from supplier 1 to each node of the cyclic graph; tests hold it against a plain model."""
    steps = _supplier_steps(spark, sf_dir).distinct()
    edges = steps.withColumn("label", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    roots = spark.createDataFrame([(1,)], "node long")
    return closure.least_paths(edges, roots).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


# Joins and lookups over spans.


@query(f"""WITH {LINES_SQL}, units AS (SELECT source_id, line AS unit_id, start, "end", 1 AS depth FROM lines UNION ALL SELECT doc_id, -1, 0, CAST(strlen(text) AS BIGINT), 0 FROM documents),
sites AS (SELECT doc_id AS source_id, unnest([0, strlen(text) // 3, strlen(text) // 2, strlen(text) - 1]) AS start FROM documents WHERE text <> ''),
pairs AS (SELECT s.source_id, s.start, u.unit_id, rank() OVER (PARTITION BY s.source_id, s.start ORDER BY u."end" - u.start, u.depth DESC) AS r FROM (SELECT DISTINCT * FROM sites) s JOIN units u ON u.source_id = s.source_id AND u.start <= s.start AND s.start + 1 <= u."end")
SELECT source_id, CAST(start AS BIGINT) AS start, CAST(unit_id AS BIGINT) AS owner FROM pairs WHERE r = 1""")
def j1_innermost_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost unit (a line, else the document) around single bytes of each document."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("n"))
    units = lines(spark, sf_dir).select("source_id", F.col("line").alias("unit_id"), "start", "end", F.lit(1).alias("depth"))
    whole = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.lit(-1).cast("long").alias("unit_id"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), F.lit(0).alias("depth"))
    sites = docs.select("source_id", F.explode(F.array(F.lit(0).cast("long"), F.expr("n div 3"), F.expr("n div 2"), F.col("n") - 1)).alias("start")).distinct()
    sites = sites.withColumn("end", F.col("start") + 1).withColumn("site_id", F.col("start"))
    return spans.innermost_owners(sites, units.unionByName(whole)).select("source_id", "start", "owner")


@query(f"""WITH {LINES_SQL}, marked AS (SELECT *, strlen(text) < 80 AS short FROM lines), g AS (SELECT *, line - row_number() OVER (PARTITION BY source_id, short ORDER BY line) AS k FROM marked) SELECT source_id, short AS value, min(line) AS first, max(line) AS last, count(*) AS n FROM g GROUP BY source_id, short, k""")
def w7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of short and of long lines in each document (gaps and islands)."""
    return spans.runs(lines(spark, sf_dir), ["source_id"], "line", F.octet_length("text") < 80)


_SHIPPING_SQL = "ship AS (SELECT l_suppkey AS k, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS start, CAST(epoch(l_shipdate) // 86400 AS BIGINT) + l_linenumber AS \"end\" FROM lineitem)"


def _shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("start"), (day + F.col("l_linenumber")).alias("end"))


@query(f'WITH {_SHIPPING_SQL}, m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ship), g AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, min(start) AS start, max("end") AS "end" FROM g GROUP BY k, g')
def w8_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching or overlapping shipping periods of each supplier as one."""
    return spans.coalesced(_shipping(spark, sf_dir), "k")


@query(f'WITH {_SHIPPING_SQL}, d AS (SELECT DISTINCT * FROM ship), m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d) SELECT CASE WHEN reach IS NULL OR start >= reach THEN \'outermost\' ELSE \'crossing\' END AS state, count(*) AS n FROM m WHERE reach IS NULL OR start >= reach OR "end" > reach GROUP BY 1')
def j10_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping periods outside all others, and those that cross an earlier one."""
    outer, crossing = spans.outermost(_shipping(spark, sf_dir), "k")
    return outer.select(F.lit("outermost").alias("state")).union(crossing.select(F.lit("crossing"))).groupBy("state").agg(F.count("*").alias("n"))


@query(f'WITH {_SHIPPING_SQL}, a AS (SELECT DISTINCT * FROM ship), p AS (SELECT x.k, count(*) AS n FROM a x JOIN a y ON x.k = y.k AND x.start < y."end" AND y.start < x."end" GROUP BY x.k) SELECT k, n FROM p')
def j21_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of overlapping shipping periods of each supplier."""
    return overlap_counts(_shipping(spark, sf_dir))


def overlap_counts(of: DataFrame) -> DataFrame:
    rows = written(of.distinct().withColumnRenamed("k", "source_id"))
    return spans.overlapping(rows, rows).groupBy(F.col("source_id").alias("k")).agg(F.count("*").alias("n"))


@query(f'WITH {_SHIPPING_SQL}, f AS (SELECT k, start, "end", count(*) AS n FROM ship GROUP BY ALL) SELECT r.k, r.start, r."end", coalesce(f.n, 0) AS n FROM (SELECT DISTINCT k, start, start + 3 AS "end" FROM ship) r LEFT JOIN f ON f.k = r.k AND f.start = r.start AND f."end" = r."end"')
def j7_exact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shipping periods are exactly the three days from each begin."""
    rows = _shipping(spark, sf_dir).withColumnRenamed("k", "source_id")
    asked = rows.select("source_id", "start", (F.col("start") + 3).alias("end")).distinct()
    return spans.exact_lookup(asked, rows.withColumn("unit_id", F.col("start"))).select(F.col("source_id").alias("k"), "start", "end", "n")


@query("WITH e AS (SELECT DISTINCT p_brand, p_type, p_size, p_partkey FROM part) SELECT a.p_partkey AS part_key, count(*) AS n_earlier FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.p_partkey < a.p_partkey GROUP BY 1")
def j23_earlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, the earlier ones of its brand and size (equal keys and an inequality)."""
    # How many keys are smaller is the rank less one; the pairs themselves would grow with the square of the groups.
    rows = table(spark, sf_dir, "part").where("p_brand is not null and p_size is not null and p_partkey is not null")
    before = (F.rank().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")) - 1).cast("long")
    return rows.select(F.col("p_partkey").alias("part_key"), before.alias("n")).where("n > 0").groupBy("part_key").agg(F.sum("n").alias("n_earlier"))


@query("SELECT 'with' AS side, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'without', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j17_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a finished order, and customers without any (semi and anti join)."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    sums = (F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))
    some = customers.join(orders.where("o_orderstatus = 'F'"), customers.c_custkey == orders.o_custkey, "left_semi").agg(*sums)
    none = customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").agg(*sums)
    return some.select(F.lit("with").alias("side"), "n", "key_sum").unionByName(none.select(F.lit("without").alias("side"), "n", "key_sum"))


@query("SELECT n_nationkey AS nation_key, s.k AS supplier_key, c.k AS customer_key FROM nation LEFT JOIN (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1) s ON s.n = n_nationkey LEFT JOIN (SELECT c_nationkey AS n, min(c_custkey) AS k FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON c.n = n_nationkey")
def j24_symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation bound to one supplier and to one rich customer, by outer lookups."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.min("s_suppkey").alias("supplier_key"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.min("c_custkey").alias("customer_key"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"))
    return n.join(s, "nation_key", "left").join(c, "nation_key", "left")


_TRAITS_SQL = "items AS (SELECT DISTINCT p_brand AS trait_id, p_size AS item, p_size > 10 AS has_default FROM part), impls AS (SELECT l_suppkey AS impl_id, p_brand AS trait_id, p_size AS item, min(l_partkey) AS member FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40 GROUP BY ALL), names AS (SELECT i.impl_id, t.item, t.has_default, m.member FROM (SELECT DISTINCT impl_id, trait_id FROM impls) i JOIN items t USING (trait_id) LEFT JOIN impls m ON m.impl_id = i.impl_id AND m.trait_id = i.trait_id AND m.item = t.item)"


@query(f"WITH {_TRAITS_SQL} SELECT 'requirement' AS kind, count(*) AS n FROM names WHERE member IS NOT NULL UNION ALL SELECT 'conditional', count(*) FROM names WHERE member IS NOT NULL AND NOT has_default UNION ALL SELECT 'missing', count(*) FROM names WHERE member IS NULL AND NOT has_default")
def j25_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as traits of sizes, suppliers as implementations; what is required, conditional and missing."""
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_brand").alias("trait_id"), F.col("p_size").alias("item"), (F.col("p_size") > 10).alias("has_default")).distinct()
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 40").join(part, F.col("l_partkey") == F.col("p_partkey"))
    impls = rows.groupBy(F.col("l_suppkey").alias("impl_id"), F.col("p_brand").alias("trait_id"), F.col("p_size").alias("item")).agg(F.min("l_partkey").alias("member"))
    named = items.withColumn("item", F.concat_ws("/", "trait_id", "item")), impls.withColumn("item", F.concat_ws("/", "trait_id", "item"))
    parts = zip(("requirement", "conditional", "missing"), groups.trait_completeness(*named), strict=True)
    out = [rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, rows in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Aggregation.


@query("SELECT l_suppkey AS supplier_key, l_partkey AS part_key, count(DISTINCT l_shipmode_or_flag) AS n_sites, string_agg(DISTINCT l_shipmode_or_flag, ',' ORDER BY l_shipmode_or_flag) AS sites, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'Multiple' ELSE max(l_linestatus) END AS evidence FROM (SELECT *, l_returnflag AS l_shipmode_or_flag FROM lineitem) GROUP BY 1, 2".replace("l_shipmode_or_flag", "flag"))
def a2_grouped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: supplier-part edges with the set of their flags as sites and one status, else Multiple, as evidence."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("part_key"), "l_returnflag", "l_linestatus")
    return groups.grouped_edges(rows, ["supplier_key", "part_key"], "l_returnflag", "l_linestatus").withColumn("sites", F.array_join("sites", ","))


@query("SELECT o_custkey AS group_id, count(*) AS n, min(o_orderkey) AS first_unit, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS units FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def a3_atomic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: great orders by customer, as ordered lists of units by group."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("group_id"))
    units = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("units")
    return rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_unit"), units)


@query("WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT coalesce(a.k, b.k) AS supplier_key, coalesce(a.n, 0) AS observed, coalesce(b.n, 0) AS required FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def a4_compared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: suppliers whose numbers of returned and of accepted lines differ."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier_key"), "l_returnflag")
    return groups.compared_counts(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["supplier_key"])


@query("SELECT count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events")
def a5_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: how many events there are of some kinds, in one row."""
    return groups.reason_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "reason"), ["signup", "purchase", "error"])


@query("WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus END AS status FROM lineitem) SELECT CASE WHEN count(DISTINCT flag) <= 1 AND count(DISTINCT status) <= 1 THEN 'merged' ELSE 'refused' END AS state, l_orderkey AS order_key, CASE WHEN count(DISTINCT flag) <= 1 AND count(DISTINCT status) <= 1 THEN max(flag) END AS flag, CASE WHEN count(DISTINCT flag) <= 1 AND count(DISTINCT status) <= 1 THEN max(status) END AS status FROM r GROUP BY l_orderkey")
def a6_merged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as one observation where their optional values agree, else refused."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linestatus")).alias("status"), "l_linenumber")
    good, bad = groups.merged(rows, ["order_key"], ["flag", "status"], "l_linenumber")
    none = F.lit(None).cast("string")
    return good.select(F.lit("merged").alias("state"), "order_key", "flag", "status").unionByName(bad.select(F.lit("refused").alias("state"), "order_key", none.alias("flag"), none.alias("status")))


@query("SELECT p_brand, p_type, p_size, count(*) AS size, min(p_partkey) AS first_member FROM part GROUP BY ALL")
def a8_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal brand, type and size."""
    return groups.cohorts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("SELECT DISTINCT l_suppkey AS provider, n_name AS kind FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity = 50")
def a11_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of supplier and nation behind lines of greatest quantity."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity = 50").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("l_suppkey").alias("provider"), F.col("n_name").alias("kind")).distinct()


# Windows and ordinals.


@query("SELECT o_orderkey AS order_key, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1 AS ordinal FROM orders")
def w1_sibling_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of a customer's orders by a digest."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("order_key"), F.md5(F.col("o_orderkey").cast("string")).alias("digest"))
    return ordinals.sibling_ordinals(rows, ["o_custkey"], "digest")[0].select("order_key", "ordinal")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS raw, l_returnflag = 'R' AS gone FROM lineitem) SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(CASE WHEN NOT gone THEN raw - coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS ordinal FROM r")
def w3_filtered_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of an order's lines without the returned ones."""
    raw = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), raw.alias("raw"), (F.col("l_returnflag") == "R").alias("gone"))
    return ordinals.filtered_ordinals(rows, ["order_key"], "raw", "gone").select("order_key", "line", "ordinal")


@query("WITH RECURSIVE f AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey < 8 THEN NULL ELSE CAST(p_partkey // 8 AS BIGINT) END AS parent, p_name AS label FROM part), s AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY label, node) AS s FROM f), t(node, path) AS (SELECT node, [s] FROM s WHERE parent IS NULL UNION ALL SELECT s.node, list_append(t.path, s.s) FROM t JOIN s ON s.parent = t.node) SELECT node, row_number() OVER (ORDER BY path) - 1 AS id FROM t")
def w6_preorder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pre-order numbers of parts in an eight-ary forest, siblings by name."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 8, F.floor(F.col("p_partkey") / 8)).alias("parent"), F.col("p_name").alias("label"))
    return ordinals.preorder_ids(rows, "label").select("node", "id")


@query()
def w5_subtree_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of subtrees of parts in an eight-ary forest by size class; tests hold them against a plain model."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 8, F.floor(F.col("p_partkey") / 8)).alias("parent"), (F.col("p_size") % 3).alias("leaf"))
    return ordinals.subtree_ranks(rows, "leaf")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem) SELECT l_orderkey AS order_key, l_linenumber AS ordinal, place FROM r WHERE place <> l_linenumber + (l_orderkey % 7 = 0)::INT")
def w11_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number, shifted for some orders, isn't their place in the order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("ordinal"), (F.col("l_linenumber") - 1 + (F.col("l_orderkey") % 7 == 0).cast("int")).alias("claimed"))
    return ordinals.gaps_in_ordinals(rows, ["order_key"], "claimed").select("order_key", "ordinal", (F.col("place") + 1).alias("place"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS first FROM events), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM f WHERE first) SELECT e.event_id, r.ordinal FROM events e JOIN r USING (user_id, event_type)")
def w14_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event, how many other kinds its user had before the first of its kind."""
    return ordinals.first_occurrence_ordinals(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type").select("event_id", "ordinal")


# Top one, choice.


@query("SELECT l_partkey AS part_key, l_suppkey AS supplier_key FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal, s_suppkey) AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) WHERE r = 1")
def t1_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of least balance, then key, of each part."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = choice.cheapest(rows.select(F.col("l_partkey").alias("disj"), F.col("l_suppkey").alias("item"), "s_acctbal"), ["s_acctbal"])
    return found.select(F.col("disj").alias("part_key"), F.col("item").alias("supplier_key"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_partkey AS disj, l_suppkey AS item, s_acctbal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
d AS (SELECT disj, list(item) AS items, arg_min(item, (s_acctbal, item)) AS pick, row_number() OVER (ORDER BY disj) AS i FROM c GROUP BY disj),
w(i, kept, disj, pick) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
 UNION ALL SELECT d.i, CASE WHEN list_has_any(w.kept, d.items) THEN w.kept ELSE list_append(w.kept, d.pick) END, CASE WHEN list_has_any(w.kept, d.items) THEN NULL ELSE d.disj END, d.pick FROM w JOIN d ON d.i = w.i + 1)
SELECT disj AS part_key, pick AS supplier_key FROM w WHERE disj IS NOT NULL""")
def c1_greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part, in order, picks its cheapest supplier unless one of its suppliers is picked by then."""
    return greedy_choice(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def greedy_choice(spark: SparkSession, sf_dir: str, of: DataFrame) -> DataFrame:
    rows = of.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    choices = rows.select(F.col("l_partkey").alias("disj"), F.col("l_suppkey").alias("item"), "s_acctbal").distinct()
    disjunctions = choices.select("disj", F.lit(None).cast("long").alias("trigger")).distinct()
    kept = choices.select("item").limit(0)
    found = choice.chosen(disjunctions, choices, ["s_acctbal"], kept)
    return found.select(F.col("disj").alias("part_key"), F.col("item").alias("supplier_key"))


@query("SELECT max(o_orderkey) AS order_key, o_custkey AS customer_key FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey")
def t4_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's greatest order."""
    rows = groups.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return rows.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"))


# Differences.


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return orders.where("o_orderkey % 11 <> 0"), orders.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus")))


_SNAPSHOT_SQL = "a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 13 <> 0)"


@query(f"WITH {_SNAPSHOT_SQL} SELECT side, count(*) AS n FROM (SELECT 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY side")
def d1_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one snapshot of orders only."""
    a, b = (x.select("o_orderkey", "o_orderstatus") for x in _snapshots(spark, sf_dir))
    return diffs.set_difference(a, b).groupBy("side").agg(F.count("*").alias("n"))


@query(f"WITH {_SNAPSHOT_SQL} SELECT coalesce(a.k, b.k) AS order_key, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'changed' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s")
def d2_map_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys missing, extra or changed between two snapshots of orders."""
    a, b = _snapshots(spark, sf_dir)
    return diffs.map_difference(a, b, ["o_orderkey"], ["o_orderstatus"]).select(F.col("o_orderkey").alias("order_key"), "side")


@query(f"WITH {_SNAPSHOT_SQL}, d AS (SELECT coalesce(a.k, b.k) AS order_key, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'changed' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s) SELECT * FROM d ORDER BY order_key, side LIMIT 1")
def t6_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first difference of two snapshots of orders."""
    return diffs.first_difference(d2_map_difference(spark, sf_dir), ["order_key"])


@query("WITH x AS (SELECT 'roots' AS part, c_custkey AS k FROM customer WHERE c_custkey % 19 = 0 UNION ALL SELECT 'nodes', o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 UNION ALL SELECT 'edges', o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0), y AS (SELECT 'nodes' AS part, o_orderkey AS k FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'edges', o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) SELECT part, count(*) AS n, min(side) AS first_side FROM (SELECT *, 'missing' AS side FROM x UNION ALL SELECT *, 'extra' FROM y) GROUP BY part")
def d3_graph_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: differences of roots, nodes and edges of two graphs over customers and orders."""
    customers, orders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    edges = table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")).alias("key"))
    first = {"roots": customers, "nodes": orders.where("key % 13 <> 0"), "edges": edges.where("key.src % 5 <> 0")}
    second = {"roots": customers.where("key % 19 <> 0"), "nodes": orders.where("key % 11 <> 0"), "edges": edges.where("key.src % 7 <> 0")}
    return diffs.graph_difference(first, second).groupBy("part").agg(F.count("*").alias("n"), F.min("side").alias("first_side"))


@query("SELECT l_suppkey AS supplier_key, l_partkey AS part_key, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_linestatus FROM lineitem WHERE l_returnflag = 'N') m WHERE NOT EXISTS (SELECT 1 FROM lineitem u WHERE u.l_returnflag = 'R' AND u.l_suppkey = m.l_suppkey AND u.l_partkey = m.l_partkey AND u.l_linestatus = m.l_linestatus) GROUP BY 1, 2")
def d4_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentioned supplier-part edges of statuses under which the edge is not used, too."""
    rows = table(spark, sf_dir, "lineitem")
    mentioned = rows.where("l_returnflag = 'N'").select("l_suppkey", "l_partkey", "l_linestatus").distinct()
    left = diffs.subsumed(mentioned, rows.where("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"], "l_linestatus")
    return left.groupBy(F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("part_key")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS customer_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def d6_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordering customers that aren't permitted (of positive balance)."""
    chosen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_key")).distinct()
    allowed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer_key"))
    return diffs.subset_violations(chosen, allowed, ["customer_key"])


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n, CAST(sum(src % 1000 + dst % 1000) AS BIGINT) AS mix FROM edges GROUP BY kind")
def d7_union_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All foreign keys as one edge table, by kind."""
    return key_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("src") % 1000 + F.col("dst") % 1000).alias("mix"))


# Predicates and projections.


@query("SELECT a.n_nationkey AS nation_key, r.r_name AS parent_name FROM nation a JOIN region r ON r.r_regionkey = a.n_regionkey WHERE r.r_regionkey IN (0, 2) OR a.n_name LIKE 'C%'")
def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that qualify by themselves or by their region (filter and parent join)."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows in every scale
    return rows.where("r_regionkey in (0, 2) or n_name like 'C%'").select(F.col("n_nationkey").alias("nation_key"), F.col("r_name").alias("parent_name"))


@query("SELECT CASE WHEN p_size > 40 THEN 'root' WHEN p_type LIKE '%STEEL%' OR p_size > 20 THEN 'subordinate' ELSE 'none' END AS role, count(*) AS n FROM part GROUP BY 1")
def p6_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by a case expression."""
    role = F.when(F.col("p_size") > 40, "root").when(F.col("p_type").contains("STEEL") | (F.col("p_size") > 20), "subordinate").otherwise("none")
    return table(spark, sf_dir, "part").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS customer_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -700)")
def p7_candidates_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without great orders in nations without deeply indebted suppliers (anti joins)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_key"), "c_nationkey")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("customer_key"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < -700").select(F.col("s_nationkey").alias("c_nationkey"))
    return c.join(o, "customer_key", "left_anti").join(s, "c_nationkey", "left_anti").select("customer_key")


@query("WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), e AS (SELECT o_orderkey, o_custkey FROM orders), s AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS live, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS order_key, coalesce(live, 0) AS n_sites FROM e LEFT JOIN s ON l_orderkey = o_orderkey WHERE (n IS NULL OR live > 0) AND o_custkey IN (SELECT c_custkey FROM k)")
def p10_site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges keep their kept sites and survive if they had none or one is left; ends must be kept."""
    sites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") > 25).alias("live"), F.count("*").alias("n"))
    kept = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    edges = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(sites, "o_orderkey", "left").where("n is null or live > 0")
    return edges.join(kept, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("order_key"), F.coalesce("live", F.lit(0)).alias("n_sites"))


# Text.


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS digest, sha256(left(text, CAST(length(text) // 2 AS INT))) AS first_half, sha256(substr(text, CAST(length(text) // 2 AS INT) + 1)) AS second_half FROM documents")
def x1_byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte lengths and digests of every text, and of its two halves of characters, cut at a byte offset."""
    docs = table(spark, sf_dir, "documents").withColumn("at", F.octet_length(F.expr("substring(text, 1, cast(length(text) div 2 as int))")))
    halves = X.byte_slice(F.col("text"), F.lit(0), F.col("at")), X.byte_slice(F.col("text"), F.col("at"), F.octet_length("text"))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"), F.sha2(halves[0], 256).alias("first_half"), F.sha2(halves[1], 256).alias("second_half"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE text <> ''")
def x3_char_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte offsets of each whole text at which a character begins, which is how many there are."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", X.char_begins(F.col("text")).cast("long").alias("n_chars"))


_LINE_DELETIONS_SQL = f"{LINES_SQL}, kept AS (SELECT source_id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY source_id, text ORDER BY line) AS r FROM lines) WHERE r = 1)"


def _repeated_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    rows = lines(spark, sf_dir)
    turn = F.row_number().over(Window.partitionBy("source_id", "text").orderBy("line"))
    # Only the first line can have no line break before it, and it repeats no earlier one.
    return sources, rows.withColumn("turn", turn).where("turn > 1").select("source_id", (F.col("start") - 1).alias("start"), "end")


@query(f"WITH {_LINE_DELETIONS_SQL} SELECT source_id, CAST(strlen(string_agg(text, chr(10) ORDER BY line)) AS BIGINT) AS n_bytes, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest FROM kept GROUP BY 1")
def e1_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    text, _ = rewriting.rewritten(*_repeated_lines(spark, sf_dir))
    return text.select("source_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))


@query(f'WITH {_LINE_DELETIONS_SQL}, k AS (SELECT k.*, l.start, l."end" FROM kept k JOIN lines l USING (source_id, line)), o AS (SELECT *, CAST(sum(strlen(text) + 1) OVER (PARTITION BY source_id ORDER BY line) - 1 - strlen(text) AS BIGINT) AS out_start FROM k) SELECT source_id, line, out_start, start AS orig_start, "end" AS orig_end FROM o WHERE text <> \'\'')
def x5_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the kept lines stand in the original, mapped back from their places in the output."""
    sources, gone = _repeated_lines(spark, sf_dir)
    _, pieces = rewriting.rewritten(sources, gone)
    rows = lines(spark, sf_dir).withColumn("turn", F.row_number().over(Window.partitionBy("source_id", "text").orderBy("line"))).where("turn = 1")
    end = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("source_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - 1
    asked = rows.withColumn("out_end", end).where("text <> ''").select("source_id", F.col("line").alias("range_id"), (F.col("out_end") - F.octet_length("text")).alias("start"), F.col("out_end").alias("end"))
    return spans.to_original(asked, pieces).select("source_id", F.col("range_id").alias("line"), F.col("start").alias("out_start"), "orig_start", "orig_end")


@query("WITH parts AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) SELECT doc_id AS source_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (strlen(w) <= 6), '') AS text FROM parts GROUP BY 1")
def e3_list_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of more than six bytes leave the list of all words of a document with their blank."""
    return short_words(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


def short_words(docs: DataFrame) -> DataFrame:
    words = docs.select("source_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    end = F.sum(F.octet_length("w") + 1).over(Window.partitionBy("source_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    elements = words.withColumn("end", end).select("source_id", F.lit(0).alias("list_id"), "i", (F.col("end") - F.octet_length("w")).alias("start"), "end")
    gone = rewriting.list_deletions(elements, F.col("end") - F.col("start") > 6)
    return rewriting.rewritten(docs, gone)[0]


# Constraints: each result holds violations only.


@query(f"WITH {EDGES_SQL} SELECT 'endpoint types' AS \"check\", kind AS key, count(*) AS n FROM edges WHERE kind = 'supplier-nation' AND dst % 8 = 1 AND src % 8 = 3 GROUP BY kind")
def v4_endpoint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: edges of a kind that the shapes don't know (one kind is left out on purpose)."""
    edges = key_edges(spark, sf_dir).select("kind", table_of("src").alias("src_tag"), table_of("dst").alias("dst_tag"), F.lit(1).alias("n_sites"))
    shapes = edges.select("kind", "src_tag", "dst_tag").distinct().where("kind <> 'supplier-nation'").withColumn("site_optional", F.lit(False))
    return checks.endpoint_types(edges, shapes).groupBy("check", "key").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents WHERE doc_id % 13 = 0) SELECT 'pieces touch' AS \"check\", count(*) AS n FROM d WHERE k > 2 UNION ALL SELECT 'pieces cover text', count(*) FROM d WHERE k = 2")
def v12_partition_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their breaks partition every document; of some documents the second line is left out."""
    rows = lines(spark, sf_dir).where("line <> 1 or source_id % 13 <> 0").select("source_id", F.greatest(F.col("start") - F.when(F.col("line") > 0, 1).otherwise(0), F.lit(0)).alias("start"), "end")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("byte_len"))
    found = checks.partition_of_text(rows, docs).groupBy("check").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("pieces touch",), ("pieces cover text",)], "check string").join(found, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH RECURSIVE {EDGES_SQL}, every AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), roots AS (SELECT src AS node FROM edges WHERE src % 8 = 6), reach(node) AS (SELECT node FROM roots UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node) SELECT {TABLE_SQL} AS table_name, count(*) AS n FROM every WHERE node NOT IN (SELECT node FROM reach) GROUP BY 1")
def v2_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, R26, R27, of which reachability: rows that no line leads to."""
    edges = key_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    roots = edges.where("src % 8 = 6").select(F.col("src").alias("node"))
    found = checks.all_reachable(nodes, edges, roots).select(F.col("key").cast("long").alias("node"))
    return found.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT l_orderkey AS g, l_linenumber, max(l_quantity) > 10 AS k FROM lineitem GROUP BY ALL), s AS (SELECT g, count(*) AS n, count(*) FILTER (k) AS k FROM u GROUP BY 1) SELECT 'whole group' AS \"check\", CAST(g AS VARCHAR) AS key, CAST(k AS VARCHAR) AS detail FROM s WHERE k > 0 AND k < n")
def v25_closed_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some lines are kept and some are not."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("unit"), F.col("l_orderkey").alias("group_id"), "l_quantity")
    none = rows.select("unit", F.lit(None).cast("long").alias("parent")).limit(0)
    return checks.closed_retention(rows.where("l_quantity > 10").select("unit"), none, rows.select("unit", "group_id"), none.select("unit"))


from reachflow.plans import carriers, constraints, facts, lexical, lookups, meaning, origins  # noqa: E402, F401  these register theirs
