"""Queries of constraints with faults made on purpose, and of the operators over forests, spans, lists and sets that no other query runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachflow.functions import text as X
from reachflow.functions.text import numbers_within, split_spans
from reachflow.operators import checks, choice, closure, diffs, gates, integrity, ordinals, rewriting, spans
from reachflow.plans.registered import query
from reachflow.sources import files
from reachflow.sources.relations import CHAIN_SQL, EDGES_SQL, LINES_SQL, TABLE_SQL, key_edges, lines, node, table, table_of, user_chain


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count("*").alias("n"))


def _oracle(*parts: tuple[str, str], head: str = "") -> str:
    """The numbers of violations of each check, without those of none."""
    rows = " UNION ALL ".join(f"SELECT '{check}' AS \"check\", count(*) AS n FROM ({sql})" for check, sql in parts)
    return f'{head} SELECT "check", n FROM ({rows}) WHERE n > 0'


# Validity of graphs.


@query(_oracle(("root once", "SELECT 1 FROM region WHERE r_regionkey = 0"), ("known root", "SELECT 1"), ("root without parents", "SELECT 1 FROM nation WHERE n_nationkey % 7 = 3")))
def v3_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: regions as roots of the nations; one is listed twice, some nations and an unknown node are listed, too."""
    region, nation = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("node")), table(spark, sf_dir, "nation")
    name = (F.col("n_nationkey") + 100).cast("long")
    listed = region.union(region.where("node = 0")).union(nation.where("n_nationkey % 7 = 3").select(name)).union(spark.createDataFrame([(999,)], "node long"))
    edges = nation.select(F.col("n_regionkey").cast("long").alias("src"), name.alias("dst"))
    return _counted(integrity.roots(listed, region.union(nation.select(name)), edges))


@query(_oracle(("known tag", "SELECT 1 FROM part WHERE p_brand LIKE '%5'"), ("number of arguments", "SELECT 1 FROM part WHERE p_brand NOT LIKE '%5' AND (p_size < 3 OR p_size > 45)")))
def v8_node_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: parts as nodes, their brands as tags and their sizes as numbers of arguments; some brands have no shape."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("tag"), F.col("p_size").alias("args"))
    shapes = parts.select("tag").distinct().where("tag not like '%5'").select("tag", F.lit(3).alias("least"), F.lit(45).alias("most"))
    return _counted(integrity.node_shapes(parts, shapes))


@query(_oracle(("known definition", "SELECT 1 FROM lineitem WHERE l_partkey % 97 = 0"), ("arguments of the definition", "SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 97 <> 0 AND l_linenumber <> p_size % 7 + 1")))
def v9_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: lines as instances of parts, with their numbers as numbers of arguments; some parts are unknown."""
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("definition"), F.col("l_linenumber").alias("args"))
    known = table(spark, sf_dir, "part").where("p_partkey % 97 <> 0").select(F.col("p_partkey").alias("definition"), (F.col("p_size") % 7 + 1).alias("arity"))
    return _counted(integrity.instances(made, known))


@query(_oracle(("one parent", "SELECT 1 FROM orders WHERE o_orderkey % 100 = 1"), ("ordinal once", "SELECT 1 FROM l2 GROUP BY parent, ordinal HAVING count(DISTINCT node) > 1"), ("ordinal below fan-out", "SELECT 1 FROM l2 LEFT JOIN (SELECT o_custkey AS parent, count(*) - (o_custkey % 50 = 0)::INT AS fan FROM orders GROUP BY 1) f USING (parent) WHERE fan IS NULL OR ordinal >= fan"), head="WITH l AS (SELECT o_orderkey AS node, o_custkey AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders), l2 AS (SELECT * FROM l UNION ALL SELECT node, parent + 1, ordinal FROM l WHERE node % 100 = 1)"))
def v10_allocation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below their customers by ordinals; some have a second parent, some customers a fan-out that is one short."""
    orders = table(spark, sf_dir, "orders")
    ordinal = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("ordinal")
    links = orders.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("parent"), ordinal)
    links = links.union(links.where("node % 100 = 1").select("node", F.col("parent") + 1, "ordinal"))
    fan = orders.groupBy(F.col("o_custkey").alias("parent")).agg(F.count("*").alias("n")).select("parent", (F.col("n") - (F.col("parent") % 50 == 0).cast("int")).alias("fan_out"))
    return _counted(integrity.allocation_paths(links, fan))


@query("WITH e AS (SELECT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 40 AND l_returnflag <> 'A'), m AS (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) SELECT coalesce(n, 0) AS partners, count(*) AS n FROM e LEFT JOIN m USING (l_suppkey, l_partkey, l_returnflag) WHERE coalesce(n, 0) <> 1 GROUP BY 1")
def j16_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of large lines against those of very large ones by supplier, part and flag: exactly one partner, but for one flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    found = integrity.matched_once(rows.where("l_quantity > 40"), rows.where("l_quantity > 45"), ["l_suppkey", "l_partkey", "l_returnflag"], F.col("l_returnflag") == "A")
    return found.groupBy(F.col("detail").cast("long").alias("partners")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT l_linestatus)) AS b FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderstatus, a, CASE WHEN o_orderstatus = 'F' THEN list_append(a, 'X') WHEN o_orderkey % 3 = 0 THEN list_append(a, 'X') ELSE a END AS other FROM orders JOIN s ON k = o_orderkey) SELECT o_orderstatus AS status, o_orderstatus = 'F' OR o_orderkey % 3 <> 0 AS matches, count(*) AS n FROM o GROUP BY ALL")
def p15_site_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's flags as sites against others that hold one more for finished orders (direct calls) and for some open ones."""
    sites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("own"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(sites, "o_orderkey")
    more = (F.col("o_orderstatus") == "F") | (F.col("o_orderkey") % 3 == 0)
    rows = rows.withColumn("other", F.when(more, F.array_append("own", F.lit("X"))).otherwise(F.col("own")))
    kind = F.when(F.col("o_orderstatus") == "F", "DirectCall").otherwise("Use")
    return rows.groupBy(F.col("o_orderstatus").alias("status"), integrity.sites_match(kind, F.col("own"), F.col("other")).alias("matches")).agg(F.count("*").alias("n"))


# Validity of lists, templates, rules, products and meaning.


@query(_oracle(("known list", "SELECT 1 FROM lines WHERE source_id % 31 = 0"), ("entry within list", "SELECT 1 FROM (SELECT source_id, max(line) AS k FROM lines WHERE source_id % 29 = 0 AND source_id % 31 <> 0 GROUP BY 1) WHERE k = 0"), ("entries apart", "SELECT 1 FROM (SELECT source_id, max(line) AS k FROM lines WHERE source_id % 29 = 0 GROUP BY 1) WHERE k > 0"), head=f"WITH {LINES_SQL}"))
def v13_list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries of documents; the first ones of some are two bytes too long, and some documents are unknown."""
    end = F.col("end") + F.when((F.col("source_id") % 29 == 0) & (F.col("line") == 0), 2).otherwise(0)
    entries = lines(spark, sf_dir).select(F.col("source_id").alias("list_id"), F.col("line").alias("i"), "start", end.alias("end"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 31 <> 0").select(F.col("doc_id").alias("list_id"), F.lit(0).alias("list_start"), F.octet_length("text").alias("list_end"))
    return _counted(integrity.entries_in_lists(entries, docs))


@query(_oracle(("known template", "SELECT 1 FROM orders WHERE o_custkey % 41 = 0"), ("slot within template", "SELECT 1 FROM orders WHERE o_custkey % 41 <> 0 AND o_custkey % 10 = 0 AND o_orderkey % 8 = 7"), ("parent of the same template", "SELECT 1 FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 WHERE a.o_orderkey > 1 AND b.o_custkey IS DISTINCT FROM a.o_custkey")))
def v14_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as slots of their customers' templates, each below the order before it; some templates are short, some unknown."""
    k = F.col("o_orderkey")
    slots = table(spark, sf_dir, "orders").select(k.alias("slot"), F.col("o_custkey").alias("template"), (k % 8).alias("start"), (k % 8 + 1).alias("end"), F.when(k > 1, k - 1).alias("parent_slot"))
    size = F.when(F.col("c_custkey") % 10 == 0, 7).otherwise(8)
    templates = table(spark, sf_dir, "customer").where("c_custkey % 41 <> 0").select(F.col("c_custkey").alias("template"), F.lit(0).alias("t_start"), size.alias("t_end"))
    return _counted(integrity.slots_in_templates(slots, templates))


@query(_oracle(("too few elements", "SELECT 1 FROM n WHERE n < 2"), ("too many elements", "SELECT 1 FROM n WHERE n > 5"), ("known repetition", "SELECT 1 FROM lineitem WHERE l_orderkey % 43 = 0"), head="WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 43 <> 0 GROUP BY 1)"))
def v15_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repetitions of two to five lines; some are unknown."""
    reps = table(spark, sf_dir, "orders").where("o_orderkey % 43 <> 0").select(F.col("o_orderkey").alias("rep_id"), F.lit(2).alias("least"), F.lit(5).alias("most"))
    return _counted(integrity.repetitions(reps, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rep_id"))))


@query("WITH n AS (SELECT o_orderkey AS rep_id, count(*) FILTER (l_quantity > 20) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1) SELECT 'planned' AS what, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM n UNION ALL SELECT 'out of bounds', count(*), CAST(sum(n) AS BIGINT) FROM n WHERE n < 1 OR n > 4")
def e7_repetition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept lines of orders whose customer is kept, and orders that keep none or more than four."""
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 10**12).alias("unit")
    items = table(spark, sf_dir, "lineitem").withColumn("unit", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.monotonically_increasing_id()))
    items = items.select(F.col("l_orderkey").alias("rep_id"), "l_quantity", line)
    reps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rep_id"), F.col("o_custkey").alias("parent"), F.lit(1).alias("least"), F.lit(4).alias("most"))
    kept = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("unit"))
    found, wrong = rewriting.repetition_plan(reps, items.where("l_quantity > 20").select("rep_id", "unit"), kept.union(items.select("unit").distinct()))
    sums = (F.count("*").alias("k"), F.sum("n").alias("n"))
    return found.agg(*sums).select(F.lit("planned").alias("what"), "k", "n").unionByName(wrong.agg(*sums).select(F.lit("out of bounds").alias("what"), "k", "n"))


@query(_oracle(("slot has an input", "SELECT 1 FROM customer WHERE c_custkey % 47 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"), ("known slot", "SELECT 1 FROM orders WHERE o_totalprice > 200000 AND o_custkey % 47 = 0")))
def v16_capture_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as slots with their great orders as inputs; some slots are unknown."""
    slots = table(spark, sf_dir, "customer").where("c_custkey % 47 <> 0").select(F.col("c_custkey").alias("slot"))
    return _counted(integrity.capture_slots(slots, table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("slot"))))


@query(_oracle(("rules contiguous", "SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ordinal) - 1 AS place FROM r WHERE p_size <> 50) WHERE place <> ordinal"), ("selected rule of its macro", "SELECT 1 FROM part WHERE p_partkey % 37 = 0 OR p_size = 50"), head="WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal FROM part)"))
def v17_macro_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules of their brands; those of the greatest size are left out, and some are selected for another brand."""
    ordinal = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("ordinal")
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("macro"), F.col("p_partkey").alias("rule"), ordinal, "p_size")
    selected = rules.select(F.when(F.col("rule") % 37 == 0, "none").otherwise(F.col("macro")).alias("macro"), "rule")
    return _counted(integrity.macro_rules(rules.where("p_size <> 50").drop("p_size"), selected))


@query("WITH actual AS (SELECT c_custkey AS unit, 'n' || c_nationkey AS ancestor FROM customer WHERE c_custkey % 53 <> 0 UNION ALL SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'x' FROM customer WHERE c_custkey % 59 = 0) SELECT 'missing' AS side, count(*) AS n FROM customer WHERE c_custkey % 53 = 0 UNION ALL SELECT 'extra', count(*) FROM actual WHERE ancestor = 'x'")
def v18_ancestor_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' ancestors as claimed against those of the forest; some lack their nation, some name one too many."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("unit"), F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("r"))
    closed = rows.select("unit", F.col("n").alias("ancestor")).union(rows.select("unit", "r"))
    claimed = rows.where("unit % 53 <> 0").select("unit", F.col("n").alias("ancestor")).union(rows.select("unit", "r")).union(rows.where("unit % 59 = 0").select("unit", F.lit("x")))
    return integrity.ancestor_sets(claimed, closed).groupBy(F.col("detail").alias("side")).agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT c_custkey, count(DISTINCT o_orderstatus) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT n AS classes, count(*) AS n FROM n WHERE n <> 1 GROUP BY 1")
def v19_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that don't have exactly one status among their orders, by how many they have."""
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"))
    classes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), "o_orderstatus").distinct()
    return checks.classified(members, classes, ["member"]).groupBy(F.col("detail").cast("long").alias("classes")).agg(F.count("*").alias("n"))


@query(_oracle(("path once", "SELECT 1 FROM supplier WHERE s_suppkey % 61 = 1"), ("one crate", "SELECT 1 FROM supplier WHERE s_nationkey IN (4, 5) UNION ALL SELECT 1 FROM supplier WHERE s_suppkey % 61 = 1 AND s_nationkey IN (4, 5)")))
def v20_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as external definitions of their nations' crates; one nation isn't loaded, one is loaded twice, some paths repeat."""
    facts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("crate"))
    loaded = table(spark, sf_dir, "nation").where("n_nationkey <> 4").select(F.col("n_nationkey").alias("crate"))
    return _counted(integrity.externals(facts.union(facts.where("path % 61 = 1")), loaded.union(loaded.where("crate = 5"))))


@query(_oracle(("leads to the root", "SELECT 1 FROM orders WHERE o_orderkey % 61 = 0"), ("edge has a site", "SELECT 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)"), ("site within owner", "SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 25 AND l_linenumber > 4")))
def v21_opaque_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges to the root with their larger lines as sites; some lead elsewhere, some lines lie outside their order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.when(F.col("o_orderkey") % 61 == 0, F.col("o_custkey")).otherwise(-1).alias("dst"))
    sites = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("edge"), F.col("l_orderkey").alias("owner"), (F.col("l_linenumber") - 1).alias("start"), F.col("l_linenumber").alias("end"))
    owners = orders.select(F.col("edge").alias("owner"), F.lit(0).alias("o_start"), F.lit(4).alias("o_end"))
    return _counted(integrity.opaque_edges(orders, spark.createDataFrame([(-1,)], "node long"), sites, owners))


@query(_oracle(("one group a product", "SELECT 1 FROM part WHERE p_partkey % 71 = 0"), ("known group", "SELECT 1 FROM part WHERE p_partkey % 71 = 0"), ("group has a root", "SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%3'")))
def v22_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products of their brands; some are in a second, unknown one, and some brands have no root."""
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("mgroup"))
    groups = members.select("mgroup").distinct()
    return _counted(integrity.products(members.union(members.where("product % 71 = 0").select("product", F.lit("none"))), groups, groups.where("mgroup not like '%3'")))


@query("WITH RECURSIVE up(set_id, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT u.set_id, u.node // 2 FROM up u WHERE u.node > 0) SELECT set_id, count(DISTINCT s_nationkey) AS n FROM up JOIN supplier ON s_suppkey = node WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def v23_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sets of nations below one another; nations of one region aren't permitted, for the set or those above it."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").cast("long").alias("unit_id"))
    parents = s.where("set_id > 0").select("set_id", F.floor(F.col("set_id") / 2).alias("parent_set_id"))
    permitted = table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").cast("long").alias("unit_id"))
    return integrity.permitted_provenance(s, parents, permitted).groupBy(F.col("key").cast("long").alias("set_id")).agg(F.count("*").alias("n"))


@query(_oracle(("output has a class", "SELECT 1 FROM orders WHERE o_orderkey % 83 = 0"), ("class has a meaning", "SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 83 <> 0")))
def v24_output_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outputs with their status as class; some have none, and one class has no meaning."""
    outputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("output"), F.when(F.col("o_orderkey") % 83 != 0, F.col("o_orderstatus")).alias("class"))
    return _counted(integrity.output_meaning(outputs, spark.createDataFrame([("F",), ("O",)], "class string")))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 19 = 0")
def v27_map_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order's lines as the lengths of pieces; the maps of some orders are one off in the output."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("long")).withColumn("i", F.row_number().over(w))
    end = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    off = (F.col("l_orderkey") % 19 == 0).cast("int")
    pieces = rows.withColumn("o", end).select(F.col("l_orderkey").alias("source_id"), (F.col("o") - F.col("n") + off).alias("out_start"), F.col("o").alias("out_end"), (F.col("o") - F.col("n") + 2 * F.col("i")).alias("orig_start"), (F.col("o") + 2 * F.col("i")).alias("orig_end"))
    return rewriting.map_gaps(pieces).agg(F.count("*").alias("n"))


_DAYS_SQL = "d AS (SELECT DISTINCT l_suppkey AS k, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS s, CAST(epoch(l_shipdate) // 86400 AS BIGINT) + l_linenumber AS e, l_returnflag AS f FROM lineitem)"


@query(f"WITH {_DAYS_SQL} SELECT k AS supplier_key, count(*) AS n FROM (SELECT DISTINCT k, s, e FROM d x WHERE f = 'R' AND EXISTS (SELECT 1 FROM d y WHERE y.f = 'N' AND y.k = x.k AND y.s < x.e AND x.s < y.e)) GROUP BY 1")
def v28_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned shipping periods, which are discarded, that touch a live one of the supplier."""
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), day.alias("start"), (day + F.col("l_linenumber")).alias("end"), "l_returnflag")
    return spans.touched(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'")).groupBy(F.col("source_id").alias("supplier_key")).agg(F.count("*").alias("n"))


# Lookups over forests and spans.


_OWN_SQL = "CASE event_type WHEN 'purchase' THEN node WHEN 'signup' THEN -node END"


@query(f"WITH {CHAIN_SQL} SELECT node AS event_id, last_value({_OWN_SQL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, node) AS unit FROM chain")
def j12_definition_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's own unit (a purchase, else a signup) or the one it inherits from the events before it."""
    own = F.coalesce(F.when(F.col("event_type") == "purchase", F.col("node")), F.when(F.col("event_type") == "signup", -F.col("node")))
    return closure.inherited(user_chain(spark, sf_dir).withColumn("unit", own), "unit").select(F.col("node").alias("event_id"), F.col("value").alias("unit"))


@query("WITH RECURSIVE f AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 8 THEN p_partkey // 8 END AS parent, p_size % 4 = 0 AS rep FROM part), up(node, above, hit) AS (SELECT node, parent, CAST(NULL AS BIGINT) FROM f UNION ALL SELECT u.node, f.parent, CASE WHEN f.rep THEN f.node END FROM up u JOIN f ON f.node = u.above WHERE u.hit IS NULL) SELECT node AS part_key, max(hit) AS repetition FROM up GROUP BY 1")
def j27_repetition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest repetition above each part in an eight-ary forest."""
    k = F.col("p_partkey")
    forest = table(spark, sf_dir, "part").select(k.alias("node"), F.when(k >= 8, F.floor(k / 8)).alias("parent"), (F.col("p_size") % 4 == 0).alias("rep"))
    return closure.nearest_ancestor(forest, F.col("rep")).select(F.col("node").alias("part_key"), F.col("ancestor").alias("repetition"))


_SITES_SQL = """sites AS (SELECT DISTINCT doc_id AS source_id, unnest([0, strlen(text) // 3, strlen(text) // 2, strlen(text) - 1]) AS start FROM documents WHERE text <> ''),
docs2 AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, -1 AS unit_id FROM documents UNION ALL SELECT doc_id, CAST(strlen(text) AS BIGINT), -2 FROM documents WHERE doc_id % 23 = 0)"""


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("n"))
    sites = docs.where("n > 0").select("source_id", F.explode(F.array(F.lit(0).cast("long"), F.expr("n div 3"), F.expr("n div 2"), F.col("n") - 1)).alias("start")).distinct()
    rows = lines(spark, sf_dir).select("source_id", F.col("line").alias("unit_id"), "start", "end", F.lit(1).alias("depth"), (F.octet_length("text") >= 60).alias("active"))
    whole = docs.select("source_id", F.lit(-1).cast("long").alias("unit_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(0).alias("depth"), F.lit(True).alias("active"))
    return sites.select("source_id", F.col("start").alias("site_id"), "start", (F.col("start") + 1).alias("end")), rows.unionByName(whole).unionByName(whole.where("source_id % 23 = 0").withColumn("unit_id", F.lit(-2).cast("long")))


def _owner_states(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    one, wrong = found
    kind = F.when(F.col("owner") >= 0, "line").otherwise("document")
    return one.groupBy(kind.alias("state")).agg(F.count("*").alias("n")).unionByName(wrong.groupBy(F.concat(F.lit("owners: "), F.col("n")).alias("state")).agg(F.count("*").alias("n")))


def _owners_sql(more: str) -> str:
    return f"""WITH {LINES_SQL}, {_SITES_SQL}, u AS (SELECT source_id, start, "end", line AS id, 1 AS depth FROM lines WHERE {more} UNION ALL SELECT doc_id, 0, n, unit_id, 0 FROM docs2),
p AS (SELECT s.source_id, s.start, u.id, rank() OVER (PARTITION BY s.source_id, s.start ORDER BY u."end" - u.start, u.depth DESC) AS r FROM sites s JOIN u ON u.source_id = s.source_id AND u.start <= s.start AND s.start + 1 <= u."end"),
c AS (SELECT source_id, start, count(*) AS n, min(id) AS id FROM p WHERE r = 1 GROUP BY ALL) SELECT CASE WHEN n > 1 THEN 'owners: ' || n WHEN id >= 0 THEN 'line' ELSE 'document' END AS state, count(*) AS n FROM c GROUP BY 1"""


@query(_owners_sql("true"))
def j4_unique_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by what their one innermost owner is, and violations; some documents are units twice."""
    return _owner_states(spans.unique_owners(*_sites(spark, sf_dir)))


@query(_owners_sql("strlen(text) >= 60"))
def j6_active_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among active units, lines of 60 bytes and documents."""
    return _owner_states(spans.active_owners(*_sites(spark, sf_dir)))


@query(f"""WITH {LINES_SQL}, h AS (SELECT source_id, min(start) AS s, max("end") AS e FROM lines WHERE line IN (0, 1) GROUP BY 1), b AS (SELECT doc_id AS source_id, 0 AS k, 0 AS s, strlen(text) AS e FROM documents UNION ALL SELECT doc_id, 1, 0, strlen(text) // 2 FROM documents UNION ALL SELECT doc_id, 2, strlen(text) // 2, strlen(text) FROM documents)
SELECT source_id, arg_min(k, (b.e - b.s, b.s, k)) AS brace FROM h JOIN b USING (source_id) WHERE b.s <= h.s AND h.e <= b.e GROUP BY 1""")
def j20_least_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first half, the second half or only the whole of a document holds its first two lines."""
    n = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.explode(F.array(F.struct(F.lit(0).alias("k"), zero.alias("s"), n.alias("e")), F.struct(F.lit(1).alias("k"), zero.alias("s"), F.floor(n / 2).alias("e")), F.struct(F.lit(2).alias("k"), F.floor(n / 2).alias("s"), n.alias("e")))).alias("b"))
    braces = docs.select("source_id", F.col("b.k").alias("brace_id"), F.col("b.s").alias("start"), F.col("b.e").alias("end"))
    leaves = lines(spark, sf_dir).where("line in (0, 1)").select("source_id", F.lit(0).alias("group_id"), "start", "end")
    return spans.least_enclosing(leaves, braces).select("source_id", F.col("brace_id").alias("brace"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT l.source_id, l.line, l.line % 4 AS d FROM lines l JOIN documents ON doc_id = l.source_id WHERE l.line % 4 > 0 AND l.line > 1 AND l."end" <= strlen(documents.text)), m AS (SELECT *, min(d) OVER (PARTITION BY source_id) AS least FROM t) SELECT source_id, CASE WHEN count(*) = 1 THEN min(line) END AS owner, CAST(CASE WHEN count(*) > 1 THEN count(*) END AS BIGINT) AS n FROM m WHERE d = least GROUP BY 1""")
def j26_shallowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shallowest line (by its number's remainder) within each document, or how many of that depth there are."""
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("target_id"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))
    anchors = lines(spark, sf_dir).where("line % 4 > 0 and line > 1").select("source_id", F.col("line").alias("node"), (F.col("line") % 4).alias("depth"), "start", "end")
    one, several = spans.shallowest_in(targets, anchors)
    return one.select("source_id", "owner", F.lit(None).cast("long").alias("n")).unionByName(several.select("source_id", F.lit(None).cast("long").alias("owner"), "n"))


@query("WITH RECURSIVE m AS (SELECT p_partkey // 4 AS g, p_partkey * 7 // 16 % 211 AS a FROM part WHERE p_size > 40), two AS (SELECT DISTINCT x.g AS a, y.g AS b FROM m x JOIN m y USING (a)), r(n, m) AS (SELECT g, g FROM m UNION SELECT r.n, t.b FROM r JOIN two t ON t.a = r.m) SELECT n AS group_id, min(m) AS merged_id FROM r GROUP BY 1")
def a12_atomic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of large parts that share an anchor, directly or by others, take the least of their numbers."""
    k = F.col("p_partkey")
    return closure.atomic_groups(table(spark, sf_dir, "part").where("p_size > 40").select(F.floor(k / 4).alias("group_id"), (F.floor(k * 7 / 16) % 211).alias("anchor")))


@query("WITH k AS (SELECT c_custkey AS node, 'c' || c_nationkey || c_mktsegment AS key FROM customer WHERE c_acctbal > 0), o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'), e AS (SELECT DISTINCT 'o' || o_orderkey AS a, key AS b, o_orderstatus AS kind, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 5 END AS ordinal FROM o JOIN k ON node = o_custkey), d AS (SELECT key FROM k GROUP BY 1 HAVING count(*) > 1) SELECT 'nodes' AS what, (SELECT count(*) FROM k) + (SELECT count(*) FROM o) AS n, CAST(0 AS BIGINT) AS ordinals UNION ALL SELECT 'edges', count(*), CAST(sum(ordinal) AS BIGINT) FROM e UNION ALL SELECT 'repeated keys', count(*), CAST(0 AS BIGINT) FROM d")
def d10_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of chosen customers and orders by key, edges of one kind without ordinals, and keys that nodes share."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = c.select((F.col("c_custkey") * 2).alias("node"), F.concat(F.lit("c"), "c_nationkey", "c_mktsegment").alias("key")).union(o.select(F.col("o_orderkey") * 2 + 1, F.concat(F.lit("o"), "o_orderkey")))
    edges = o.select((F.col("o_orderkey") * 2 + 1).alias("src"), (F.col("o_custkey") * 2).alias("dst"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 5).alias("ordinal"))
    chosen = c.where("c_acctbal > 0").select((F.col("c_custkey") * 2).alias("node")).union(o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey") * 2 + 1))
    kept, joined, twice = diffs.projected(nodes, edges, chosen, ["F"])
    zero = F.lit(0).cast("long").alias("ordinals")
    n = F.count("*").alias("n")
    return kept.agg(n).select(F.lit("nodes").alias("what"), "n", zero).unionByName(joined.agg(n, F.sum("ordinal").alias("ordinals")).select(F.lit("edges").alias("what"), "n", "ordinals")).unionByName(twice.agg(n).select(F.lit("repeated keys").alias("what"), "n", zero))


@query(f"WITH RECURSIVE {EDGES_SQL}, act AS (SELECT src AS node FROM edges WHERE src % 8 = 5 AND (src // 8) % 3 <> 0 UNION SELECT CAST(c_custkey AS BIGINT) * 8 + 2 FROM customer WHERE c_acctbal > 0 UNION SELECT CAST(n_nationkey AS BIGINT) * 8 + 1 FROM nation), m(node) AS (SELECT o_orderkey * 8 + 5 FROM orders WHERE o_totalprice > 350000 AND o_orderkey % 3 <> 0 UNION SELECT e.dst FROM m JOIN edges e ON e.src = m.node JOIN act ON act.node = e.dst) SELECT {TABLE_SQL} AS table_name, count(*) AS n, CAST(sum(node) AS BIGINT) AS node_sum FROM m GROUP BY 1")
def r19b_active_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What great active orders give meaning to, along edges between active rows."""
    edges = key_edges(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    active = orders.where("o_orderkey % 3 <> 0").select(node("orders", "o_orderkey").alias("node")).union(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(node("customer", "c_custkey"))).union(table(spark, sf_dir, "nation").select(node("nation", "n_nationkey")))
    found = closure.active_reach(edges, orders.where("o_totalprice > 350000").select(node("orders", "o_orderkey").alias("node")), active)
    return found.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


@query("WITH o AS (SELECT DISTINCT o_orderkey AS u, s_nationkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT 100000000 + n_regionkey, n_nationkey FROM nation), g AS (SELECT u, list_sort(list(k)) AS ks FROM o GROUP BY 1), r AS (SELECT 100 + n_regionkey AS id, list_sort(list(n_nationkey)) AS ks FROM nation GROUP BY 1), m AS (SELECT ks, min(u) AS first FROM g WHERE len(ks) > 1 GROUP BY 1) SELECT CAST(g.u AS BIGINT) AS union_id, CAST(CASE WHEN len(g.ks) = 1 THEN g.ks[1] WHEN r.id IS NOT NULL THEN r.id ELSE 1 + m.first + (SELECT max(id) FROM r) END AS BIGINT) AS set_id FROM g LEFT JOIN r ON r.ks = g.ks LEFT JOIN m ON m.ks = g.ks UNION ALL SELECT 200000000, -1")
def r14_parent_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of an order's suppliers' nations; regions are sets of nations already, and one union has an unknown set (root -1)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    unions = named.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").cast("long").alias("union_id"), F.col("s_nationkey").cast("long").alias("set_id"))
    unions = unions.union(nation.select(F.col("r") + 100000000, "k")).union(spark.createDataFrame([(200000000, 999)], "union_id long, set_id long"))
    local, parents = nation.select(F.col("k").alias("set_id"), F.col("k").alias("unit_id")), nation.select((F.col("r") + 100).alias("set_id"), F.col("k").alias("parent_set_id"))
    roots, _, wrong = closure.parent_unions(local, parents, unions)
    return roots.union(wrong.select("union_id", F.lit(-1).cast("long")))


@query("SELECT CAST(s_suppkey AS BIGINT) * 8 + 3 AS \"trigger\", CAST(s_nationkey AS BIGINT) * 8 + 1 AS required FROM supplier UNION SELECT CAST(c_custkey AS BIGINT) * 8 + 2, CAST(c_nationkey AS BIGINT) * 8 + 1 FROM customer WHERE c_acctbal > 0 UNION SELECT CAST(c_nationkey AS BIGINT) * 8 + 1, CAST(c_custkey AS BIGINT) * 8 + 2 FROM customer WHERE c_acctbal > 0")
def j24_derive_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask for their nations; customers in credit and their nations ask for each other."""
    influences = table(spark, sf_dir, "supplier").select(node("supplier", "s_suppkey").alias("trigger"), node("nation", "s_nationkey").alias("required"))
    helpers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(node("customer", "c_custkey").alias("attribute"), node("nation", "c_nationkey").alias("provider"))
    return gates.derive_requirements(influences, helpers)


# Lists, choices with triggers, sources and keys.


@query(f"""WITH {LINES_SQL}, w AS (SELECT source_id, line, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM lines), m AS (SELECT *, strlen(w) <= 6 AS k, max(i) OVER p AS n, last_value(strlen(w) <= 6) OVER p AS k_last FROM w WINDOW p AS (PARTITION BY source_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l AS (SELECT source_id, line, bool_or(k) AS k, coalesce(string_agg(w || CASE WHEN i = n OR (i = n - 1 AND NOT k_last) THEN '' ELSE ' ' END, '' ORDER BY i) FILTER (k), '') AS t FROM m GROUP BY 1, 2), x AS (SELECT *, max(line) OVER p AS n, last_value(k) OVER p AS k_last FROM l WINDOW p AS (PARTITION BY source_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT source_id, coalesce(string_agg(t || CASE WHEN line = n OR (line = n - 1 AND NOT k_last) THEN '' ELSE chr(10) END, '' ORDER BY line) FILTER (k), '') AS text FROM x GROUP BY 1""")
def e3_nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of more than six bytes leave the lists that lines are, and lines of such words alone the list of lines."""
    return rewriting.nested_within(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"), _lines_and_words)


def _lines_and_words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The lines of texts as elements of a list, each the list of its words, of which those of six bytes at most are kept."""
    text, start, end = split_spans(texts, b"\n")
    w_text, w_start, w_end = split_spans(texts, b"\n ")
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    line = np.searchsorted(begins[text] + start, begins[w_text] + w_start, "right") - 1

    def beside(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        last = np.append(of[1:] != of[:-1], True)[: len(of)]
        return [np.where(numbers_within(of) > 0, start - 1, -1), np.where(last, -1, end + 1)]

    outer = [text, np.full(len(text), -1), np.zeros(len(text), bool), np.zeros(len(text), bool), start, end, *beside(text, start, end)]
    inner = [w_text, line, np.ones(len(line), bool), w_end - w_start <= 6, w_start, w_end, *beside(line, w_start, w_end)]
    return tuple(np.concatenate(c) for c in zip(outer, inner, strict=True))


_LANE_SQL = """SELECT CAST(0 AS BIGINT) AS i, (SELECT list(s_suppkey) FROM supplier WHERE s_suppkey % 50 = 0 OR (lane = 'present' AND s_suppkey % 35 = 0)) AS kept, CAST(NULL AS BIGINT) AS disj, CAST(NULL AS BIGINT) AS pick, lane FROM (VALUES ('present'), ('demanded')) AS v(lane)"""


@query(f"""WITH RECURSIVE c AS (SELECT DISTINCT l_partkey AS disj, l_suppkey AS item, s_acctbal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT count(*) AS n FROM supplier),
d AS (SELECT disj, list(item) AS items, arg_min(item, (s_acctbal, item)) AS pick, CASE WHEN disj % 3 > 0 THEN disj * 7 % n END AS trig, row_number() OVER (ORDER BY disj) AS i FROM c, n GROUP BY disj, n),
w(i, kept, disj, pick, lane) AS ({_LANE_SQL}
 UNION ALL SELECT d.i, CASE WHEN list_has_any(w.kept, d.items) OR NOT (d.trig IS NULL OR list_contains(w.kept, d.trig)) THEN w.kept ELSE list_append(w.kept, d.pick) END, CASE WHEN list_has_any(w.kept, d.items) OR NOT (d.trig IS NULL OR list_contains(w.kept, d.trig)) THEN NULL ELSE d.disj END, d.pick, w.lane FROM w JOIN d ON d.i = w.i + 1)
SELECT lane, disj AS part_key, pick AS supplier_key FROM w WHERE disj IS NOT NULL""")
def c3_member_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts pick suppliers once among those present and once among those demanded, neither lane seeing the other's picks."""
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    rows = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    choices = rows.select(F.col("l_partkey").cast("long").alias("disj"), F.col("l_suppkey").cast("long").alias("item"), "s_acctbal").distinct()
    asks = choices.select("disj").distinct().select("disj", F.when(F.col("disj") % 3 > 0, F.col("disj") * 7 % n).alias("trigger"))
    nodes = supplier.select(F.col("s_suppkey").cast("long").alias("node"))
    found = choice.lanes(asks, choices.select("disj", "item"), choice.cheapest(choices, ["s_acctbal"]), nodes.where("node % 50 = 0 or node % 35 = 0"), nodes.where("node % 50 = 0"))
    return found.select("lane", F.col("disj").alias("part_key"), F.col("item").alias("supplier_key"))


@query(f"""WITH {LINES_SQL}, m AS (SELECT *, strlen(text) >= 60 AS k, lead(start) OVER w AS nx, lag("end") OVER w AS pv, line - row_number() OVER (PARTITION BY source_id, strlen(text) >= 60 ORDER BY line) AS g FROM lines WINDOW w AS (PARTITION BY source_id ORDER BY line)), a AS (SELECT source_id, bool_or(k) AS any_kept FROM m GROUP BY 1),
r AS (SELECT source_id, min(start) AS s, max("end") AS e, max(line) AS last, min(line) AS first FROM m WHERE NOT k GROUP BY source_id, g)
SELECT r.source_id, CASE WHEN b.nx IS NULL THEN coalesce(f.pv, r.s) ELSE r.s END AS start, coalesce(b.nx, r.e) AS "end" FROM r JOIN a USING (source_id) JOIN m b ON b.source_id = r.source_id AND b.line = r.last JOIN m f ON f.source_id = r.source_id AND f.line = r.first WHERE a.any_kept
UNION ALL SELECT doc_id, 0, CAST(strlen(text) AS BIGINT) FROM documents JOIN a ON a.source_id = doc_id WHERE NOT any_kept""")
def e6_repetition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of short lines go with one line break; all of the text, if all lines are short."""
    rows = lines(spark, sf_dir).select("source_id", F.lit(0).alias("rep_id"), F.col("line").alias("i"), "start", "end", (F.octet_length("text") >= 60).alias("kept"))
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("rep_id"), F.lit(0).cast("long").alias("input_start"), F.octet_length("text").cast("long").alias("input_end"))
    return rewriting.repetition_deletions(rows, inputs).select("source_id", "start", "end")


@query(f"WITH {LINES_SQL} SELECT doc_id AS source_id, coalesce(string_agg(l.text, chr(10) ORDER BY line) FILTER (strlen(l.text) >= 60), '') AS text FROM documents d JOIN lines l ON l.source_id = doc_id GROUP BY 1")
def e5_attribute_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines leave the list of a document's lines with their break; a list of short lines goes with all around it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    entries = lines(spark, sf_dir).select("source_id", F.lit(0).alias("list_id"), F.col("line").alias("i"), "start", "end")
    around = docs.select("source_id", F.lit(0).alias("list_id"), F.lit(0).cast("long").alias("list_start"), F.octet_length("text").cast("long").alias("list_end"))
    gone = rewriting.attribute_deletions(entries, F.col("end") - F.col("start") < 60, around)
    return rewriting.rewritten(docs.where("text is not null"), gone.select("source_id", "start", "end"))[0]


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_partkey AS disj, l_suppkey AS item, s_acctbal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT count(*) AS n FROM supplier),
d AS (SELECT disj, list(item) AS items, arg_min(item, (s_acctbal, item)) AS pick, CASE WHEN disj % 3 > 0 THEN disj * 7 % n END AS trig, row_number() OVER (ORDER BY disj) AS i FROM c, n GROUP BY disj, n),
w(i, kept, disj, pick) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
 UNION ALL SELECT d.i, CASE WHEN list_has_any(w.kept, d.items) OR NOT (d.trig IS NULL OR list_contains(w.kept, d.trig)) THEN w.kept ELSE list_append(w.kept, d.pick) END, CASE WHEN list_has_any(w.kept, d.items) OR NOT (d.trig IS NULL OR list_contains(w.kept, d.trig)) THEN NULL ELSE d.disj END, d.pick FROM w JOIN d ON d.i = w.i + 1)
SELECT disj AS part_key, pick AS supplier_key FROM w WHERE disj IS NOT NULL""")
def c4_triggered_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wave in which two of three parts only pick if a certain supplier was picked before them."""
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    rows = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    choices = rows.select(F.col("l_partkey").cast("long").alias("disj"), F.col("l_suppkey").cast("long").alias("item"), "s_acctbal").distinct()
    asks = choices.select("disj").distinct().select("disj", F.when(F.col("disj") % 3 > 0, F.col("disj") * 7 % n).alias("trigger"))
    found = choice.wave(asks, choices.select("disj", "item"), choice.cheapest(choices, ["s_acctbal"]), choices.select("item").limit(0))
    return found.select(F.col("disj").alias("part_key"), F.col("item").alias("supplier_key"))


@query("SELECT doc_id AS source_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS byte_len, len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n_stretches FROM documents WHERE text IS NOT NULL")
def s4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with CR LF and byte-order marks put in, normalised back, and how many stretches their offset maps have."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("source_id"), F.concat(F.when(F.col("doc_id") % 2 == 0, "﻿").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("text"))
    found, pieces = files.normalized(docs)
    counts = pieces.groupBy("source_id").agg(F.count("*").alias("n"))
    return found.join(counts, "source_id", "left").select("source_id", F.sha2("text", 256).alias("digest"), "byte_len", F.coalesce("n", F.lit(0)).alias("n_stretches"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_keys, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) AS n_below")
def x15_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of lines' keys are as many as the keys; and the keys that begin with those of first lines."""
    path = F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    first = F.array(F.col("l_orderkey").cast("string"), F.lit("1"))
    rows = table(spark, sf_dir, "lineitem").select(X.key_hash(F.col("l_orderkey"), F.col("l_linenumber")).alias("h"), X.is_key_prefix(first, path).alias("below"))
    keys = rows.groupBy("h").agg(F.count("*").alias("k"), F.count_if("below").alias("b"))
    return keys.agg(F.count("*").alias("n_keys"), F.sum("k").alias("n_rows"), F.sum("b").alias("n_below"))


@query("SELECT n_regionkey AS parent, n_nationkey AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place FROM nation")
def w10_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that claim to be one more than the nations' places among their siblings, each therefore reported with its place."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("node"), "n_name")
    numbered = ordinals.sibling_ordinals(rows, ["parent"], "n_name")[0].withColumn("claimed", F.col("ordinal") + 1)
    return ordinals.gaps_in_ordinals(numbered, ["parent"], "claimed").select("parent", "node", "place")
