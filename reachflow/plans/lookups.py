"""Further queries: lookups over spans, intrinsic constraints, orders by witnesses, common frontiers, meaning, rewriting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachflow.functions.text import numbers_within, split_spans
from reachflow.operators import closure, ordinals, rewriting, spans
from reachflow.operators.retention import Facts, retained
from reachflow.plans.registered import query
from reachflow.sources.relations import EDGES_SQL, LINES_SQL, TABLE_SQL, key_edges, lines, node, table, table_of
from reachflow.sources.scratch import written

_WORDS_SQL = f"""{LINES_SQL}, w0 AS (SELECT source_id, line, start, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM lines),
words AS (SELECT source_id, line, i, w, CAST(start + sum(strlen(w) + 1) OVER (PARTITION BY source_id, line ORDER BY i) - 1 - strlen(w) AS BIGINT) AS ws, CAST(start + sum(strlen(w) + 1) OVER (PARTITION BY source_id, line ORDER BY i) - 1 AS BIGINT) AS we FROM w0)"""


def _words_and_lines(texts: list[bytes]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The words of texts as pieces; their lines, numbered from 0, and the whole texts, of number -1, as units."""
    text, start, end = split_spans(texts, b"\n ")
    words = tuple(x[start < end] for x in (text, start, end))
    text, start, end = split_spans(texts, b"\n")
    n, one = len(texts), np.ones(len(text), np.int64)
    whole = np.arange(n), np.zeros(n, np.int64), np.array([len(t) for t in texts], np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, -1)
    return words, tuple(np.concatenate(c) for c in zip((text, start, end, one, one * 0, numbers_within(text)), whole, strict=True))


@query(f"WITH {_WORDS_SQL} SELECT source_id, ws AS start, we AS \"end\", line AS owner FROM words WHERE w <> ''")
def j3_piece_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one owner of each word of every document, the deepest unit around it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return spans.owners_within(docs, _words_and_lines)


@query("WITH o AS (SELECT l_partkey AS site_id, bool_and(s_acctbal > 0) AS a, bool_or(s_acctbal > 0) AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) SELECT CASE WHEN a = b AND a THEN 'kept' WHEN a = b THEN 'gone' ELSE 'disagree' END AS state, count(*) AS n FROM o GROUP BY 1")
def j5_site_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts (sites) all of whose suppliers (owners) are solvent, none of them, or a violation."""
    owners = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site_id"), F.col("l_suppkey").alias("owner"))
    kept = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("owner"))
    agreed, wrong = spans.site_retained(owners, kept)
    state = F.when(F.col("kept"), "kept").otherwise("gone")
    return agreed.select(state.alias("state")).union(wrong.select(F.lit("disagree"))).groupBy("state").agg(F.count("*").alias("n"))


_PERIODS_SQL = "p AS (SELECT DISTINCT l_suppkey AS source_id, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS start, CAST(epoch(l_shipdate) // 86400 AS BIGINT) + l_linenumber AS \"end\" FROM lineitem), r AS (SELECT source_id, start AS range_id, start, start + 2 AS \"end\" FROM (SELECT DISTINCT source_id, start FROM p)), c AS (SELECT r.source_id, r.range_id, p.start AS s, p.\"end\" AS e, p.\"end\" - p.start AS n FROM r JOIN p ON p.source_id = r.source_id AND p.start <= r.start AND r.\"end\" <= p.\"end\")"


@query(f"WITH {_PERIODS_SQL}, m AS (SELECT *, min(n) OVER (PARTITION BY source_id, range_id) AS least FROM c), best AS (SELECT source_id, range_id, min(s * 100 + n) AS child_id, count(*) AS k FROM m WHERE n = least GROUP BY ALL), x AS (SELECT DISTINCT r.source_id, r.range_id FROM r JOIN p ON p.source_id = r.source_id AND p.start < r.\"end\" AND r.start < p.\"end\" AND NOT (p.start <= r.start AND r.\"end\" <= p.\"end\") AND NOT (r.start <= p.start AND p.\"end\" <= r.\"end\")) SELECT source_id, 'child' AS what, count(*) AS n, CAST(sum(child_id) AS BIGINT) AS ids FROM best GROUP BY 1 UNION ALL SELECT source_id, 'tie', count(*), NULL FROM best WHERE k > 1 GROUP BY 1 UNION ALL SELECT source_id, 'partial', count(*), NULL FROM x GROUP BY 1")
def j9_child_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest shipping period around the two days from each begin, ties and partial overlaps."""
    return children_containing(table(spark, sf_dir, "lineitem"))


def children_containing(of: DataFrame) -> DataFrame:
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    periods = written(of.select(F.col("l_suppkey").alias("source_id"), day.alias("start"), (day + F.col("l_linenumber")).alias("end")).distinct())
    children = periods.withColumn("child_id", F.col("start") * 100 + F.col("end") - F.col("start"))
    ranges = periods.select("source_id", F.col("start").alias("range_id"), "start", (F.col("start") + 2).alias("end")).distinct()
    best, wrong = spans.child_containing(ranges, children)
    one = best.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("child_id").alias("ids")).select("source_id", F.lit("child").alias("what"), "n", "ids")
    return one.unionByName(wrong.groupBy("source_id", F.col("why").alias("what")).agg(F.count("*").alias("n")).withColumn("ids", F.lit(None).cast("long")))


@query(f"WITH {LINES_SQL}, kept AS (SELECT source_id, line FROM lines WHERE strlen(text) >= 60) SELECT source_id, start, \"end\" FROM lines WHERE (source_id, line) NOT IN (SELECT source_id, line FROM kept) AND line % 5 <> 4")
def e2_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go below their kept document, but for those that a list manages."""
    rows = lines(spark, sf_dir)
    units = rows.select("source_id", F.col("line").alias("unit_id"), F.lit(-1).cast("long").alias("parent_id"), F.when(F.col("line") % 5 == 4, "list").otherwise("line").alias("kind"), "start", "end")
    kept = rows.where(F.octet_length("text") >= 60).select("source_id", F.col("line").alias("unit_id")).union(table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("long")))
    return rewriting.frontier(units, kept, ["list"])


@query(f"WITH {LINES_SQL}, slots AS (SELECT source_id, line // 3 AS slot_id, bool_or(strlen(text) >= 60) AS live FROM lines GROUP BY ALL) SELECT l.source_id, l.start, l.\"end\" FROM lines l JOIN slots s ON s.source_id = l.source_id AND s.slot_id = l.line // 3 WHERE NOT s.live")
def e8_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of slots of three of which no line is kept."""
    rows = lines(spark, sf_dir).withColumn("slot_id", F.floor(F.col("line") / 3))
    slots = rows.select("source_id", "slot_id", F.col("line").alias("unit_id"))
    kept = rows.where(F.octet_length("text") >= 60).select("source_id", F.col("line").alias("unit_id"))
    return rewriting.capture_deletions(slots, rows.select("source_id", "slot_id", "start", "end"), kept)


@query(f"WITH {LINES_SQL}, kept AS (SELECT source_id, line FROM (SELECT *, row_number() OVER (PARTITION BY source_id, text ORDER BY line) AS r FROM lines) WHERE r = 1) SELECT source_id, count(*) AS n_surviving FROM kept JOIN lines USING (source_id, line) WHERE text <> '' GROUP BY 1")
def p12_node_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which the last byte survives when repeated lines go (a range join with the piece map)."""
    from reachflow.plans.catalogue import _repeated_lines

    _, pieces = rewriting.rewritten(*_repeated_lines(spark, sf_dir))
    last = lines(spark, sf_dir).where("text <> ''").select("source_id", "line", (F.col("end") - 1).alias("start"), "end")
    kept = spans.containing(last, pieces.select("source_id", F.col("orig_start").alias("start"), F.col("orig_end").alias("end")))
    return kept.groupBy("source_id").agg(F.count("*").alias("n_surviving"))


@query("SELECT s.l_suppkey AS supplier_key, s.l_partkey AS part_key, s.l_linenumber AS site FROM (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 45) s UNION ALL SELECT DISTINCT l_suppkey, l_partkey, NULL FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_quantity > 45 AND y.l_suppkey = x.l_suppkey AND y.l_partkey = x.l_partkey)")
def p11_split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each site, and the edges without any as they are."""
    site = F.when(F.col("l_quantity") > 45, F.col("l_linenumber"))
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("part_key")).agg(F.collect_set(site).alias("sites"))
    return edges.select("supplier_key", "part_key", F.explode_outer("sites").alias("site"))


@query("WITH s AS (SELECT c_custkey AS child, CAST(c_nationkey AS BIGINT) AS parent, c_mktsegment AS g FROM customer WHERE c_acctbal > 0) SELECT 'ancestor' AS class, count(*) AS n FROM s UNION ALL SELECT 'atomic', count(DISTINCT (parent, g)) FROM s UNION ALL SELECT 'member', count(*) FROM s")
def s17_intrinsic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that units alone imply: each its parent, each its atomic group, by class."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    ancestor = rows.select(F.col("c_custkey").alias("trigger"), F.col("c_nationkey").alias("required")).withColumn("class", F.lit("ancestor"))
    groups = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("size"))
    parts = ancestor.groupBy("class").agg(F.count("*").alias("n")), groups.agg(F.count("*").alias("n")).select(F.lit("atomic").alias("class"), "n"), groups.agg(F.sum("size").alias("n")).select(F.lit("member").alias("class"), "n")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH r AS (SELECT p_partkey, p_brand, p_size % 5 AS k, CASE WHEN p_brand LIKE '%1' THEN p_name END AS w1, CASE WHEN p_size % 5 > 0 THEN CAST(p_retailprice AS VARCHAR) END AS w2, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) - 1 AS raw FROM part), g AS (SELECT p_brand, k, count(*) AS n, count(w1) AS h1, count(DISTINCT w1) AS d1, count(w2) AS h2, count(DISTINCT w2) AS d2 FROM r GROUP BY ALL), x AS (SELECT r.*, n, CASE WHEN h1 = n AND d1 = n THEN 0 WHEN h1 > 0 THEN 2 WHEN h2 = n AND d2 = n THEN 1 ELSE 2 END AS rule FROM r JOIN g USING (p_brand, k)) SELECT p_partkey AS part_key, CASE WHEN rule = 2 AND n > 1 THEN raw ELSE row_number() OVER (PARTITION BY p_brand, k ORDER BY CASE WHEN rule = 0 THEN w1 END NULLS FIRST, CASE WHEN rule = 1 THEN w2 END NULLS FIRST, raw) - 1 END AS ordinal FROM x")
def w4_witness_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size class ordered by the first witness that tells all apart, else as they stood."""
    raw = F.row_number().over(Window.partitionBy("p_brand", "k").orderBy("p_partkey")) - 1
    rows = table(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 5).withColumn("raw", raw)
    rows = rows.withColumn("w1", F.when(F.col("p_brand").endswith("1"), F.col("p_name"))).withColumn("w2", F.when(F.col("k") > 0, F.col("p_retailprice").cast("string")))
    return ordinals.witness_ordinals(rows.select("p_partkey", "p_brand", "k", "raw", "w1", "w2"), ["p_brand", "k"], ["w1", "w2"], "raw").select(F.col("p_partkey").alias("part_key"), "ordinal")


@query(f"WITH RECURSIVE {EDGES_SQL}, a(node) AS (SELECT (l_orderkey * 8 + l_linenumber) * 8 + 6 FROM lineitem WHERE l_quantity = 50 UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node), b(node) AS (SELECT (l_orderkey * 8 + l_linenumber) * 8 + 6 FROM lineitem WHERE l_quantity = 49 UNION SELECT e.dst FROM b JOIN edges e ON e.src = b.node), c AS (SELECT node FROM a INTERSECT SELECT node FROM b) SELECT {TABLE_SQL} AS table_name, count(*) AS n, CAST(sum(node) AS BIGINT) AS node_sum FROM c WHERE node NOT IN (SELECT e.dst FROM edges e WHERE e.src IN (SELECT node FROM c)) GROUP BY 1")
def d8_common_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest rows that lines of two quantities both lead to."""
    edges = key_edges(spark, sf_dir)
    line = node("lineitem", "l_orderkey * 8 + l_linenumber").alias("node")
    rows = table(spark, sf_dir, "lineitem")
    found = closure.frontier_intersection(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")), rows.where("l_quantity = 50").select(line), rows.where("l_quantity = 49").select(line))
    return found.groupBy(table_of().alias("table_name")).agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


@query(f"WITH RECURSIVE {EDGES_SQL}, m(node) AS (SELECT o_orderkey * 8 + 5 FROM orders WHERE o_totalprice > 400000 UNION SELECT e.dst FROM m JOIN edges e ON e.src = m.node WHERE e.kind <> 'nation-region'), every AS (SELECT CAST(c_custkey AS BIGINT) * 8 + 2 AS node FROM customer UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1 FROM nation) SELECT {TABLE_SQL} AS table_name, node IN (SELECT node FROM m) AS meaningful, count(*) AS n FROM every GROUP BY ALL")
def r17_output_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations that mean something through a great order, and those that don't (complement)."""
    edges = key_edges(spark, sf_dir).where("kind <> 'nation-region'")
    seeds = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(node("orders", "o_orderkey").alias("node"))
    found = closure.reachable(edges, seeds).withColumn("meaningful", F.lit(True))
    every = table(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("node")).union(table(spark, sf_dir, "nation").select(node("nation", "n_nationkey")))
    return every.join(found, "node", "left").groupBy(table_of().alias("table_name"), F.coalesce("meaningful", F.lit(False)).alias("meaningful")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EDGES_SQL}, walk(node, n) AS (SELECT src, 0 FROM edges UNION SELECT dst, 0 FROM edges UNION SELECT e.src, w.n + 1 FROM walk w JOIN edges e ON e.dst = w.node), top AS (SELECT node, max(n) AS level FROM walk GROUP BY 1) SELECT {TABLE_SQL} AS table_name, level, count(*) AS n FROM top GROUP BY ALL")
def r23_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a dependency order over all rows, by table."""
    edges = key_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return closure.levels(edges, nodes).groupBy(table_of().alias("table_name"), "level").agg(F.count("*").alias("n"))


@query("""WITH great AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM great)),
n AS (SELECT DISTINCT c_nationkey FROM c), r AS (SELECT DISTINCT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM n)),
kept AS (SELECT 'orders' AS table_name, o_orderkey AS id FROM great UNION ALL SELECT 'customer', c_custkey FROM c UNION ALL SELECT 'nation', c_nationkey FROM n UNION ALL SELECT 'region', n_regionkey FROM r)
SELECT what, table_name, count(*) AS n FROM kept, (VALUES ('present'), ('demanded')) AS w(what) GROUP BY ALL UNION ALL SELECT 'unit', table_name, count(*) FROM kept WHERE table_name IN ('orders', 'customer') GROUP BY ALL
UNION ALL SELECT 'unit', 'supplier', count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM n) HAVING count(*) > 0""")
def r29_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What great orders keep of the foreign-key graph under all rules; tests hold the operator against a plain fixed point.

    Orders and customers are units bound to their nodes; a customer's edge to its nation has all its great orders as
    owners of its site; each kept customer asks for one supplier of its nation.
    """
    edges = key_edges(spark, sf_dir).where("kind in ('orders-customer', 'customer-nation', 'nation-region')").withColumn("edge", F.struct("src", "dst"))
    orders, customers, suppliers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    great = orders.where("o_totalprice > 400000").select(node("orders", "o_orderkey").alias("unit"), node("customer", "o_custkey").alias("src"))
    units = edges.select(F.col("src").alias("node")).where("node % 8 in (2, 5)").distinct().withColumn("unit", F.col("node"))
    lists = customers.select(node("customer", "c_custkey").alias("disj"), F.col("c_nationkey").cast("long").alias("list"))
    offers = suppliers.select(F.col("s_nationkey").cast("long").alias("list"), node("supplier", "s_suppkey").alias("item"), F.col("s_acctbal").alias("cost"))
    facts = Facts.of(
        spark,
        ["cost"],
        roots=great.select(F.col("unit").alias("node")),
        edges=edges.select("edge", "src", "dst"),
        sites=edges.where("kind = 'customer-nation'").join(great, "src").select("edge", F.lit("s").alias("site"), F.col("unit").alias("owner")),
        binding=units,
        groups=units.select("unit", F.col("unit").alias("group_id")),
        disjunctions=lists.select("disj", F.col("disj").alias("trigger")).distinct(),
        choice_lists=lists,
        list_offers=offers,
    )
    kept = retained(facts)
    count = F.count("*").alias("n")
    out = kept.present.groupBy(table_of().alias("table_name")).agg(count).select(F.lit("present").alias("what"), "table_name", "n")
    out = out.unionByName(kept.demanded.groupBy(table_of().alias("table_name")).agg(count).select(F.lit("demanded").alias("what"), "table_name", "n"))
    return out.unionByName(kept.units.groupBy(table_of("unit").alias("table_name")).agg(count).select(F.lit("unit").alias("what"), "table_name", "n"))
