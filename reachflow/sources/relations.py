"""Typed graphs, forests, spans and rules, derived from the ordinary tables.

A node of the foreign-key graph is one number: id * 8 + the number of its table, so that edges are pairs of bigints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Child table, its id, parent table, the column that names the parent.
LINKS = (
    ("nation", "n_nationkey", "region", "n_regionkey"),
    ("customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "s_suppkey", "nation", "s_nationkey"),
    ("orders", "o_orderkey", "customer", "o_custkey"),
    ("lineitem", "l_orderkey * 8 + l_linenumber", "orders", "l_orderkey"),
    ("lineitem", "l_orderkey * 8 + l_linenumber", "part", "l_partkey"),
    ("lineitem", "l_orderkey * 8 + l_linenumber", "supplier", "l_suppkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(name: str, key: str) -> Column:
    """The node of a row of the table, from an expression of its id."""
    return F.expr(f"cast({key} as bigint) * 8 + {TABLES.index(name)}")


def table_of(column: str = "node") -> Column:
    """The name of the table that a node is of."""
    return F.element_at(F.array(*[F.lit(t) for t in TABLES]), (F.pmod(F.col(column), F.lit(8)) + 1).cast("int"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind: every row leads to the rows that it names."""
    out = None
    for child, key, parent, column in LINKS:
        rows = table(spark, sf_dir, child).select(node(child, key).alias("src"), node(parent, column).alias("dst"), F.lit(f"{child}-{parent}").alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: The same edges for DuckDB.
EDGES_SQL = "edges AS (" + " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) * 8 + {TABLES.index(child)} AS src, CAST({column} AS BIGINT) * 8 + {TABLES.index(parent)} AS dst, '{child}-{parent}' AS kind FROM {child}" for child, key, parent, column in LINKS) + ")"
TABLE_SQL = "CASE node % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TABLES)) + " END"


def user_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, user_id, event_type: each user's events, every one below the one before it."""
    events = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_id").alias("node"), before.alias("parent"), "user_id", "event_type")


CHAIN_SQL = "chain AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, user_id, event_type, ts FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, line, start, end, text: the lines of every document with the byte span of each, its line break left out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.split("text", "\n").alias("parts"))
    rows = docs.select("source_id", F.posexplode("parts").alias("line", "text"))
    end = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("source_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("end", end).select("source_id", F.col("line").cast("long").alias("line"), (F.col("end") - F.octet_length("text")).alias("start"), "end", "text")


LINES_SQL = """parts AS (SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
lines AS (SELECT source_id, CAST(line AS BIGINT) AS line, text, CAST(sum(strlen(text) + 1) OVER (PARTITION BY source_id ORDER BY line) - 1 AS BIGINT) AS "end",
 CAST(sum(strlen(text) + 1) OVER (PARTITION BY source_id ORDER BY line) - 1 - strlen(text) AS BIGINT) AS start FROM parts)"""
