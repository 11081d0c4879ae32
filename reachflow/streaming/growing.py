"""An extension that the reference lacks: reachability over an edge stream that only grows.

Each micro-batch adds its edges to a table and takes the closure on from the nodes that they newly reach; nodes found
are never taken back, so that deletions need a full recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reachflow.operators.closure import reachable
from reachflow.sources.scratch import written


def grow_reachable(stream: DataFrame, roots: DataFrame, path: str) -> StreamingQuery:
    """Starts a query that keeps `path`/edges and `path`/nodes (the roots and what they reach) up to date with a stream of (src, dst).

    The checkpoint stands below `path`, so that a query started again goes on where the last one ended, with the roots
    that are new. A batch that is run again after a failure adds edges that are there already, which changes nothing.
    """
    spark = stream.sparkSession
    schema = roots.select("node").schema

    def seen() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/nodes")

    roots.select("node").distinct().limit(0).write.mode("append").parquet(f"{path}/nodes")
    stream.sparkSession.createDataFrame([], stream.select("src", "dst").schema).write.mode("append").parquet(f"{path}/edges")

    def expand(starts: DataFrame) -> None:
        """Takes in the starts that aren't there and what they lead to; nodes found before are neither expanded nor passed again."""
        edges = spark.read.schema(stream.select("src", "dst").schema).parquet(f"{path}/edges")
        fresh = written(starts.select("node").where("node is not null").distinct().join(seen(), "node", "left_anti"))
        if not fresh.isEmpty():
            open_ = edges.join(seen().select(F.col("node").alias("dst")), "dst", "left_anti")
            written(reachable(open_, fresh)).write.mode("append").parquet(f"{path}/nodes")

    def add(batch: DataFrame, number: int) -> None:
        batch.select("src", "dst").write.mode("append").parquet(f"{path}/edges")
        expand(batch.join(seen().select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")))

    expand(roots)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
