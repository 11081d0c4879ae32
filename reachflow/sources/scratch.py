"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task of a written or shuffled table of texts takes about so many bytes.
TASK_BYTES = 24_000_000
#: A writer holds so many bytes of a file's rows before it writes them.
GROUP_BYTES = 32_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, in one folder for the application.

    Where that is unset, a local master gets a temporary folder; a cluster is an error, as its executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "reachflow-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/reachflow-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Removes all tables that this application wrote to the scratch folder; results that read them must have been consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.dirname(scratch(spark)))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the scratch folder: computed once, lineage cut, readable by every executor."""
    path = path or scratch(df.sparkSession)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """written(), in buckets of the column: joins on it don't shuffle this side. The catalogue doesn't keep the table.

    Beyond as many buckets as Spark allows, each holds more rows.
    """
    spark, name = df.sparkSession, f"reachflow_{uuid.uuid4().hex}"
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").option("parquet.block.size", GROUP_BYTES).option("path", scratch(spark)).bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolves it before the name goes; the files of a table with a path stay
    spark.sql(f"DROP TABLE {name}")
    return table


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by one aggregate."""
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def tasks_for(total_bytes: int, task_bytes: int = TASK_BYTES) -> int:
    """How many tasks it takes, whatever the cluster's settings are, so that each has about task_bytes."""
    return max(1, -(-total_bytes // task_bytes))


def narrow(df: DataFrame) -> DataFrame:
    """written() for the tables of a loop, in files of the advised partition size: small rounds make few files, large ones keep their tasks."""
    return written(df.hint("rebalance"))


def keyed(df: DataFrame, column: str) -> DataFrame:
    """bucketed(), a file a bucket, in as many buckets as the session's shuffles have: for a table that each round of a loop joins on the column."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(df.repartition(n, column), column, n)


class Rounds:
    """A table that a loop adds to: each part is written once, and all of them are read by one scan, however many there are."""

    def __init__(self):
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """The part, read back."""
        self.schema, self.spark = df.schema, df.sparkSession
        self.paths.append(scratch(self.spark))
        df.hint("rebalance").write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def every(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
