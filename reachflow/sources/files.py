"""Texts and facts in and out: whole files, tables, and writes that don't overwrite what has changed."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """source_id (the file's path), text, byte_len, digest: a row for each text file below the path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text"))
    return rows.withColumn("byte_len", F.octet_length("text").cast("long")).withColumn("digest", F.sha2("text", 256))


def normalized(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts without a byte-order mark and with line feeds for CR LF, and the map from their offsets to the originals.

    The map (source_id, out_start, out_end, orig_start, orig_end) has a row for each stretch that moved as one; null
    texts stay null and have none. A lone CR stays.
    """
    mark = "﻿"
    bare = F.when(F.col("text").startswith(mark), F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    lead = F.when(F.col("text").startswith(mark), 3).otherwise(0)
    parts = sources.select("source_id", lead.alias("lead"), F.posexplode(F.split(bare, "\r\n")).alias("i", "part"))
    w = Window.partitionBy("source_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("part").cast("long")
    # A stretch is a line with its line feed; its CR, if the stretch isn't the last, is left out before it.
    ends = parts.withColumn("n", size).withColumn("upto", F.sum(size + 1).over(w)).withColumn("last", F.col("i") == F.max("i").over(Window.partitionBy("source_id")))
    out_start = F.col("upto") - F.col("n") - 1
    orig_start = out_start + F.col("i") + F.col("lead")
    rows = ends.select("source_id", out_start.alias("out_start"), (out_start + F.col("n")).alias("out_end"), orig_start.alias("orig_start"), (orig_start + F.col("n")).alias("orig_end"))
    text = F.replace(bare, F.lit("\r\n"), F.lit("\n"))
    return sources.withColumn("text", text).withColumn("byte_len", F.octet_length(text).cast("long")), rows.where("out_start < out_end")


def write_new(df: DataFrame, path: str) -> None:
    """Writes a table to a place that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def changed_since(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """source_id: sources of a table whose digest isn't the one seen (or that are gone or new)."""
    now = spark.read.parquet(path).select("source_id", F.sha2("text", 256).alias("now"))
    both = now.join(seen.select("source_id", F.col("digest").alias("was")), "source_id", "full")
    return both.where("not (now <=> was)").select("source_id")


def replace_unchanged(df: DataFrame, path: str, seen: DataFrame) -> bool:
    """Replaces a table of sources if none has changed since it was read; whether it did.

    What is written equals df row for row; nothing is written if that is already there. The new table is written
    beside the old one and takes its name by two renames; a run that breaks off leaves the old one in place or, between
    the renames, as `path`.old. Another writer's change is noticed up to the last check before the renames.
    """
    spark = df.sparkSession
    if not changed_since(spark, path, seen).isEmpty():
        return False
    here = spark.read.parquet(path)
    if df.exceptAll(here).isEmpty() and here.exceptAll(df).isEmpty():
        return True
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    if not changed_since(spark, path, seen).isEmpty():
        return False
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)]
    fs = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(paths[2], True)
    if not (fs.rename(paths[0], paths[2]) and fs.rename(paths[1], paths[0])):
        raise OSError(f"{path} could not be replaced")
    fs.delete(paths[2], True)
    spark.catalog.refreshByPath(path)
    return True


class Versioned:
    """A table at `path` that is replaced as a whole, in one step.

    Each version is a folder of its own; a numbered manifest names the current one. A manifest is made only where none of
    its number is yet, so that of two writers one wins, and counts once its last byte is there. A run that breaks off
    at any step leaves the old version or the new one; folders that no manifest names are swept by the next replacement
    that wins. The version before the current one stays for its readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.hadoop.Path("/".join([self.path, *names]))

    def listed(self, folder: str) -> list[str]:
        where = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def newest(self) -> tuple[int, str | None]:
        """The greatest number of any manifest, 0 without one, and the version that the newest whole manifest names."""
        names = self.listed("_manifests")
        for name in reversed(names):
            stream = self.fs.open(self.at("_manifests", name))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return int(names[-1]), text[:-1]
        return (int(names[-1]) if names else 0), None

    def current(self) -> str | None:
        """The name of the current version; None if there is none yet."""
        return self.newest()[1]

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(str(self.at("versions", version)))

    def replace(self, df: DataFrame, expected: str | None) -> bool:
        """Makes df the current version if `expected` still is; whether it did. Equal rows need no new version."""
        if self.current() != expected:
            return False
        if expected is not None:
            here = self.read()
            if here.schema == df.schema and df.exceptAll(here).isEmpty() and here.exceptAll(df).isEmpty():
                return True
        version = uuid.uuid4().hex
        df.write.parquet(str(self.at("versions", version)))
        return self.commit(version, expected)

    def commit(self, version: str, expected: str | None) -> bool:
        """Names the version in the next manifest, unless another writer has."""
        number, now = self.newest()
        if now != expected:
            return False
        try:
            stream = self.fs.create(self.at("_manifests", f"{number + 1:012d}"), False)
        except Py4JJavaError as taken:
            if self.current() == expected and "already exists" not in str(taken.java_exception):
                raise
            return False
        try:
            stream.write(f"{version}\n".encode())
        finally:
            stream.close()
        self.sweep(version, expected)
        return True

    def sweep(self, *keep: str | None) -> None:
        for version in self.listed("versions"):
            if version not in keep:
                self.fs.delete(self.at("versions", version), True)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A relation of facts from JSON lines; lines that don't fit the schema raise an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
