"""The catalog on Parquet: snapshots with an upsert by key, status updates, deletes, vector and graph sinks."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..streaming.events import latest


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, in a local session that names none, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sediment-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/sediment-{tag}-{uuid.uuid4().hex}"


class Catalog:
    """Tables under one folder: each is its newest whole snapshot and the rows appended since.

    A snapshot's folder, and that of an append, is named by its time, so readers see what is whole, whatever a writer does.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def parts(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().toString() for x in store.listStatus(path)] if store.exists(path) else []
        done = sorted(p for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))
        whole = max((i for i, p in enumerate(done) if not p.endswith("-more")), default=0)
        return done[whole:]

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def missing(self, names: list[str]) -> list[str]:
        return [n for n in names if not self.exists(n)]

    def read(self, name: str) -> DataFrame:
        first, *more = [self.spark.read.parquet(p) for p in self.parts(name)]
        for m in more:
            first = first.unionByName(m, allowMissingColumns=True)
        return first

    def write(self, name: str, df: DataFrame, more: bool = False) -> None:
        df.write.parquet(f"{self.folder}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}{'-more' if more else ''}")

    def replace(self, name: str, df: DataFrame) -> None:
        self.write(name, df)

    def insert(self, name: str, rows: DataFrame, key: list[str] | None = None) -> None:
        """Append rows; with a key, raise where the table has one of theirs."""
        if key and self.exists(name) and not rows.join(self.read(name).select(*key), key, "left_semi").isEmpty():
            raise ValueError(f"{name} has rows of these keys already")
        self.write(name, rows, self.exists(name))

    def upsert(self, name: str, rows: DataFrame, key: list[str], version: str | None = None) -> None:
        self.replace(name, latest(self.read(name) if self.exists(name) else rows.limit(0), rows, key, version))

    def delete(self, name: str, where: Column) -> None:
        self.replace(name, self.read(name).filter(~F.coalesce(where, F.lit(False))))

    def delete_keys(self, name: str, keys: DataFrame) -> None:
        self.replace(name, self.read(name).join(keys, keys.columns, "left_anti"))

    def update_status(self, name: str, updates: DataFrame, key: str, now: Column) -> None:
        """Statuses of updates (key, new_status); indexed_at is set where the status becomes indexed."""
        rows = self.read(name).join(updates, key, "left")
        rows = rows.withColumn("indexed_at", F.when(F.col("new_status") == "indexed", now).otherwise(F.col("indexed_at"))).withColumn("status", F.coalesce("new_status", "status"))
        self.replace(name, rows.drop("new_status"))

    def update_jobs(self, name: str, updates: DataFrame, key: str, now: Column) -> None:
        """Statuses of jobs by updates (key, new_status, new_error): running sets started_at, an end sets completed_at and error."""
        rows = self.read(name).join(updates, key, "left")
        ended = F.col("new_status").isin("completed", "failed")
        rows = rows.withColumn("started_at", F.when(F.col("new_status") == "running", now).otherwise(F.col("started_at")))
        rows = rows.withColumn("completed_at", F.when(ended, now).otherwise(F.col("completed_at"))).withColumn("error", F.when(ended, F.col("new_error")).otherwise(F.col("error")))
        self.replace(name, rows.withColumn("status", F.coalesce("new_status", "status")).drop("new_status", "new_error"))

    def drop_old_jobs(self, name: str, now: Column, days: int = 7) -> None:
        """Ended jobs older than some days go."""
        self.delete(name, F.col("status").isin("completed", "failed", "cancelled") & (F.col("completed_at") < now - F.expr(f"interval {days} days")))


def append_log(entries: DataFrame, path: str) -> None:
    """Append entries as lines of JSON."""
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_graph(nodes: DataFrame, path: str, form: str = "json") -> None:
    """Nodes (id, type, label, properties) as lines of JSON, or as YAML documents."""
    if form == "json":
        nodes.write.json(path)
        return
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    lines = [F.concat(F.lit(f"{'- ' if i == 0 else '  '}{c}: "), quoted(F.coalesce(F.col(c).cast("string"), F.lit("")))) for i, c in enumerate(nodes.columns)]
    nodes.select(F.concat_ws("\n", *lines).alias("value")).write.text(path)


def graph_nodes(discoveries: DataFrame) -> DataFrame:
    """Active discoveries (with evidence and sources, lists) as graph nodes, their properties as JSON."""
    rows = discoveries.filter("status = 'active'")
    counts = [F.size(F.coalesce(c, F.array().cast("array<string>"))).alias(f"{n}_count") for c, n in (("evidence", "evidence"), ("sources", "source"))]
    return rows.select("id", F.lit("discovery").alias("type"), F.col("title").alias("label"), F.to_json(F.struct("discovery_type", F.round("confidence", 6).alias("confidence"), *counts)).alias("properties"))


def tagged(files: DataFrame, machine: str) -> DataFrame:
    """Files of another machine: ids and paths tagged with its name."""
    return files.withColumn("path", F.concat(F.lit(f"[{machine}] "), "path")).withColumn("id", S.generate_id("file", F.col("path")))
