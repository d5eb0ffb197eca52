"""What the training-data operators share: tables, shared folders, skew-safe joins, components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words once A-Z are lower-case: ASCII other than digits and a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session, as in tests, names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sediment-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sediment-{tag}-{uuid.uuid4().hex}"


class Made(threading.local):
    """The tables that this thread has written inside own_tables and not dropped."""

    def __init__(self):
        self.paths: list[str] = []
        self.on = False


MADE = Made()


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """First delete the tables written inside the last own_tables of this thread, then keep account of those written now.

    What was built on the earlier ones must be written elsewhere by then. Tables of other queries are left alone.
    """
    while MADE.paths:
        delete(spark, MADE.paths.pop())
    MADE.on = True
    try:
        yield
    finally:
        MADE.on = False


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    if MADE.on:
        MADE.paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more; other frames are left alone."""
    for t in tables:
        if path := t.__dict__.pop("written_to", None):
            delete(t.sparkSession, path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sweep(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 64) -> Column:
    """The outputs of a fold over an array: step(state, item) gives the new state and an array of outputs (of type kind).

    Outputs are joined in blocks, so that a long array doesn't copy them all at every step.
    """
    none = F.array().cast(kind)
    inner = lambda acc, x: (lambda new: F.struct(new[0].alias("s"), F.concat(acc["out"], new[1]).alias("out")))(step(acc["s"], x))

    def outer(acc: Column, i: Column) -> Column:
        return F.aggregate(F.slice(items, i * block + 1, F.lit(block)), F.struct(acc["s"].alias("s"), none.alias("out")), inner, lambda got: F.struct(got["s"].alias("s"), F.concat(acc["out"], got["out"]).alias("out")))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(state.alias("s"), none.alias("out")), outer, lambda acc: acc["out"])


def attach(df: DataFrame, key: str, groups: DataFrame, count: str, salt: Column) -> DataFrame:
    """Left-join one row per key from groups (materialized, with the key's row count) to df, however hot a key is.

    Keys with at least 1/512 of all rows number 512 at most: these are broadcast, and their rows get a
    random-like join key, so that no task of the shuffled join for the others receives a hot group.
    Null keys join with nothing.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    least = max(64, total // 512)
    cols = [c for c in groups.columns if c != key]
    value = F.struct(*cols)
    hot = groups.filter(F.col(count) >= least).select(F.col(key).alias("_hk"), value.alias("_hv"))
    rest = groups.filter(F.col(count) < least).select(F.col(key).cast("string").alias("_rk"), value.alias("_rv"))
    out = df.join(F.broadcast(hot), df[key] == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\u0000"), salt.cast("string"))))
    out = out.join(rest, F.col("_jk") == F.col("_rk"), "left").withColumn("_v", F.coalesce("_hv", "_rv"))
    return out.select(*[df[c] for c in df.columns], *[F.col(f"_v.{c}").alias(c) for c in cols])


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about size bytes in the column, but of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        most = (ends[start - 1] if start else 0) + size
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def by_key(key: str, work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that hands the rows of each key, of partitions sorted by it, to work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(key).to_numpy()
            if held and held[-1].column(key)[0].as_py() != keys[0]:
                yield from work(held)
                held = []
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(bounds, bounds[1:]):
                held.append(b.slice(i, j - i))
                if j < len(keys):
                    yield from work(held)
                    held = []
        if held:
            yield from work(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v: long): node, component (its smallest node).

    Each round every component hooks to its smallest neighbour, pointers are doubled four times and the
    edges are contracted, all as joins of written tables, which Spark can split where a node is a hub; a
    table is deleted when the next one is written. Nodes without an edge do not appear. No edges: no rows.
    Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).union(e.select("v", "u"))
        hook = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to"))
        hook = materialize(hook, "hook")
        for _ in range(4):
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("upper"))
            nxt = materialize(hook.join(up, "to").select("node", F.col("upper").alias("to")), "hook")
            same = nxt.join(hook.select("node", F.col("to").alias("was")), "node").filter("to <> was").isEmpty()
            discard(hook)
            hook = nxt
            if same:
                break
        if labels is None:
            found = hook.select("node", F.col("to").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "to")
            found = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = materialize(found, "labels")
        hu, hv = hook.select(F.col("node").alias("u"), F.col("to").alias("cu")), hook.select(F.col("node").alias("v"), F.col("to").alias("cv"))
        half = materialize(e.join(hu, "u").select("cu", "v"), "half")
        left = half.join(hv, "v").filter("cu <> cv").select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct()
        left = materialize(left, "edges")
        discard(hook, half, e, *([] if labels is None else [labels]))
        e, labels = left, found
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")
