"""Written tables between the steps of iterative operators: they cut lineage and outlive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.catalog import scratch


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the folder that driver and executors share."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := t.__dict__.pop("written_to", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
