"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import spent, written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of undirected links (a, b: long); loops and nulls are left out.

    A large star hangs a node's larger neighbours on the smallest of all, a small star its smaller ones; the two
    alternate until links no longer change, which takes a number of rounds about as the logarithm of the longest
    path. A node's minimum is a partial aggregate and goes back to its links by a join, so no task holds a hub's links.
    """
    e = written(links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links")
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = written(small.union(least.select("a", "m")).distinct(), "links")
        spent(e, large)
        e, now = after, mark(after)
        if now == before:
            break
        before = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(e.select("b", "b").distinct())
