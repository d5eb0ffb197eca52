"""Merging machines and comparing what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S


def first_of_each(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the first in a stated order."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def merge_chunks(chunks: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Chunks (machine, file_id, chunk_index, content) whose content hash is new, the first of each hash."""
    rows = chunks.withColumn("content_hash", S.content_hash16(F.col("content")))
    if master is not None:
        rows = rows.join(master.select("content_hash"), "content_hash", "left_anti")
    return first_of_each(rows, "content_hash", ["machine", "file_id", "chunk_index"])


def index(words: DataFrame) -> DataFrame:
    return words.groupBy("entity", "machine").agg(F.count("*").alias("n"))


def topics(idx: DataFrame, least: float = 0.3, n: int = 50) -> DataFrame:
    """Entities on several machines; mentions are rows, not files."""
    g = idx.groupBy("entity").agg(F.count("*").alias("machines"), F.sum("n").alias("mention_count")).filter("machines > 1")
    g = g.withColumn("confidence", F.least(F.lit(1.0), (F.col("machines") / F.lit(3.0)) * (F.col("mention_count") / F.lit(10.0))))
    return g.filter(F.col("confidence") > least).orderBy(F.desc("confidence"), F.desc("mention_count"), "entity").limit(n)


def collaboration(idx: DataFrame, least_shared: int = 5) -> DataFrame:
    """Pairs of machines that share entities, counts on both sides."""
    a, b = idx.select("entity", F.col("machine").alias("m1"), F.col("n").alias("n1")), idx.select("entity", F.col("machine").alias("m2"), F.col("n").alias("n2"))
    pairs = a.join(b, "entity").filter("m1 < m2").groupBy("m1", "m2").agg(F.count("*").alias("shared"), F.sum("n1").alias("rows1"), F.sum("n2").alias("rows2"))
    size = idx.groupBy("machine").agg(F.count("*").alias("c"))
    out = pairs.filter(F.col("shared") >= least_shared).join(size.select(F.col("machine").alias("m1"), F.col("c").alias("c1")), "m1").join(size.select(F.col("machine").alias("m2"), F.col("c").alias("c2")), "m2")
    return out.select("m1", "m2", "shared", "rows1", "rows2", (F.col("c1") - F.col("shared")).alias("only1"), (F.col("c2") - F.col("shared")).alias("only2"), F.least(F.lit(1.0), F.col("shared") / F.lit(20.0)).alias("confidence"))


def silos(idx: DataFrame, least: int = 10) -> DataFrame:
    """Machines with many entities that no other machine has."""
    alone = idx.groupBy("entity").agg(F.count("*").alias("m"), F.max("machine").alias("machine")).filter("m = 1").groupBy("machine").agg(F.count("*").alias("only_here"))
    size = idx.groupBy("machine").agg(F.count("*").alias("entities"))
    return alone.filter(F.col("only_here") >= least).join(size, "machine").select("machine", "only_here", "entities", F.least(F.lit(1.0), F.col("only_here") / F.lit(50.0)).alias("confidence"), (F.col("only_here") / F.col("entities")).alias("uniqueness"))


def insights(idx: DataFrame, least_shared: int = 5, least_alone: int = 10) -> DataFrame:
    """What stands out: id, subject, value, confidence. Which machine shares most; which pair shares most; how many are mostly alone."""
    n = idx.agg(F.countDistinct("machine").alias("k"))
    shared = idx.join(idx.groupBy("entity").agg(F.count("*").alias("m")).filter("m > 1"), "entity").groupBy("machine").agg(F.count("*").alias("shared"))
    all_ = idx.select("machine").distinct().join(shared, "machine", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    hub = all_.orderBy(F.desc("shared"), "machine").limit(1).crossJoin(F.broadcast(n)).filter("k > 1").select(F.lit("insight_distribution").alias("id"), F.col("machine").alias("subject"), F.col("shared").cast("long").alias("value"), F.lit(0.8).alias("confidence"))
    pair = collaboration(idx, least_shared).orderBy("m1", "m2").limit(1).select(F.lit("insight_collaboration"), F.concat_ws(" and ", "m1", "m2"), F.col("shared").cast("long"), "confidence")
    alone = silos(idx, least_alone).filter("uniqueness > 0.5").agg(F.count("*").alias("c")).filter("c > 0").select(F.lit("insight_silos"), F.lit(None).cast("string"), F.col("c").cast("long"), F.lit(0.7))
    return hub.union(pair).union(alone)


def merge_result(files: DataFrame, chunks: DataFrame, entities: DataFrame, known_files: DataFrame, known_chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """Per machine what a merge did: files and chunks added, those that were there already, entities added and consolidated, errors joined.

    files (id, machine), chunks (machine, file_id, chunk_index, content), entities (machine, file_id, i, value), errors (machine, error).
    The first of equal chunks, and of equal entities by their organisation form, is by (machine, file, index).
    """
    new = files.join(known_files.select("id"), "id", "left_anti").groupBy("machine").agg(F.count("*").alias("files_added"))
    old = files.join(known_files.select("id"), "id", "left_semi").groupBy("machine").agg(F.count("*").alias("files_known"))
    kept = merge_chunks(chunks, known_chunks).groupBy("machine").agg(F.count("*").alias("chunks_added"))
    all_ = chunks.groupBy("machine").agg(F.count("*").alias("chunks"))
    first = F.row_number().over(Window.partitionBy("n").orderBy("machine", "file_id", "i"))
    named = entities.withColumn("n", S.norm_org(F.col("value"))).withColumn("r", first).groupBy("machine").agg(F.count("*").alias("entities_added"), F.count_if(F.col("r") > 1).alias("entities_consolidated"))
    told = errors.groupBy("machine").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))
    out = files.select("machine").distinct()
    for x in (new, old, kept, all_, named, told):
        out = out.join(x, "machine", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("machine", z("files_added").alias("files_added"), (z("files_known") + z("chunks") - z("chunks_added")).alias("files_deduplicated"), z("chunks_added").alias("chunks_added"), z("entities_added").alias("entities_added"), z("entities_consolidated").alias("entities_consolidated"), F.coalesce("errors", F.lit("")).alias("errors"))


def summary(idx: DataFrame) -> DataFrame:
    """Machines, entities, and patterns by type."""
    out = idx.agg(F.countDistinct("machine").alias("machines"), F.countDistinct("entity").alias("entities"))
    for name, df in (("topic", topics(idx)), ("collaboration", collaboration(idx)), ("expertise", silos(idx))):
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    return out
