"""Clusters, reduction, an inverted-file index and the offline embedder, on Spark's own ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .density import dbscan
from .manifold import layout
from .search import cosine_distance, squared_l2


def cluster(vectors: DataFrame, most: int = 20, seed: int = 42, algorithm: str = "kmeans") -> DataFrame:
    """vec_id, cluster: by k-means with min(most, n / 5) clusters, where under 20 rows nothing is clustered, or by density (dbscan)."""
    if algorithm == "dbscan":
        return dbscan(vectors).select("vec_id", "cluster")
    if algorithm != "kmeans":
        raise ValueError(f"no such algorithm: {algorithm}")
    n = vectors.count()
    rows = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    if n < 20:
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"))
    model = KMeans(k=min(most, n // 5), seed=seed, predictionCol="cluster").fit(rows)
    return model.transform(rows).select("vec_id", "cluster")


def reduce(vectors: DataFrame, k: int = 2, algorithm: str = "pca", seed: int = 42) -> DataFrame:
    """vec_id, reduced: k coordinates, on the main axes (pca) or by a layout of the neighbourhoods (umap)."""
    if algorithm == "umap":
        return layout(vectors, k, seed=seed)
    if algorithm != "pca":
        raise ValueError(f"no such algorithm: {algorithm}")
    rows = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = PCA(k=k, inputCol="features", outputCol="reduced").fit(rows)
    return model.transform(rows).select("vec_id", vector_to_array("reduced").alias("reduced"))


class InvertedFile:
    """Vectors in cells by their nearest centroid; a search reads the nearest cells only."""

    def __init__(self, model: KMeansModel, rows: DataFrame):
        self.model, self.rows = model, rows

    @classmethod
    def build(cls, vectors: DataFrame, cells: int = 100, seed: int = 42, sample: int = 100_000) -> InvertedFile:
        """Centroids are fitted on about sample rows; every row is in the index."""
        rows = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        share = min(1.0, sample / max(1, rows.count()))
        model = KMeans(k=cells, seed=seed, predictionCol="cell").fit(rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        return cls(model, model.transform(rows).drop("features"))

    def save(self, folder: str) -> None:
        self.model.write().save(f"{folder}/model")
        self.rows.write.partitionBy("cell").parquet(f"{folder}/rows")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> InvertedFile:
        """A search on a loaded index reads the folders of the probed cells only."""
        return cls(KMeansModel.load(f"{folder}/model"), spark.read.parquet(f"{folder}/rows"))

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query, cell: each query with the cells of its nearest centroids."""
        centres = np.array(self.model.clusterCenters())

        def nearest(batches):
            for b in batches:
                if b.num_rows:
                    x = b.column("query").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    far = ((x[:, None] - centres) ** 2).sum(2)
                    cells = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))).columns, pa.array(cells.ravel())], [*b.schema.names, "cell"])

        some = queries.select("query_id", "query")
        return some.mapInArrow(nearest, T.StructType([*some.schema.fields, T.StructField("cell", T.IntegerType())]))

    def nearest_batch(self, queries: DataFrame, k: int = 10, probes: int = 10) -> DataFrame:
        """The k nearest rows of the probed cells for each of queries (query_id, query); a cell's vectors meet only the queries that probe it."""
        pairs = self.rows.join(self.probed(queries, probes), "cell").withColumn("distance", cosine_distance(F.col("embedding"), F.col("query")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        return pairs.select("query_id", "vec_id", "distance").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")

    def nearest(self, query: list[float], k: int = 10, probes: int = 10) -> DataFrame:
        far = [(float(sum((a - b) ** 2 for a, b in zip(query, c))), i) for i, c in enumerate(self.model.clusterCenters())]
        q = F.array(*[F.lit(float(x)) for x in query])
        return self.rows.filter(F.col("cell").isin([i for _, i in sorted(far)[:probes]])).withColumn("distance", squared_l2(F.col("embedding"), q)).orderBy("distance", "vec_id").limit(k)


def hashed_embeddings(rows: DataFrame, key: list[str], text: str, dims: int = 384, slice_rows: int = 256) -> DataFrame:
    """key and v, a unit vector of hashed word counts of the text (zero without words): the offline stand-in for a sentence model.

    A word's dimension is its MD5's first 32 bits modulo dims. A row's words are counted where the row is; nothing is
    shuffled. Python gets numbers, not words, and counts them slice_rows rows at a time.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cell = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims).cast("int")
    some = rows.select(*key, F.transform(words, cell).alias("_cells"))
    names = list(key)

    def count(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                cells = b.column("_cells")
                row = np.repeat(np.arange(b.num_rows, dtype=np.int64) * dims, np.diff(cells.offsets.to_numpy()))
                v = np.bincount(row + cells.flatten().to_numpy(), minlength=b.num_rows * dims).astype(np.float64).reshape(b.num_rows, dims)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                flat = pa.array((v / np.where(norm > 0, norm, 1)).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists], [*names, "v"])

    return some.mapInArrow(count, T.StructType([*[some.schema[c] for c in names], T.StructField("v", T.ArrayType(T.DoubleType()))]))


def embed_with_cache(rows: DataFrame, key: list[str], text: str, cache: DataFrame, dims: int = 384) -> DataFrame:
    """key, cached, v: embeddings by the text's hash from the cache (text_hash, v), the others computed, each different text once."""
    hashed = rows.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    found = hashed.select(*key, "text_hash").join(cache.select("text_hash", F.col("v").alias("_v")).dropDuplicates(["text_hash"]), "text_hash", "left")
    new = hashed.select("text_hash", text).dropDuplicates(["text_hash"]).join(cache.select("text_hash"), "text_hash", "left_anti")
    out = found.join(hashed_embeddings(new, ["text_hash"], text, dims), "text_hash", "left")
    return out.select(*key, F.col("_v").isNotNull().alias("cached"), F.coalesce("_v", "v").alias("v"))


def rendered(question: Column, chunks: Column, discoveries: Column, entities: Column, form: str = "xml", root: str = "context") -> Column:
    """The text of a question's context from arrays of chunks (content, source, similarity, chunk_type), discoveries
    (discovery_type, title, description, confidence) and entities (entity_type, canonical_value)."""
    said = lambda items, line: F.array_join(F.transform(items, line), "")
    two = lambda c: F.format_string("%.2f", c)
    number = lambda i: (i + 1).cast("string")
    if form == "xml":
        chunk = lambda x, i: F.concat(F.lit('<chunk index="'), number(i), F.lit('" similarity="'), two(x["similarity"]), F.lit('" source="'), x["source"], F.lit('" type="'), x["chunk_type"], F.lit('">\n'), x["content"], F.lit("\n</chunk>\n\n"))
        found = lambda x: F.concat(F.lit('<discovery type="'), x["discovery_type"], F.lit('" confidence="'), two(x["confidence"]), F.lit('">\n'), x["title"], F.lit(": "), F.coalesce(x["description"], F.lit("")), F.lit("\n</discovery>\n\n"))
        named = lambda x: F.concat(F.lit('  <entity type="'), x["entity_type"], F.lit('">'), x["canonical_value"], F.lit("</entity>\n"))
        parts = [F.lit(f"<{root}>\n<query>"), question, F.lit("</query>\n\n<relevant_content>\n"), said(chunks, chunk), F.lit("</relevant_content>\n")]
        more = [("\n<discoveries>\n", discoveries, found, "</discoveries>\n"), ("\n<key_entities>\n", entities, named, "</key_entities>\n")]
        end = f"</{root}>"
    else:
        cut = lambda c: F.when(F.length(c) > 500, F.concat(F.substring(c, 1, 500), F.lit("..."))).otherwise(c)
        chunk = lambda x, i: F.concat(F.lit("**["), number(i), F.lit("]** _"), x["source"], F.lit("_ (similarity: "), two(x["similarity"]), F.lit(")\n\n> "), cut(x["content"]), F.lit("\n\n"))
        found = lambda x: F.concat(F.lit("- **"), x["title"], F.lit("** ("), F.format_string("%.0f", F.rint(x["confidence"] * 100)), F.lit("%): "), F.coalesce(x["description"], F.lit("")), F.lit("\n"))
        named = lambda x: F.concat(F.lit("- ["), x["entity_type"], F.lit("] "), x["canonical_value"], F.lit("\n"))
        parts = [F.lit("## Context: "), question, F.lit("\n\n### Relevant Content\n\n"), said(chunks, chunk)]
        more = [("### Discoveries\n\n", discoveries, found, ""), ("\n### Key Entities\n\n", entities, named, "")]
        end = ""
    for head, items, line, tail in more:
        parts.append(F.when(F.size(items) > 0, F.concat(F.lit(head), said(items, line), F.lit(tail))).otherwise(""))
    return F.concat(*parts, F.lit(end))


def bundle(question: str, chunks: DataFrame, discoveries: DataFrame, entities: DataFrame, form: str = "xml", root: str = "context") -> DataFrame:
    """One row with the text of a question's context, from the few rows of three top-k tables, each with a rank."""
    few = lambda df, name, *columns: df.agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias(name))
    rows = few(chunks, "c", "content", "source", "similarity", "chunk_type").crossJoin(few(discoveries, "d", "discovery_type", "title", "description", "confidence")).crossJoin(few(entities, "e", "entity_type", "canonical_value"))
    return rows.select(rendered(F.lit(question), F.col("c"), F.col("d"), F.col("e"), form, root).alias("context"))
