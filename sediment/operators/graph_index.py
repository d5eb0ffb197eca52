"""A navigable small-world graph for each part of the vectors: built in tasks, saved with the rows, searched greedily."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import written

#: Links of a node on an upper layer (twice as many on the lowest), nodes looked at while building and while searching, rows of a part.
LINKS, BUILD_WIDTH, SEARCH_WIDTH, PART_ROWS = 16, 64, 64, 20_000

NODE = "part int, node int, vec_id long, embedding array<float>, links array<array<int>>"


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Graph:
    """Layers of links between unit vectors; a node's first layer is the lowest. seen counts the vectors that searches have compared."""

    def __init__(self, vectors: np.ndarray, links: list[list[np.ndarray]] | None = None):
        self.x, self.links, self.seen = vectors, links or [], 0
        self.entry = max(range(len(self.links)), key=lambda i: (len(self.links[i]), -i)) if self.links else -1
        self.mark, self.walk = np.zeros(len(vectors), np.int64), 0  # the last walk that came by a node

    def far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.seen += len(nodes)
        return 1 - self.x[nodes] @ q

    def closest(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The width nearest nodes that a best-first walk on a layer finds from starts, nearest first."""
        self.walk += 1
        self.mark[[n for _, n in starts]] = self.walk
        front, best = list(starts), [(-d, n) for d, n in starts]
        heapq.heapify(front)
        heapq.heapify(best)
        while front:
            d, n = heapq.heappop(front)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = self.links[n][layer]
            fresh = fresh[self.mark[fresh] != self.walk]
            if not len(fresh):
                continue
            self.mark[fresh] = self.walk
            e = self.far(q, fresh)
            if len(best) >= width:
                fresh, e = fresh[e < -best[0][0]], e[e < -best[0][0]]
            for e_, m in zip(e.tolist(), fresh.tolist()):
                if len(best) < width or e_ < -best[0][0]:
                    heapq.heappush(front, (e_, m))
                    heapq.heappush(best, (-e_, m))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        """The nearest node that a greedy walk from the entry finds above layer `to`."""
        at = [(float(self.far(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.links[self.entry]) - 1, to, -1):
            at = self.closest(q, at, 1, layer)
        return at

    def chosen(self, far: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of nodes, nearest first, those that no chosen one is nearer to; then the nearest of the others, up to most."""
        between = 1 - self.x[nodes] @ self.x[nodes].T
        nearest, kept = np.full(len(nodes), np.inf), []
        for i, d in enumerate(far.tolist()):
            if nearest[i] >= d:
                kept.append(i)
                if len(kept) == most:
                    break
                np.minimum(nearest, between[i], out=nearest)
        rest = np.setdiff1d(np.arange(len(nodes)), kept)[: most - len(kept)]
        return nodes[np.append(kept, rest).astype(int)].astype(np.int32)

    def shortened(self, node: int, layer: int, most: int) -> None:
        """A node's links cut to most."""
        theirs = self.links[node][layer]
        d = 1 - self.x[theirs] @ self.x[node]
        order = np.argsort(d, kind="stable")
        self.links[node][layer] = self.chosen(d[order], theirs[order], most)

    def add(self, level: int, links: int, width: int) -> None:
        """The next vector joins the layers up to level. A list of links is cut when it is half longer than it may be."""
        node = len(self.links)
        self.links.append([np.zeros(0, np.int32)] * (level + 1))
        if node == 0:
            self.entry = 0
            return
        top = len(self.links[self.entry]) - 1
        at = self.descend(self.x[node], level)
        for layer in range(min(level, top), -1, -1):
            at = self.closest(self.x[node], at, width, layer)
            most = links if layer else 2 * links
            own = self.chosen(np.array([d for d, _ in at]), np.array([n for _, n in at]), links)
            self.links[node][layer] = own
            for other in own.tolist():
                self.links[other][layer] = np.append(self.links[other][layer], np.int32(node))
                if len(self.links[other][layer]) > most + most // 2:
                    self.shortened(other, layer, most)
        if level > top:
            self.entry = node

    def nearest(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        return self.closest(q, self.descend(q, 0), max(k, width), 0)[:k]


def built(vectors: np.ndarray, seed: int, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """A graph of unit vectors, added in their order; levels are drawn by seed."""
    graph = Graph(vectors)
    levels = (-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / math.log(links)).astype(int)
    for level in levels.tolist():
        graph.add(level, links, width)
    for node, layers in enumerate(graph.links):
        for layer, own in enumerate(layers):
            if len(own) > (links if layer else 2 * links):
                graph.shortened(node, layer, links if layer else 2 * links)
    return graph


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows, -1)


class GraphIndex:
    """Every row is a node of one part's graph. Rows with a null or non-finite component, or of zero length, have no direction and are left out."""

    def __init__(self, rows: DataFrame, parts: int):
        self.rows, self.parts = rows, parts

    @classmethod
    def build(cls, vectors: DataFrame, part_rows: int = PART_ROWS, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 42) -> GraphIndex:
        """vectors (vec_id, embedding), dealt by a hash of vec_id into parts of about part_rows, each built in a task; the same rows give the same graphs."""
        fine = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
        rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(fine)
        parts = max(1, -(-rows.count() // part_rows))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

        def build(t: pa.Table) -> pa.Table:
            t = t.sort_by("vec_id")
            graph = built(unit(matrix(t.column("embedding"), t.num_rows)), seed, links, width)
            nested = pa.array([[x.tolist() for x in ls] for ls in graph.links], pa.list_(pa.list_(pa.int32())))
            return pa.table({"part": t.column("part"), "node": pa.array(np.arange(t.num_rows, dtype=np.int32)), "vec_id": t.column("vec_id"), "embedding": t.column("embedding"), "links": nested})

        apart = rows.repartitionByRange(parts, "part")  # a task for each part, however small
        return cls(written(apart.groupBy("part").applyInArrow(build, NODE), "graph"), parts)

    def save(self, folder: str) -> None:
        self.rows.write.partitionBy("part").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> GraphIndex:
        rows = spark.read.schema(NODE).parquet(folder)
        return cls(rows, rows.select("part").distinct().count())

    def nearest_batch(self, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH, most: int = 100_000) -> DataFrame:
        """query_id, rank, vec_id, distance (cosine), compared: the k nearest that the walks find for each of queries (query_id, query).

        Every part's graph is walked for every query, so a part's own k nearest are merged; compared counts the rows
        whose distance was computed for the query, in all parts. Queries go in groups of about most, as a part's task holds
        a group. Queries without a direction find nothing.
        """
        fine = F.coalesce((F.size("query") > 0) & ~F.exists("query", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("query", lambda x: x != 0), F.lit(False))
        asked = queries.select("query_id", F.col("query").cast("array<float>").alias("query")).filter(fine)

        def search(key: tuple, nodes: pa.Table, mine: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if nodes.num_rows and mine.num_rows:
                nodes = nodes.sort_by("node")
                ids = nodes.column("vec_id").to_numpy()
                graph = Graph(unit(matrix(nodes.column("embedding"), nodes.num_rows)), [[np.array(x, np.int32) for x in ls] for ls in nodes.column("links").to_pylist()])
                for q, v in zip(mine.column("query_id").to_pylist(), unit(matrix(mine.column("query"), mine.num_rows))):
                    graph.seen = 0
                    found = graph.nearest(v, k, width)
                    out += [(q, int(ids[n]), float(d), graph.seen) for d, n in found]
            cols = list(zip(*out)) or [[], [], [], []]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64()), "seen": pa.array(cols[3], pa.int64())})

        groups, merged = max(1, -(-asked.count() // most)), None
        for g in range(groups):
            some = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
            spread = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
            found = self.rows.groupBy("part").cogroup(spread.groupBy("part")).applyInArrow(search, "query_id long, vec_id long, distance double, seen long")
            merged = found if merged is None else merged.union(found)
        merged = written(merged, "walks")
        by_part = merged.join(self.rows.select("vec_id", "part"), "vec_id").groupBy("query_id", "part").agg(F.max("seen").alias("seen"))
        compared = by_part.groupBy("query_id").agg(F.sum("seen").alias("compared"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        best = merged.withColumn("rank", rank).filter(F.col("rank") <= k)
        return best.join(compared, "query_id").select("query_id", "rank", "vec_id", "distance", "compared")
