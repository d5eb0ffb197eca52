"""Operators on embeddings: near-duplicates by p-stable hashing and exact top-k by inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_key, components, materialize, table

BLOCK = 512
#: Numbers of the longest vectors that are broadcast.
LEAD = 1 << 21


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection (Gaussian, this width) agrees for two points at the distance."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, threshold: float, miss: float, width: float) -> tuple[int, int]:
    """Projections per table so that a table's buckets hold a few unrelated vectors, and tables so that a pair at the threshold is missed with chance miss."""
    far, near = collision(math.sqrt(2.0), width), collision(math.sqrt(2 - 2 * threshold), width)
    k = max(1, math.ceil(math.log(max(n, 2) / 4) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def valid(v) -> F.Column:
    """Vectors without nulls or non-finite components and not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def stack(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: positions and matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return {int(d): (rows := np.flatnonzero(sizes == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, miss: float = 0.003, width: float = 1.5, seed: int = 7) -> DataFrame:
    """Links between vectors (vec_id long, embedding array, label) of equal label with cosine >= threshold.

    Returns one row per row of vectors: vec_id, n_links (other rows linked directly), component_id (smallest
    vec_id reachable), kept (vec_id = component_id). Vectors that are null, zero, or hold null or non-finite
    components, and rows with a null label, link with nothing. Vectors of different lengths never link.
    Repeated rows and equal vectors count as rows of their own. A null vec_id gives a null component_id
    unless it links to others; kept is then false. Other columns are ignored, whatever their names; no rows give
    no rows. A vector of any length is hashed and compared whole; a task holds two blocks of BLOCK vectors.

    Equal vectors are joined into one weighted row first. Each table hashes a unit vector by k quantised
    Gaussian projections; rows that share a bucket meet in blocks of bounded size (a bucket of any size is
    dealt out over pairs of blocks), cosines are computed exactly in double precision, and a pair counts in
    the first table where it meets. No pair is ever written: a block gives counts and a spanning forest.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label").withColumn("ok", valid(F.col("embedding")) & F.col("label").isNotNull())
    same = rows.filter("ok").groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    reps = materialize(same.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan_tables(most, threshold, miss, width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            label = np.array(b.column("label").cast(pa.string()).to_pylist(), object)
            sigs = np.zeros((b.num_rows, tables), np.int64)
            for d, (at, x) in stack(b.column("embedding")).items():
                if d not in axes:
                    rng = np.random.default_rng(seed)
                    axes[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, width, tables * k)
                a, shift = axes[d]
                q = np.floor((unit(x) @ a + shift) / width).astype(np.int64).reshape(len(at), tables, k)
                h = np.full((len(at), tables), 1469598103934665603, np.uint64)
                for j in range(k):
                    h = (h ^ q[:, :, j].astype(np.uint64)) * np.uint64(1099511628211)
                    h ^= h >> np.uint64(29)
                h = (h ^ (np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * d)
                salt = np.array([hash_text(v) for v in label[at]], np.uint64)[:, None]
                h = (h ^ salt) * np.uint64(0x94D049BB133111EB)
                sigs[at] = (h ^ (h >> np.uint64(31))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("weight"), b.column("embedding"), pa.array(list(sigs), pa.list_(pa.int64()))], ["rid", "weight", "embedding", "sigs"])

    kind = dict(reps.dtypes)["embedding"]
    hashed = materialize(reps.mapInArrow(project, f"rid long, weight long, embedding {kind}, sigs array<long>"), "hashed")
    meet = hashed.select("rid", F.posexplode("sigs").alias("t", "bucket"))
    sizes = materialize(meet.groupBy("bucket").count().filter("count > 1"), "buckets")
    meet = meet.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rid", "t"), F.col("blocks")).cast("int")
    meet = meet.select("rid", "t", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = meet.select("rid", "t", "own", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") == F.col("other")).alias("inner"))
    cells = materialize(meet, "cells").join(hashed, "rid")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = cells.repartition(parts, "cell").sortWithinPartitions("cell")

    found = materialize(cells.mapInArrow(by_key("cell", lambda held: links(held, threshold)), "rid long, n long, root long"), "links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    parts_of = components(found.filter("rid <> root").select(F.col("rid").alias("u"), F.col("root").alias("v")))
    labels = reps.select("rid", "weight", "least").join(parts_of.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    labels = materialize(labels, "labels")
    smallest = materialize(labels.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    per_rep = labels.join(smallest, "component").join(counts, "rid", "left").select("rid", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    per_rep = materialize(reps.select("rid", "label", "embedding").join(per_rep, "rid").drop("rid"), "perrep")
    linked = rows.filter("ok").join(per_rep, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def hash_text(value: str) -> int:
    h = 14695981039346656037
    for c in value.encode():
        h = (h ^ c) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def links(held: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Link counts and forest of one cell: all pairs of one block, or the pairs between two blocks."""
    t = pa.Table.from_batches(held)
    if t.num_rows < 2:
        return
    rid, weight, table_no = (t.column(c).to_numpy() for c in ("rid", "weight", "t"))
    x = unit(stack(t.column("embedding").combine_chunks())[len(t.column("embedding")[0])][1])
    sigs = t.column("sigs").combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
    inner, own = t.column("inner").to_numpy(), t.column("own").to_numpy()
    left = np.arange(len(rid)) if inner[0] else np.flatnonzero(own == own.min())
    right = left if inner[0] else np.flatnonzero(own != own.min())
    if not len(right) or not len(left):
        return
    n = np.zeros(len(rid), np.int64)
    near = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), 64):
        rows = left[i : i + 64]
        near[i : i + 64] = ok = (x[rows] @ x[right].T >= threshold) & (rid[rows][:, None] != rid[right][None, :])
        a, b = np.nonzero(ok)
        if len(a):
            new = ~(sigs[rows[a], : table_no[0]] == sigs[right[b], : table_no[0]]).any(axis=1)
            np.add.at(n, rows[a[new]], weight[right[b[new]]])
            if not inner[0]:
                np.add.at(n, right[b[new]], weight[rows[a[new]]])
    if not near.any():
        return
    root, big = rid.copy(), np.iinfo(np.int64).max
    while True:
        was = root.copy()
        root[left] = np.minimum(root[left], np.where(near, root[right][None, :], big).min(axis=1))
        root[right] = np.minimum(root[right], np.where(near, root[left][:, None], big).min(axis=0))
        if (was == root).all():
            break
    keep = np.flatnonzero((n > 0) | (root != rid))
    if len(keep):
        yield pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array(n[keep]), pa.array(root[keep])], ["rid", "n", "root"])


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, query_rows: int = 8192, block_rows: int = 4096, stages: int = 8, ranges: int = 64) -> DataFrame:
    """For each row whose vec_id is divisible by every: the k largest integer inner products with all other rows.

    Components x become floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
    null vec_id; only vectors of equal length are compared. A zero vector is an ordinary candidate. "Every row but
    the query's own": rows that repeat the query's vec_id are the query's own too; other repeated rows rank
    each by itself. Integers and products are exact up to 2**63 (scores beyond are clamped). Other columns are
    ignored. A vector of any length is read whole; a task holds query_rows + block_rows of them, and as many
    lengths as there are get a plan of their own on the driver.

    An eigenbasis of all vectors' second moments (a few numbers per task reach the driver) concentrates length in
    the leading coordinates. First every query meets the block_rows longest vectors (broadcast): its k-th product
    there (fewer vectors, if these have over LEAD numbers)
    is a floor for the k-th of all, and floor / |q| the shortest candidate that can still matter. Candidates
    then lie in ranges of descending length, queries in ranges of that shortest length, and blocks of the two
    meet only where the longest candidate can matter to some query: others are never shuffled. In a cell, sums of
    the leading coordinates in a few stages plus the product of the residual lengths (Cauchy-Schwarz) prune pairs,
    and the pairs left after the last stage are multiplied exactly.
    """
    found = products(vectors, every, k, scale, query_rows, block_rows, stages, ranges).filter("vec_id is not null")
    order = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def products(vectors: DataFrame, every: int, k: int, scale: float, query_rows: int, block_rows: int, stages: int, ranges: int) -> DataFrame:
    """The k best of each cell for each of its queries (query_id, copy, vec_id, score), and a row without ids per cell: pairs met and multiplied."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    fine = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = vectors.filter(fine & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("x"))
    rows = rows.withColumn("dim", F.size("x")).withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))
    rows = materialize(rows, "rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, x) in stack(b.column("x")).items():
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["dim", "m"])

    parts = rows.mapInArrow(moments, "dim int, m array<double>").select("dim", F.posexplode("m").alias("i", "y")).groupBy("dim", "i").agg(F.sum("y").alias("y"))
    bases: dict[int, np.ndarray] = {}
    for d, cells in parts.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("c")).collect():
        m = np.array([c["y"] for c in cells]).reshape(d, d)
        bases[d] = np.linalg.eigh(m / (np.abs(m).max() or 1.0))[1][:, ::-1]

    longest = rows.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("length"), "vec_id"))).filter(F.col("r") <= F.least(F.lit(block_rows), F.greatest(F.lit(k + 1), LEAD / F.col("dim"))))
    lead: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in bases:
        t = longest.filter(F.col("dim") == d).select("vec_id", "x").toArrow()
        lead[d] = t.column("vec_id").to_numpy(), t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
    shared = spark.sparkContext.broadcast(lead)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, floor = b.column("vec_id").to_numpy(), np.full(b.num_rows, np.nan)
            for d, (at, _) in stack(b.column("x")).items():
                cid, c = shared.value[d]
                q = b.column("x").take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                for i in range(0, len(at), 512):
                    score = np.where(ids[at[i : i + 512]][:, None] == cid[None, :], -np.inf, exact(q[i : i + 512], c).astype(np.float64))
                    if len(cid) >= k:
                        floor[at[i : i + 512]] = np.partition(score, len(cid) - k, axis=1)[:, len(cid) - k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "x", "dim", "length")), pa.array(np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), -np.inf))], ["vec_id", "x", "dim", "length", "floor"])

    queries = rows.filter(F.col("vec_id") % every == 0).mapInArrow(floors, "vec_id long, x array<long>, dim int, length double, floor double")
    need = F.when(F.col("floor") <= 0, F.lit(0.0)).when(F.col("length") == 0, F.lit(float("inf"))).otherwise(F.col("floor") / F.col("length") * (1 - 1e-9))
    queries = materialize(queries.withColumn("need", need).withColumn("copy", F.monotonically_increasing_id()), "queries")

    def levels(df: DataFrame, value: str, sign: int, most: int) -> dict[int, list[tuple[float, int, int]]]:
        """By dim: ranges of sign * value from the largest down, as (least sign * value, first block, blocks), of about most rows a block."""
        out: dict[int, list[tuple[float, int, int]]] = {}
        for d, n in df.groupBy("dim").count().collect():
            here = df.filter(F.col("dim") == d).select((F.lit(sign) * F.col(value)).alias("v"))
            cuts = min(ranges, -(-n // most))
            ends = sorted(set(here.select(F.percentile_approx("v", [i / cuts for i in range(1, cuts)])).first()[0]), reverse=True) if cuts > 1 else []
            sizes = dict(here.groupBy(F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<double>"), lambda e: e > F.col("v"))).alias("r")).count().collect())
            at, out[d] = 0, []
            for r in range(len(ends) + 1):
                blocks = max(1, -(-sizes.get(r, 0) // most))
                out[d].append((ends[r] if r < len(ends) else -math.inf, at, blocks))
                at += blocks
        return out

    by_length, by_need = levels(rows, "length", 1, block_rows), levels(queries, "need", -1, query_rows)
    by_dim = lambda f: F.coalesce(*[F.when(F.col("dim") == d, f(d)) for d in by_need]) if by_need else F.lit(None).cast("int")
    pick = lambda values, r: F.get(F.array(*map(F.lit, values)), r)
    rank = lambda table, value: lambda d: F.size(F.filter(F.array(*[F.lit(e) for e, *_ in table[d][:-1]]).cast("array<double>"), lambda e: e > value))
    block = lambda table, salt: by_dim(lambda d: pick([x[1] for x in table[d]], F.col("r")) + F.pmod(F.xxhash64("vec_id", F.lit(salt)), pick([x[2] for x in table[d]], F.col("r"))).cast("int"))

    def ends_of(df: DataFrame, table: dict, value: Column, end: Column, none: float) -> dict[int, list[float]]:
        """By dim: end over the rows of each range of the table, none for a range without rows."""
        out = {}
        for d in by_need:
            got = dict(df.filter(F.col("dim") == d).groupBy(rank(table, value)(d).alias("r")).agg(end).collect())
            out[d] = [got.get(r, none) for r in range(len(table[d]))]
        return out

    least_need, most_length = ends_of(queries, by_need, -F.col("need"), F.min("need"), math.inf), ends_of(rows, by_length, F.col("length"), F.max("length"), -math.inf)

    def reach(d: int) -> tuple[list[int], list[int]]:
        """For each range of queries how many candidate blocks it meets, the longest first, and for each range of candidates how many query blocks, those of the least need first."""
        q, c = by_need[d], by_length[d]
        needs, lengths = least_need[d], most_length[d]
        to_c = [max([x[1] + x[2] for x, m in zip(c, lengths) if m * (1 + 1e-9) >= need], default=0) for need in needs]
        to_q = [max([x[1] + x[2] for x, need in zip(q, needs) if m * (1 + 1e-9) >= need], default=0) for m in lengths]
        return to_c, to_q

    reached = {d: reach(d) for d in by_need}
    queries = queries.withColumn("r", by_dim(rank(by_need, -F.col("need")))).withColumn("qb", block(by_need, 2))
    queries = queries.withColumn("n", by_dim(lambda d: pick(reached[d][0], F.col("r")))).filter("n > 0").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cands = rows.filter(F.col("dim").isin(list(by_need))).withColumn("r", by_dim(rank(by_length, F.col("length")))).withColumn("cb", block(by_length, 3))
    cands = cands.withColumn("n", by_dim(lambda d: pick(reached[d][1], F.col("r")))).filter("n > 0").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = F.xxhash64("dim", "qb", "cb").alias("cell")
    both = queries.select("vec_id", "x", "dim", "length", "floor", "copy", F.lit(True).alias("is_query"), cell).unionByName(cands.select("vec_id", "x", "dim", "length", F.lit(0.0).alias("floor"), F.lit(0).cast("long").alias("copy"), F.lit(False).alias("is_query"), cell))
    cells = sum(sum(x[2] for x in by_need[d]) * sum(x[2] for x in by_length[d]) for d in by_need)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, cells))
    both = both.repartition(tasks, "cell").sortWithinPartitions("cell", F.col("is_query").desc(), F.col("length").desc(), "vec_id")
    return both.mapInArrow(by_key("cell", lambda held: best_of(held, bases, k, stages)), "query_id long, vec_id long, score long, copy long, met long, multiplied long")


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with rows, clamped to 64 bits."""
    bound = np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def exact_pairs(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products row by row, clamped to 64 bits."""
    bound = np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * q.shape[1]
    if bound < 2**63:
        return np.einsum("ij,ij->i", q, c)
    return np.clip((q.astype(object) * c.astype(object)).sum(axis=1), -(2**63), 2**63 - 1).astype(np.int64)


def best_of(held: list[pa.RecordBatch], bases: dict[int, np.ndarray], k: int, stages: int, chunk: int = 1024) -> Iterator[pa.RecordBatch]:
    """The k best candidates of one cell for each of its queries that reach the query's floor."""
    t = pa.Table.from_batches(held)
    d = t.column("dim")[0].as_py()
    asks = t.column("is_query").to_numpy()
    nq = int(asks.sum())
    if nq == 0 or nq == len(asks):
        return
    ids, length = t.column("vec_id").to_numpy(), t.column("length").to_numpy()
    x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
    q, c, qid, cid, qlen, clen = x[:nq], x[nq:], ids[:nq], ids[nq:], length[:nq], length[nq:]
    turned = x.astype(np.float64) @ bases[d]
    cuts = sorted({d * i // stages for i in range(1, stages)} - {0}) or [d]
    rest = np.sqrt(np.maximum(0.0, np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]))  # of the coordinates from each one on
    rest = np.append(rest, np.zeros((len(x), 1)), axis=1)
    floor = t.column("floor").to_numpy()[:nq].copy()
    qi, score, of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the best so far, k a query
    met = multiplied = 0
    for lo in range(0, nq, chunk):
        mine = np.arange(lo, min(lo + chunk, nq))
        best = (mine[:0], score[:0], of[:0])
        for i in range(0, len(c), chunk):
            rows = np.arange(i, min(i + chunk, len(c)))
            live = mine[qlen[mine] * clen[i] * (1 + 1e-9) >= floor[mine]]  # the chunk's first is its longest
            met += len(mine) * len(rows)
            if not len(live):
                continue
            slack = 1e-9 * (qlen[live][:, None] * clen[rows][None, :] + 1)
            sums, at, a, b = np.zeros((len(live), len(rows))), 0, None, None
            for cut in cuts:
                if a is None:
                    sums += turned[live, at:cut] @ turned[nq + rows, at:cut].T
                    keep = sums + rest[live, cut][:, None] * rest[nq + rows, cut][None, :] + slack >= floor[live][:, None]
                    if keep.mean() < 0.25 or cut == cuts[-1]:
                        a, b = np.nonzero(keep)
                        sums, slack = sums[a, b], slack[a, b]
                else:
                    sums = sums + np.einsum("ij,ij->i", turned[live[a], at:cut], turned[nq + rows[b], at:cut])
                    keep = sums + rest[live[a], cut] * rest[nq + rows[b], cut] + slack >= floor[live[a]]
                    a, b, sums, slack = a[keep], b[keep], sums[keep], slack[keep]
                at = cut
            a, b = live[a], rows[b]
            other = qid[a] != cid[b]
            a, b = a[other], b[other]
            multiplied += len(a)
            best = tuple(np.concatenate(z) for z in zip(best, (a, exact_pairs(q[a], c[b]), cid[b])))
            order = np.lexsort((best[2], np.invert(best[1]), best[0]))  # the largest score first: ~x falls as x grows
            first = np.searchsorted(best[0][order], best[0][order], "left")
            order = order[np.arange(len(order)) - first < k]
            best = tuple(z[order] for z in best)
            last = np.flatnonzero(np.arange(len(order)) - np.searchsorted(best[0], best[0], "left") == k - 1)
            floor[best[0][last]] = np.maximum(floor[best[0][last]], best[1][last].astype(np.float64) * (1 - 1e-12 * np.sign(best[1][last])))
        qi, score, of = (np.concatenate(z) for z in zip((qi, score, of), best))
    none = pa.nulls(len(qi), pa.int64())
    names = ["query_id", "vec_id", "score", "copy", "met", "multiplied"]
    yield pa.RecordBatch.from_arrays([pa.array(qid[qi]), pa.array(of), pa.array(score), pa.array(t.column("copy").to_numpy()[qi]), none, none], names)
    one = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([one, one, one, one, pa.array([met]), pa.array([multiplied])], names)


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
