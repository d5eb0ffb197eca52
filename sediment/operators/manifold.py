"""A manifold reduction: nearest neighbours by random trees, the fuzzy union of their edges, a layout by blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import spent, written

#: Rows that trees and axes are fitted on, rows of a leaf, and trees that neighbours are looked for in.
SAMPLE, LEAF_ROWS, TREES = 20_000, 2000, 4
#: Of the layout: the curve of the attraction (a least distance of 0.1, a spread of 1), rounds, steps of a block in
#: a round, points away from which a point is pushed in a step, and positions that all blocks see in a round.
CURVE_A, CURVE_B = 1.577, 0.895
ROUNDS, STEPS, PUSHES, SEEN = 8, 25, 5, 2048


def along(x: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Each row's product with a direction, the same to the last bit whatever rows stand beside it."""
    return (x * direction).sum(axis=1)


def split(x: np.ndarray, most: int, rng: np.random.Generator) -> list:
    """A tree over rows of x: None for a leaf of at most most rows, else [direction, threshold, below, above], the threshold at the median."""
    if len(x) <= most:
        return []
    a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
    direction = a - b if (a != b).any() else rng.normal(size=x.shape[1])
    at = along(x, direction)
    middle = float(np.median(at))
    low = at < middle
    if not low.any():
        return []
    return [direction, middle, split(x[low], most, rng), split(x[~low], most, rng)]


def leaves(tree: list, x: np.ndarray) -> np.ndarray:
    """The number of each row's leaf."""
    out, todo, done = np.zeros(len(x), np.int64), [(tree, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        if not node:
            out[rows] = done
            done += 1
            continue
        low = along(x[rows], node[0]) < node[1]
        todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def in_leaves(points: DataFrame, tree: list, name: str) -> DataFrame:
    """points with the number of their leaf."""

    def walk(batches):
        for b in batches:
            at = leaves(tree, matrix(b.column("embedding"), b.num_rows)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, name])

    return points.mapInArrow(walk, f"id long, embedding array<double>, {name} long")


def nearest_in(x: np.ndarray, k: int, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, others and distances of each row's k nearest others in its part of at most about most rows."""
    part = leaves(split(x, most, rng), x)
    out = []
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        for i in range(0, len(at), 1024):  # a part that equal projections hold together may be larger
            rows = at[i : i + 1024]
            d = np.sqrt(np.maximum(0, (x[rows] ** 2).sum(1)[:, None] + (x[at] ** 2).sum(1)[None] - 2 * x[rows] @ x[at].T))
            d[np.arange(len(rows)), np.searchsorted(at, rows)] = np.inf
            n = min(k, len(at) - 1)
            if n > 0:
                near = np.argsort(d, axis=1, kind="stable")[:, :n]
                out.append((np.repeat(rows, n), at[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none.astype(float))


def neighbours(points: DataFrame, k: int, trees: list[list], seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """id, other, distance: for each point the k nearest that share a leaf with it in some tree; no point meets all others."""

    def near(g: pa.Table) -> pa.Table:
        g = g.sort_by("id")
        ids = g.column("id").to_numpy()
        rows, others, d = nearest_in(matrix(g.column("embedding"), g.num_rows), k, 2 * leaf_rows, np.random.default_rng([seed, len(ids)]))
        return pa.table({"id": ids[rows], "other": ids[others], "distance": d})

    found = None
    for tree in trees:
        some = in_leaves(points, tree, "leaf").groupBy("leaf").applyInArrow(near, "id long, other long, distance double")
        found = some if found is None else found.union(some)
    once = found.groupBy("id", "other").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return once.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def memberships(near: DataFrame, k: int) -> DataFrame:
    """a < b, w: the fuzzy union of directed memberships exp(-(distance - nearest) / scale), whose sum over a point's neighbours is log2(k)."""

    def weigh(batches):
        for b in batches:
            rows = []
            for i, cells in zip(b.column("id").to_pylist(), b.column("near").to_pylist()):
                d = np.array([c["distance"] for c in cells])
                above = np.maximum(0, d - (d[d > 0].min() if (d > 0).any() else 0))
                low, high, scale, goal = 0.0, np.inf, 1.0, np.log2(k)
                for _ in range(64):
                    total = np.exp(-above / scale).sum()
                    if abs(total - goal) < 1e-6:
                        break
                    low, high = (low, scale) if total > goal else (scale, high)
                    scale = (low + high) / 2 if np.isfinite(high) else scale * 2
                scale = max(scale, 1e-3 * d.mean(), 1e-12)
                rows += [(i, c["other"], float(w)) for c, w in zip(cells, np.exp(-above / scale))]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["id", "other", "w"])

    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))  # k at most
    directed = lists.mapInArrow(weigh, "id long, other long, w double")
    pair = directed.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return pair.agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.product("w")).otherwise(0.0).alias("p")).select("a", "b", (F.col("s") - F.col("p")).alias("w"))


def moved(own: np.ndarray, head: np.ndarray, tail: np.ndarray, weight: np.ndarray, outer: np.ndarray, seen: np.ndarray, steps: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Positions of a block's points after some steps: along edges to others (tail: a place in own, or, from len(own), in outer), away from sampled ones."""
    n, a, b = len(own), CURVE_A, CURVE_B
    at = np.concatenate([own, outer])
    for rate in steps:
        hit = rng.random(len(weight)) < weight
        h, t = head[hit], tail[hit]
        d = at[h] - at[t]
        square = (d * d).sum(1)
        pull = np.divide(-2 * a * b * square ** (b - 1), 1 + a * square**b, out=np.zeros_like(square), where=square > 0)
        force = np.clip(pull[:, None] * d, -4, 4)
        inner = t < n
        step = np.zeros_like(at)
        np.add.at(step, h, force)
        np.add.at(step, t[inner], -force[inner])
        pool = np.concatenate([at[:n], seen])
        for _ in range(PUSHES):
            d = at[h] - pool[rng.integers(0, len(pool), len(h))]
            square = (d * d).sum(1)
            push = np.where(square > 0, 2 * b / ((0.001 + square) * (1 + a * square**b)), 0)
            np.add.at(step, h, np.clip(push[:, None] * d, -4, 4))
        at[:n] += rate * step[:n]
    return at[:n]


def starter(centre: np.ndarray, axes: np.ndarray, dims: int, seed: int):
    """What gives points their start: their place on the main axes, a hundredth off at random."""

    def start(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"), b.num_rows) - centre
                at = np.zeros((b.num_rows, dims))
                for i, axis in enumerate(axes):
                    at[:, i] = along(x, axis)
                for row, k in enumerate(b.column("id").to_pylist()):
                    at[row] += np.random.default_rng([seed, abs(k)]).normal(0, 0.01, dims)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at.tolist(), pa.list_(pa.float64()))], ["id", "at"])

    return start


def mover(seen: np.ndarray, rate: np.ndarray, seed: int, turn: int):
    """What a leaf's task does in a round: own (id, at, leaf) after its steps along mine (id, other, w, there: where the other is)."""

    def move(own: pa.Table, mine: pa.Table) -> pa.Table:
        own, mine = own.sort_by("id"), mine.sort_by([("id", "ascending"), ("other", "ascending")])
        ids, x = own.column("id").to_numpy(), matrix(own.column("at"), own.num_rows)
        if mine.num_rows:
            head, other = np.searchsorted(ids, mine.column("id").to_numpy()), mine.column("other").to_numpy()
            tail = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
            outer = ids[tail] != other
            tail[outer] = len(ids) + np.arange(outer.sum())
            x = moved(x, head, tail, mine.column("w").to_numpy(), matrix(mine.column("there"), mine.num_rows)[outer], seen, rate, np.random.default_rng([seed, turn, abs(int(ids[0]))]))
        return pa.table({"id": ids, "at": pa.array(x.tolist(), pa.list_(pa.float64())), "leaf": own.column("leaf")})

    return move


def layout(vectors: DataFrame, dims: int = 2, k: int = 15, seed: int = 42, trees: int = TREES, leaf_rows: int = LEAF_ROWS, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """vec_id, reduced (dims coordinates) for vectors (vec_id, embedding): near points stay near. The same rows and seed give the same result.

    Trees over a bounded sample deal the points into leaves; neighbours are looked for within leaves, so the work is
    linear in the rows. Each point is drawn along its own k edges of the union. Points start on their main axes; in a
    round each leaf moves its own points, others stay as the last round wrote them. Equal vectors are one point. Null,
    empty and non-finite vectors are left out. Under three different vectors all stay at their start.
    """
    fine = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(fine)
    points = written(rows.groupBy("embedding").agg(F.min("vec_id").alias("id")).select("id", "embedding"), "points")
    n = points.count()
    if n == 0:
        return rows.select("vec_id", F.array().cast("array<double>").alias("reduced"))
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    some = points.orderBy(chance, "id").limit(SAMPLE)
    sample = np.array([r["embedding"] for r in some.orderBy("id").collect()])
    rng = np.random.default_rng(seed)
    most = max(1, len(sample) * leaf_rows // n)
    forest = [split(sample, most, rng) for _ in range(trees)]

    near = written(neighbours(points, k, forest, seed, leaf_rows), "near")
    union = written(memberships(near, k), "union")
    pair = near.select("id", "other", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    placed = written(in_leaves(points, forest[0], "leaf").select("id", "leaf"), "leaves")
    edges = written(pair.join(union, ["a", "b"]).join(placed, "id").select("leaf", "id", "other", "w"), "edges")

    centre = sample.mean(axis=0)
    axes = np.linalg.svd(sample - centre, full_matrices=False)[2][:dims]
    scale = 10 / (np.abs((sample - centre) @ axes.T).max() or 1.0)
    first = points.mapInArrow(starter(centre, axes * scale, dims, seed), "id long, at array<double>")
    at = written(first.join(placed, "id"), "positions")

    rates = np.linspace(1, 0, rounds * steps, endpoint=False).reshape(rounds, steps)
    for r in range(rounds if n > 2 else 0):
        seen = np.array([x["at"] for x in at.orderBy(F.xxhash64("id", F.lit(seed + r)), "id").limit(SEEN).collect()])
        move = mover(seen, rates[r], seed, r)
        drawn = edges.join(at.select(F.col("id").alias("other"), F.col("at").alias("there")), "other").select("leaf", "id", "other", "w", "there")
        after = written(at.groupBy("leaf").cogroup(drawn.groupBy("leaf")).applyInArrow(move, "id long, at array<double>, leaf long"), "positions")
        spent(at)
        at = after
    out = rows.join(points.select("id", F.col("embedding").alias("_e")), F.col("embedding") == F.col("_e")).join(at, "id").select("vec_id", F.col("at").alias("reduced"))
    out = written(out, "layout")
    spent(points, near, union, placed, edges, at)
    return out
