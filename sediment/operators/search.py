"""Vector search: exact cosine and squared Euclidean distance, filters, batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k rows (vec_id, embedding) nearest to one query; the filter comes before the distance, ties by vec_id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.filter(where)
    d = cosine_distance(F.col("embedding"), q) if metric == "cosine" else squared_l2(F.col("embedding"), q)
    return rows.withColumn("distance", d).orderBy("distance", "vec_id").limit(k)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles; one of another length, or that holds a null or non-finite component, is a row of NaN."""
    lists = column.combine_chunks()
    out = np.full((len(lists), width), np.nan)
    fits = pc.equal(pc.list_value_length(lists), width).fill_null(False)
    flat = lists.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) + 0.0
    flat[~np.isfinite(flat).all(axis=1)] = np.nan
    out[fits.to_numpy(zero_copy_only=False)] = flat
    return out


def first_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """The places of rows but for those that k equal ones precede."""
    same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    return np.sort(order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k])


def in_turn(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of a and b, component after component, as cosine_distance and squared_l2 add them."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        if metric == "cosine":
            ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
        else:
            ab = ab + (x - y) * (x - y)
    return 1 - ab / np.sqrt(aa * bb) if metric == "cosine" else ab


def nearest_rows(a: np.ndarray, q: np.ndarray, k: int, metric: str, piece: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k nearest rows of a, ties by place: rows of q, rows of a, distances (NaN comes last).

    A product of matrices leaves those that its rounding can't rule out; their distances are then added component after component.
    """
    with np.errstate(all="ignore"):
        aa, qq = (a * a).sum(1), (q * q).sum(1)
        if metric == "cosine":
            unit, asked = a / np.sqrt(aa)[:, None], q / np.sqrt(qq)[:, None]
        out = []
        for at in range(0, len(q), piece):
            if metric == "cosine":
                far, slack = 1 - asked[at : at + piece] @ unit.T, 1e-9
            else:
                far = qq[at : at + piece, None] + aa - 2 * q[at : at + piece] @ a.T
                slack = 1e-9 * (qq[at : at + piece, None] + np.nanmax(aa, initial=0))
            bound = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if len(a) > k else np.nan
            i, j = np.nonzero(~(far > bound + slack))
            d = np.concatenate([np.zeros(0), *[in_turn(q[at + i[x : x + (1 << 17)]], a[j[x : x + (1 << 17)]], metric) for x in range(0, len(i), 1 << 17)]])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((at + i[kept], j[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", most: int = 4096, block: int = 8192) -> DataFrame:
    """The k nearest rows for each of queries (query_id, query), exact; those without a distance come last, ties by vec_id.

    A block of about block vectors meets a group of about most queries in a task of its own, by products of matrices,
    and gives k rows a query; nothing passes through the driver but the two numbers of rows.
    """
    groups, blocks = max(1, -(-queries.count() // most)), max(1, -(-vectors.count() // block))
    blocks = max(blocks, min(vectors.sparkSession.sparkContext.defaultParallelism, 4 * blocks))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = vectors.select("vec_id", "embedding", part("vec_id", blocks).alias("b"), upto(groups).alias("g"))
    q = queries.select("query_id", "query", part("query_id", groups).alias("g"), upto(blocks).alias("b"))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("vec_id"), []
        widths = pc.list_value_length(asked.column("query").combine_chunks()).fill_null(0)
        for width in widths.unique().to_pylist():
            some = asked.filter(pc.equal(widths, width))
            m = matrix(rows.column("embedding"), width or 1)
            places = first_copies(m, k)
            i, j, d = nearest_rows(m[places], matrix(some.column("query"), width or 1), k, metric)
            out.append(pa.table({"query_id": some.column("query_id").take(pa.array(i)), "vec_id": rows.column("vec_id").take(pa.array(places[j])), "distance": pa.array(d, from_pandas=True)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": asked.column("query_id"), "vec_id": rows.column("vec_id")[:0], "distance": pa.array([], pa.float64())})

    schema = f"query_id {dict(q.dtypes)['query_id']}, vec_id {dict(a.dtypes)['vec_id']}, distance double"
    met = a.groupBy("b", "g").cogroup(q.groupBy("b", "g")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def hybrid(vectors: DataFrame, queries: DataFrame, k: int = 10, strategy: str = "auto", index=None) -> DataFrame:
    """A batch search by the caller's strategy: flat and auto are exact at every size; indexed asks an index, which it needs."""
    if strategy in ("auto", "flat"):
        return nearest_batch(vectors, queries, k)
    if strategy != "indexed" or index is None:
        raise ValueError("the strategy is auto, flat, or indexed with an index")
    return index.nearest_batch(queries, k)
