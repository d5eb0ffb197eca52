"""The graph index against brute force: recall, the share of rows compared, and what is in it."""

import numpy as np

from sediment.operators.graph_index import Graph, GraphIndex, built, unit
from sediment.operators.models import InvertedFile


def clustered(rng, n, dims=32, groups=60):
    centres = rng.normal(0, 1, (groups, dims))
    return (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.35, (n, dims))).astype(np.float32)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")


def test_recall_and_share_of_rows_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = clustered(rng, 12_000)
    queries = clustered(np.random.default_rng(2), 60) * 0.3 + x[rng.integers(0, len(x), 60)]
    index = GraphIndex.build(frame(spark, range(len(x)), x), part_rows=6000)
    assert index.parts == 2
    assert index.rows.count() == len(x) == index.rows.select("vec_id").distinct().count()  # every row is in the index
    folder = f"{tmp_path}/graph"
    index.save(folder)
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, query array<float>")
    exact = np.argsort(-unit(queries) @ unit(x).T, axis=1, kind="stable")[:, :10]
    got = GraphIndex.load(spark, folder).nearest_batch(asked, 10).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    recall = sum((i, int(v)) in found for i, vs in enumerate(exact) for v in vs) / exact.size
    share = np.mean([r["compared"] for r in got if r["rank"] == 1]) / len(x)
    print(f"recall@10 {recall:.3f}, rows compared {share:.3f}")
    assert len(got) == 600 and recall >= 0.9 and share < 0.1
    again = GraphIndex.build(frame(spark, range(len(x)), x).repartition(5), part_rows=6000).nearest_batch(asked, 10, most=25).collect()
    assert sorted(again) == sorted(got)  # the same rows give the same graphs, in groups of queries too


def test_graph_holds_every_node():
    x = unit(clustered(np.random.default_rng(3), 1500))
    graph = built(x, 1, links=8, width=32)
    reached, front = {graph.entry}, [graph.entry]
    while front:
        fresh = set(graph.links[front.pop()][0].tolist()) - reached
        reached |= fresh
        front += fresh
    assert len(reached) >= 0.99 * len(x)
    assert all(len(ls[0]) <= 16 and all(len(up) <= 8 for up in ls[1:]) for ls in graph.links)
    loaded = Graph(x, graph.links)
    assert [loaded.nearest(q, 5, 32) for q in x[:20]] == [graph.nearest(q, 5, 32) for q in x[:20]]
    assert all(graph.nearest(q, 1, 32)[0][0] < 1e-5 for q in x[::50])


def test_odd_vectors_and_queries(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = GraphIndex.build(df)
    asked = spark.createDataFrame([(1, [3.0, 0.1]), (2, None), (3, [0.0, 0.0])], "query_id long, query array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(index.nearest_batch(asked, 5).collect())] == [(1, 1, 6), (1, 2, 7), (1, 3, 8)]
    none = GraphIndex.build(df.limit(0))
    assert none.rows.count() == 0 and none.nearest_batch(asked, 5).count() == 0


def test_inverted_file_at_its_defaults(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 6000)
    asked = [(i, q.tolist()) for i, q in enumerate(x[:40] + rng.normal(0, 0.1, (40, 32)).astype(np.float32))]
    exact = np.argsort(-unit(np.array([q for _, q in asked])) @ unit(x).T, axis=1, kind="stable")[:, :10]
    got = InvertedFile.build(frame(spark, range(len(x)), x)).nearest_batch(spark.createDataFrame(asked, "query_id long, query array<float>"), 10)  # 100 cells, of which 10 are read
    found = {(r["query_id"], r["vec_id"]) for r in got.collect()}
    assert sum((i, int(v)) in found for i, vs in enumerate(exact) for v in vs) >= 0.9 * exact.size
