import numpy as np

from sediment.llm import vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rid long, weight string")


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for c in range(12):
        base = rng.standard_normal(16)
        for _ in range(1 if c else 700):  # one hot group of near copies, over several blocks
            rows.append((len(rows), (base + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), c % 2, 0, "w"))
    rows += [(len(rows) + i, rows[3][1], 0, 0, "w") for i in range(3)]  # equal vectors
    x = np.array([r[1] for r in rows], np.float64)
    u, label = x / np.linalg.norm(x, axis=1)[:, None], np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(rows))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(rows)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for r in vectors.near_embeddings(frame(spark, rows)).collect():
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[r["vec_id"]].sum(), comp[r["vec_id"]], comp[r["vec_id"]] == r["vec_id"])


def test_rows_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1, 0, ""), (2, [0.0, 0.0], 1, 0, ""), (3, [1.0, None], 1, 0, ""), (4, [inf, 1.0], 1, 0, ""), (5, [nan, 1.0], 1, 0, ""), (6, [1.0, 1.0], None, 0, ""), (7, [1.0, 1.0], 1, 0, ""), (8, [1.0, 1.0], 1, 0, ""), (9, [1.0, 1.0, 0.0], 1, 0, ""), (10, [1.0, 1.0], 2, 0, ""), (11, [], 1, 0, "")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_embeddings(frame(spark, rows)).collect()}
    assert got == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)} | {7: (1, 7, True), 8: (1, 7, False)}


def test_repeated_rows_count_each(spark):
    got = vectors.near_embeddings(frame(spark, [(1, [1.0, 0.0], 1, 0, ""), (1, [1.0, 0.0], 1, 0, "")])).collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(1, 1), (1, 1)]


def test_no_vectors(spark):
    assert vectors.near_embeddings(frame(spark, [])).count() == 0
    assert vectors.top_products(frame(spark, [])).count() == 0


def brute(rows, every, k):
    ok = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x, *_ in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for qi, q in ok:
        if qi % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))[:k]
            out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(best)]
    return sorted(out)


def test_top_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 3)).astype(np.float32).tolist(), 0, 0, "") for i in range(400)]
    rows += [(400 + i, rows[5][1], 0, 0, "") for i in range(8)]  # ties
    rows += [(500, None, 0, 0, ""), (550, [float("nan")] * 8, 0, 0, ""), (None, rows[1][1], 0, 0, ""), (600, [0.0] * 8, 0, 0, ""), (650, [1.0, 2.0], 0, 0, ""), (700, [], 0, 0, "")]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_products(frame(spark, rows), query_rows=4, block_rows=64, stages=3, ranges=4).collect())
    assert got == brute(rows, 50, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e5, -1e5], 0, 0, ""), (1, [2e5, 7e5], 0, 0, ""), (2, [1.0, 1.0], 0, 0, "")]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_products(frame(spark, rows)).collect())
    assert got == brute(rows, 50, 5)


def test_most_products_are_pruned(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    spread = unit * np.exp(rng.standard_normal((3000, 1)))
    for rows, most in ((unit, 0.3), (spread, 0.05)):
        df = frame(spark, [(i, v.astype(np.float32).tolist(), 0, 0, "") for i, v in enumerate(rows)])
        r = vectors.products(df, 50, 5, 256.0, 8192, 512, 8, 64).agg({"met": "sum", "multiplied": "sum"}).first()
        assert r["sum(multiplied)"] <= most * 60 * 3000, r
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_products(df, block_rows=512).collect())
        assert got == brute([(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)], 50, 5)
