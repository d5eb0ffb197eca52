"""The manifold reduction keeps neighbourhoods; its steps against brute force."""

import numpy as np

from sediment.operators import manifold, models


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def trustworthiness(x, y, k):
    """How few of a point's k nearest in y are far off in x, by rank."""
    n = len(x)
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    low = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(low, np.inf)
    near = np.argsort(low, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) - k + 1).sum()


def curve(rng, n):
    t, h = rng.uniform(1, 4, n) * np.pi, rng.uniform(0, 8, n)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], 1)
    return np.concatenate([x, rng.normal(0, 0.1, (n, 5))], 1)


def test_neighbourhoods_are_kept(spark):
    rng = np.random.default_rng(1)
    groups = np.repeat(rng.normal(0, 4, (8, 16)), 100, axis=0) + rng.normal(0, 1, (800, 16))
    rolled = curve(rng, 800)
    for x in (groups, rolled):
        out = {r["vec_id"]: r["reduced"] for r in manifold.layout(frame(spark, x), leaf_rows=250).collect()}
        y = np.array([out[i] for i in range(len(x))])
        kept = trustworthiness(x, y, 12)
        print(f"trustworthiness {kept:.3f}")
        assert y.shape == (800, 2) and np.isfinite(y).all() and kept >= 0.9


def test_same_seed_same_result(spark):
    x = curve(np.random.default_rng(2), 300)
    df = frame(spark, np.concatenate([x, x[:5]]))
    a, b = ({r["vec_id"]: r["reduced"] for r in manifold.layout(d, rounds=2, steps=5, leaf_rows=100).collect()} for d in (df, df.repartition(5)))
    assert a == b and all(a[300 + i] == a[i] for i in range(5))


def test_neighbours_and_memberships(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(0, 5, (20, 8)), 50, axis=0) + rng.normal(0, 0.5, (1000, 8))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    forest = [manifold.split(x, 150, rng) for _ in range(4)]
    got = manifold.neighbours(points, 10, forest, 1, 150).collect()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = {(i, int(j)) for i in range(1000) for j in np.argsort(far[i])[:10]}
    assert len(got) == 10_000 and all(abs(r["distance"] - far[r["id"], r["other"]]) < 1e-6 for r in got)
    assert len(want & {(r["id"], r["other"]) for r in got}) >= 0.9 * len(want)
    near = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (2, 3, 3.0), (3, 1, 2.0), (3, 2, 3.0)], "id long, other long, distance double")
    w = {(r["a"], r["b"]): r["w"] for r in manifold.memberships(near, 2).collect()}
    assert w[(1, 2)] == 1.0 and 0 < w[(2, 3)] < w[(1, 3)] <= 1
    assert sorted(w) == [(1, 2), (1, 3), (2, 3)]


def test_few_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [float("nan")]), (4, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(r["vec_id"] for r in manifold.layout(df).collect()) == [4, 5]
    assert manifold.layout(df.limit(0)).count() == manifold.layout(df.filter("vec_id < 4")).count() == 0


def test_linear_models(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(0, 9, (4, 6)), 30, axis=0) + rng.normal(0, 0.1, (120, 6))
    got = {r["vec_id"]: r["cluster"] for r in models.cluster(frame(spark, x), 4).collect()}
    assert len({got[i] for i in range(120)}) == 4 and all(len({got[30 * g + i] for i in range(30)}) == 1 for g in range(4))
    assert models.cluster(frame(spark, x[:19])).count() == 0
    y = np.array([r["reduced"] for r in models.reduce(frame(spark, x), 2).orderBy("vec_id").collect()])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(y), np.abs(x.astype(np.float32) @ axes.T), atol=1e-3)
