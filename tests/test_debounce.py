"""Debouncing in stretches, against the fold over each key's events."""

import random

import numpy as np
from pyspark.sql import functions as F

from sediment.streaming import events


def fold(pairs, gap):
    last, out = {}, []
    for k, t in sorted(pairs, key=lambda x: (x[0] or "", x[1])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            out.append((k or "", t))
    return sorted(out)


def through(spark, pairs, gap, stretch):
    df = spark.createDataFrame(pairs, "path string, t long").select("path", F.timestamp_micros("t").alias("ts"))
    got = events.debounce_batch(df, "path", "ts", gap, stretch).select("path", F.unix_micros("accepted_at").alias("t"))
    return sorted((r["path"] or "", r["t"]) for r in got.collect())


def test_random_events_equal_the_fold(spark):
    for seed in range(4):
        r = random.Random(seed)
        # Half of the events are of one path; ties, dense and sparse times, a null path, times before 1970.
        pairs = [("hot", r.randrange(-20_000_000, 400_000_000)) for _ in range(3000)]
        pairs += [(r.choice(["a", "b", None]), r.randrange(0, 90_000_000) // 500_000 * 500_000) for _ in range(1500)]
        pairs += [(f"k{i}", 7) for i in range(50)] * 2
        for gap, stretch in ((2.0, 1), (2.0, 7), (0.5, 256), (1000.0, 2)):
            assert through(spark, pairs, gap, stretch) == fold(pairs, int(gap * 1_000_000))


def test_ways_out_hold_for_each_entry():
    r = np.random.default_rng(3)
    for _ in range(200):
        gap = int(r.integers(1, 40))
        runs = [np.sort(r.integers(s, s + 300, r.integers(1, 80))) for s in (1000, 5000)]
        run = np.repeat([0, 1], [len(x) for x in runs])
        of, ends, exits = events.ways_out(run, np.concatenate(runs), np.repeat([1000, 5000], [len(x) for x in runs]), gap)
        for i, start in enumerate((1000, 5000)):
            for last in range(start - 60, start):
                clock = last
                for t in runs[i]:
                    clock = t if t >= clock + gap else clock
                at = int(np.searchsorted(ends[of == i], last + gap))
                assert (int(exits[of == i][at]) if at < (of == i).sum() else last) == clock


def test_one_path_uses_many_tasks(spark):
    """All events are of one path: every partition of the last pass has a share, none more than a half."""
    rows = spark.range(40_000).select(F.lit("p").alias("path"), F.timestamp_micros(F.col("id") * 300_000).alias("ts"))
    df = events.debounce_batch(rows, "path", "ts", 2.0, 16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(shares) == len(fold([("p", i * 300_000) for i in range(40_000)], 2_000_000))
    assert len(shares) >= 6 and max(shares) <= sum(shares) / 2


def test_empty_and_gapless(spark):
    empty = spark.createDataFrame([], "path string, t long")
    assert through(spark, [("a", 1)], 0.0, 8) == [("a", 1)]
    assert events.debounce_batch(empty.select("path", F.timestamp_micros("t").alias("ts")), "path", "ts").count() == 0


def test_stretches_longer_than_a_batch(spark):
    r = random.Random(8)
    pairs = [("hot", r.randrange(0, 300_000_000)) for _ in range(2500)] + [(f"k{i % 40}", r.randrange(0, 9_000_000)) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        for gap, stretch in ((2.0, 100), (0.1, 3000), (400.0, 1)):
            assert through(spark, pairs, gap, stretch) == fold(pairs, int(gap * 1_000_000))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
