"""The stream of changed files: restarts, filters, and the way from a change to a job that is done."""

import json
import os
import time

from pyspark.sql import functions as F

from sediment.streaming import jobs, watch


def put(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)


def polled(df, out, checkpoint):
    """One run of the stream over what has changed so far."""
    time.sleep(0.3)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
    q.awaitTermination(120)


def test_two_restarts_lose_and_repeat_nothing(spark, tmp_path):
    root, out, checkpoint = tmp_path / "r", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(root, "a.txt", "d/b.txt", "d/e/f/c.txt", "d/e/f/g/h.txt")
    stream = lambda: watch.changes(spark, [str(root)], settle=0.1)
    polled(stream(), out, checkpoint)
    rows = lambda: sorted((os.path.relpath(r["path"], root), r["kind"], r["size"]) for r in spark.read.parquet(out).collect())
    first = [(n, "created", len(n)) for n in ("a.txt", "d/b.txt", "d/e/f/c.txt", "d/e/f/g/h.txt")]
    assert rows() == first
    put(root, "d/new.txt", "a.txt")
    old = tmp_path / "old.txt"
    old.write_text("x")
    os.utime(old, (1, 1))  # moved in with an old date
    old.rename(root / "moved.txt")
    polled(stream(), out, checkpoint)
    second = [("a.txt", "modified", 5), ("d/new.txt", "modified", 9), ("moved.txt", "modified", 1)]
    assert rows() == sorted(first + second)
    polled(stream(), out, checkpoint)
    put(root, "d/e/last.txt")
    polled(stream(), out, checkpoint)
    assert rows() == sorted(first + second + [("d/e/last.txt", "modified", 12)])


def test_a_batch_that_runs_again_has_the_same_files(tmp_path):
    put(tmp_path, "a", "b/c", "b/d/e", "b/d/f/g")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    reader = watch.ChangeReader({"roots": json.dumps([str(tmp_path), str(tmp_path / "missing")]), "settle": "0"})
    start, end = reader.initialOffset(), reader.latestOffset()
    read = lambda a, b: sorted(os.path.relpath(r[1], tmp_path) for p in reader.partitions(a, b) for r in reader.read(p))
    assert read(start, end) == read(start, end) == ["a", "b/c", "b/d/e", "b/d/f/g"]
    time.sleep(0.05)
    put(tmp_path, "b/c", "n")
    later = reader.latestOffset()
    assert read(start, end) == ["a", "b/d/e", "b/d/f/g"] and read(end, later) == ["b/c", "n"]
    for levels in (0, 1, 4):
        reader.levels = levels
        assert read(start, later) == ["a", "b/c", "b/d/e", "b/d/f/g", "n"]


def test_wanted(spark):
    paths = ["/r/a.TXT", "/r/x/y/b.txt", "/r/.hidden", "/r/node_modules/c.txt", "/s/d.txt", "/r/e"]
    df = spark.createDataFrame([("/r", p, p.rsplit("/", 1)[1]) for p in paths], "root string, path string, name string")
    got = lambda *a: [r["path"] for r in watch.wanted(df, *a).collect()]
    assert got() == ["/r/a.TXT", "/r/x/y/b.txt", "/s/d.txt", "/r/e"]
    assert got(1) == ["/r/a.TXT", "/r/e"] and got(None, ["TXT"]) == ["/r/a.TXT", "/r/x/y/b.txt", "/s/d.txt"]


def test_from_a_change_to_a_job_done(spark, tmp_path):
    root, log = tmp_path / "r", jobs.JobLog(spark, f"{tmp_path}/log")
    put(root, "report.md", "sub/conversations.json", ".hidden")
    asks = watch.jobs_of(watch.wanted(watch.changes(spark, [str(root)], settle=0.1)))
    time.sleep(0.3)
    for _ in range(2):  # the second run finds nothing new
        log.ask(asks, f"{tmp_path}/asks").trigger(once=True).start().awaitTermination(120)
    kinds = ("file_extraction", "fae_processing")
    seen = []
    note = lambda df: seen.extend((r["job_type"], r["priority"], os.path.relpath(json.loads(r["payload"])["path"], root)) for r in df.collect())
    log.work({k: note for k in kinds}).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [("fae_processing", 2, "sub/conversations.json"), ("file_extraction", 3, "report.md")]
    assert [r["n"] for r in log.jobs().groupBy("status").agg(F.count("*").alias("n")).collect()] == [2]
