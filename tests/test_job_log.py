"""The append-only job log and the stream that works it off: crashes, repeats, compaction."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sediment.streaming import jobs


def asked(spark, *rows):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    return spark.createDataFrame([(i, kind, p, "{}", at(s)) for i, kind, p, s in rows], "job_id string, job_type string, priority int, payload string, created_at timestamp")


def worked(log, handlers, **more):
    q = log.work(handlers, lambda: F.lit("2024-01-02").cast("timestamp"), **more).trigger(availableNow=True).start()
    q.awaitTermination(120)


def states(log):
    rows = log.jobs().collect()
    assert len({r["job_id"] for r in rows}) == len(rows)
    return {r["job_id"]: (r["status"], r["error"]) for r in rows}


class Killed(jobs.JobLog):
    """Dies between a batch's claim and its end."""

    def _end(self, *args):
        raise RuntimeError("killed")


def test_order_failures_and_repeats(spark, tmp_path):
    log, seen = jobs.JobLog(spark, str(tmp_path)), []
    log.enqueue(asked(spark, ("a", "x", 3, 1), ("b", "x", 3, 2), ("c", "y", 1, 5), ("d", "z", 2, 1), ("e", None, 2, 1), (None, "x", 1, 1), ("a", "x", 1, 9)))
    assert states(log) == {i: ("pending", None) for i in "abcde"}

    def note(df):
        seen.append(sorted(r["job_id"] for r in df.collect()))

    def broken(df):
        raise ValueError("it broke")

    worked(log, {"x": note, "y": note, "z": broken, "unused": note})
    assert seen == [["c"], ["a", "b"]]
    want = {"a": ("completed", None), "b": ("completed", None), "c": ("completed", None), "d": ("failed", "it broke"), "e": ("failed", "no handler for null")}
    assert states(log) == want
    log.enqueue(asked(spark, ("a", "x", 1, 1), ("f", "x", 1, 1)))
    again = jobs.JobLog(spark, str(tmp_path))
    worked(again, {"x": note})
    assert seen[2:] == [["f"]] and states(again) == want | {"f": ("completed", None)}
    worked(again, {})
    assert states(again) == want | {"f": ("completed", None)}


@pytest.mark.parametrize("again", [True, False])
def test_a_run_killed_between_claim_and_end(spark, tmp_path, again):
    seen = []
    note = {"x": lambda df: seen.append(sorted(r["job_id"] for r in df.collect()))}
    first = jobs.JobLog(spark, str(tmp_path))
    first.enqueue(asked(spark, ("o", "x", 1, 1)))
    worked(first, note)
    first.enqueue(asked(spark, ("a", "x", 1, 1), ("b", "x", 2, 1)))
    with pytest.raises(Exception, match="killed"):
        worked(Killed(spark, str(tmp_path)), note)
    running = {"o": ("completed", None), "a": ("running", None), "b": ("running", None)}
    assert states(first) == running
    first.compact(F.lit("2024-01-03").cast("timestamp"))  # what isn't ended isn't folded
    assert states(first) == running
    first.enqueue(asked(spark, ("c", "x", 1, 1)))
    worked(jobs.JobLog(spark, str(tmp_path)), note, again=again)
    done = {i: ("completed", None) for i in "oabc"}
    assert states(first) == (done if again else done | running)
    assert seen == [["o"], ["a", "b"]] + [["a", "b"]] * again + [["c"]]


def test_compaction_keeps_what_is_known(spark, tmp_path):
    log = jobs.JobLog(spark, str(tmp_path))
    note = {"x": lambda df: None}
    for i in range(3):
        log.enqueue(asked(spark, (f"j{i}", "x", 1, i)))
        worked(log, note)
    before = states(log)
    log.compact(F.lit("2024-01-03").cast("timestamp"))
    assert states(log) == before and len(before) == 3 and not log._names("claims") and len(log._names("base")) == 1
    log.compact(F.lit("2024-01-03").cast("timestamp"))
    log.enqueue(asked(spark, ("j1", "x", 1, 1), ("new", "x", 1, 1)))
    assert states(log) == before | {"new": ("pending", None)}
    worked(log, note)
    # Ended long ago: dropped, and not taken up again by what had asked for them.
    log.compact(F.lit("2024-03-01").cast("timestamp"))
    assert states(log) == {}
    log.enqueue(asked(spark, ("j2", "x", 1, 1)))
    worked(log, {"x": lambda df: 1 / 0})
    assert states(log) == {}


def test_empty_log(spark, tmp_path):
    log = jobs.JobLog(spark, str(tmp_path))
    log.enqueue(asked(spark))
    worked(log, {})
    log.compact(F.current_timestamp())
    assert states(log) == {}
