"""Jobs: a queue over the catalog, a worker, the expansion of a batch, what file events ask for, and schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators.stages import spent, written
from ..sources.catalog import Catalog

# Priorities of jobs, the least first.
PRIORITIES = {"user": 1, "exports": 2, "recent": 3, "scheduled": 4, "background": 5}
JOB = "job_id string, job_type string, status string, priority int, payload string, created_at timestamp, started_at timestamp, completed_at timestamp, error string"


def waiting(jobs: DataFrame) -> DataFrame:
    """Pending jobs in the order of work: by priority, then age, then id. Running ones are not taken up again."""
    return jobs.filter("status = 'pending'").orderBy("priority", "created_at", "job_id")


def places(jobs: DataFrame) -> DataFrame:
    """Pending jobs with their place among those of their priority.

    Jobs are numbered within an hour; the hours before it add their counts, so no task sorts a whole priority.
    """
    pending = jobs.filter("status = 'pending'").withColumn("_hour", F.coalesce(F.date_trunc("hour", "created_at"), F.timestamp_seconds(F.lit(0))))
    earlier = Window.partitionBy("priority").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = pending.groupBy("priority", "_hour").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("priority", "_hour").orderBy("created_at", "job_id"))
    return pending.withColumn("_in", within).join(before, ["priority", "_hour"]).withColumn("place", F.col("_in") + F.col("_before")).drop("_hour", "_in", "_before")


class Queue:
    """Jobs as a table of the catalog; what is pending there is what a new process starts with."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "jobs"):
        self.spark, self.catalog, self.name = spark, Catalog(spark, folder), name

    def enqueue(self, jobs: DataFrame) -> None:
        self.catalog.insert(self.name, jobs, ["job_id"])

    def jobs(self) -> DataFrame:
        return self.catalog.read(self.name)

    def update(self, updates: DataFrame, now: Column) -> None:
        self.catalog.update_jobs(self.name, updates, "job_id", now)

    def cleanup(self, now: Column, days: int = 7) -> None:
        self.catalog.drop_old_jobs(self.name, now, days)

    def work(self, handlers: dict[str, Callable[[DataFrame], None]], now: Column, batch: int = 1000) -> int:
        """Hand the next jobs to the handler of their type, a batch of them as a DataFrame, until none is pending; returns how many.

        A handler that raises fails its batch's jobs of that type; a type without a handler fails too.
        """
        done = 0
        while True:
            mine = written(waiting(self.jobs()).limit(batch).select("job_id", "job_type", "priority", "created_at"), "claimed")
            if not (n := mine.count()):
                spent(mine)
                return done
            self.update(mine.select("job_id", F.lit("running").alias("new_status"), F.lit(None).cast("string").alias("new_error")), now)
            errors = hand_out(mine, handlers, lambda own: self.jobs().join(own.select("job_id"), "job_id", "left_semi"))
            ends = mine.select("job_id", failure(handlers, errors).alias("new_error"))
            self.update(ends.select("job_id", F.when(F.col("new_error").isNull(), "completed").otherwise("failed").alias("new_status"), "new_error"), now)
            spent(mine)
            done += n


def hand_out(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], rows: Callable[[DataFrame], DataFrame] = lambda own: own) -> dict[str, str]:
    """Give each handler its type's jobs, the type of the most urgent job first; what those that raised said."""
    errors: dict[str, str] = {}
    if not handlers:
        return errors
    known = jobs.filter(F.col("job_type").isin(*handlers))
    # A row for each handler at most.
    for r in known.groupBy("job_type").agg(F.min(F.struct("priority", "created_at")).alias("at")).orderBy("at", "job_type").collect():
        try:
            handlers[r["job_type"]](rows(jobs.filter(F.col("job_type") == r["job_type"])))
        except Exception as e:  # a handler's failure is the job's result
            errors[r["job_type"]] = str(e)
    return errors


def failure(handlers: dict[str, Callable[[DataFrame], None]], errors: dict[str, str]) -> Column:
    """The error of a job of a type, null if it went well."""
    kind = F.col("job_type")
    known = F.coalesce(kind.isin(*handlers), F.lit(False)) if handlers else F.lit(False)
    out = F.when(~known, F.concat(F.lit("no handler for "), F.coalesce(kind, F.lit("null"))))
    for k, text in errors.items():
        out = out.when(kind == k, text)
    return out


def farthest(log: DataFrame) -> DataFrame:
    """Of each job_id the row of the highest step, the oldest of equals; partial results are merged before the shuffle."""
    rest = [c for c in log.columns if c != "job_id"]
    order = F.struct(-F.col("step"), F.coalesce("created_at", F.timestamp_seconds(F.lit(0))), F.coalesce("priority", F.lit(0)), F.coalesce("job_type", F.lit("")), F.coalesce("payload", F.lit("")))
    return log.groupBy("job_id").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("job_id", *[F.col(f"_r.{c}") for c in rest])


class JobLog:
    """Jobs as a log that is only appended to, worked off by a stream.

    Under the folder lie what was asked for (a job a row), and for each batch of the stream what it claimed and how that
    ended. A batch's folders are named by its number and replaced if the batch runs again, which Spark's checkpoint makes
    it do after a crash, with the same rows: so a run killed between claim and end leaves each job once. Handlers see such
    a batch's jobs again; with again=False they don't, and the jobs stay running, as a queue in one process leaves them.
    An id asked for more than once is one job, the oldest; nulls are no ids. No job passes through the driver.
    """

    # How far a job has come: rows of the log with a higher step hide those below. Dropped jobs are seen by nobody.
    ASKED, CLAIMED, ENDED, DROPPED = range(4)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.asked = f"{self.folder}/asked"
        self._path(self.asked).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(self._path(self.asked))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, kind: str) -> list[str]:
        """Whole folders of a kind, by batch."""
        at = self._path(f"{self.folder}/{kind}")
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
        return sorted(n for n in found if store.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _read(self, kind: str, names: list[str], step: int | None) -> DataFrame:
        schema = JOB if step is not None else f"{JOB}, step int"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)
        return rows if step is None else rows.withColumn("step", F.lit(step))

    def _log(self, last: str | None = None) -> DataFrame:
        """Rows of the log: what was asked for and is still there, the newest base, the batches after it up to the last."""
        base = self._names("base")[-1:]
        asked = self.spark.read.schema(JOB).parquet(self.asked).withColumn("step", F.lit(self.ASKED))
        rows = asked.unionByName(self._read("base", base, None))
        for kind, step in (("claims", self.CLAIMED), ("ends", self.ENDED)):
            rows = rows.unionByName(self._read(kind, [n for n in self._names(kind) if (not base or n > base[0]) and (last is None or n <= last)], step))
        return rows.filter("job_id is not null")

    def jobs(self) -> DataFrame:
        """Jobs as they stand."""
        return farthest(self._log()).filter(F.col("step") < self.DROPPED).drop("step")

    def enqueue(self, jobs: DataFrame) -> None:
        """Append jobs; columns that jobs lack are null, a status that is not given is pending."""
        have = set(jobs.columns)
        fields = [f.split() for f in JOB.split(", ")]
        cols = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields]
        jobs.select(*cols).withColumn("status", F.coalesce("status", F.lit("pending"))).write.mode("append").parquet(self.asked)

    def ask(self, jobs: DataFrame, checkpoint: str):
        """A stream of jobs into the log; what is asked again after a crash is one job by its id."""
        return jobs.writeStream.foreachBatch(lambda df, _: self.enqueue(df)).option("checkpointLocation", checkpoint)

    def _claim(self, name: str, new: DataFrame, now: Callable[[], Column]) -> None:
        """The batch's pending jobs that no other batch has, the oldest of an id. Of the log only these ids are asked for."""
        pending = new.filter("status = 'pending' and job_id is not null")
        base, claims = self._names("base")[-1:], [n for n in self._names("claims") if n != name]
        taken = self._read("base", base, None).select("job_id").union(self._read("claims", claims, self.CLAIMED).select("job_id"))
        taken = taken.join(pending.select("job_id").distinct(), "job_id", "left_semi").distinct()
        mine = farthest(pending.withColumn("step", F.lit(self.ASKED))).drop("step").join(taken, "job_id", "left_anti")
        mine.withColumn("status", F.lit("running")).withColumn("started_at", now()).write.mode("overwrite").parquet(f"{self.folder}/claims/{name}")

    def _end(self, name: str, running: DataFrame, error: Column, now: Callable[[], Column]) -> None:
        ended = running.withColumn("error", error).withColumn("completed_at", now())
        ended.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).write.mode("overwrite").parquet(f"{self.folder}/ends/{name}")

    def _batch(self, new: DataFrame, number: int, handlers: dict[str, Callable[[DataFrame], None]], now: Callable[[], Column], again: bool) -> None:
        name = f"{number:012d}"
        if name in self._names("ends") or (not again and name in self._names("claims")):
            return
        self._claim(name, new, now)
        running = self.spark.read.schema(JOB).parquet(f"{self.folder}/claims/{name}")
        self._end(name, running, failure(handlers, hand_out(running, handlers)), now)

    def work(self, handlers: dict[str, Callable[[DataFrame], None]], now: Callable[[], Column] = F.current_timestamp, files: int = 1000, again: bool = True):
        """The writer of a stream that works jobs off as they are asked for: start it with the trigger that is wanted.

        A batch's jobs go to the handler of their type, a DataFrame for each type, that of the most urgent job first. A
        handler that raises fails its type's jobs of the batch; a type without a handler fails too. What a batch holds is
        bounded by files; a batch reads the ids of the log once, and shuffles none of them if its own ids are few enough to
        be broadcast. Urgent types go first within a batch, not before batches that are older. One stream works on a log; its
        checkpoint lies in the log's folder and belongs to it, as the batches are numbered by it.
        """
        new = self.spark.readStream.schema(JOB).option("maxFilesPerTrigger", files).parquet(self.asked)
        return new.writeStream.foreachBatch(lambda df, number: self._batch(df, number, handlers, now, again)).option("checkpointLocation", f"{self.folder}/checkpoint")

    def compact(self, now: Column, days: int = 7) -> None:
        """Fold all whole batches into a new base and drop jobs that ended some days ago.

        A dropped job leaves its id while the rows that asked for it are still there, so that it doesn't come back. The
        base is named by the last batch in it and written before older folders go: a crash in between costs space only.
        Call it between runs of the stream.
        """
        whole = self._names("ends")
        if not whole or self._names("base")[-1:] == whole[-1:]:
            return
        state = farthest(self._log(whole[-1])).filter(F.col("step") > self.ASKED)
        old = F.coalesce(F.col("status").isin("completed", "failed", "cancelled") & (F.col("completed_at") < now - F.expr(f"interval {days} days")), F.lit(False))
        state = state.withColumn("step", F.when(old, self.DROPPED).otherwise(F.col("step")))
        asked = self.spark.read.schema(JOB).parquet(self.asked).select("job_id").distinct().withColumn("_held", F.lit(True))
        kept = state.join(asked, "job_id", "left").filter((F.col("step") < self.DROPPED) | F.col("_held")).drop("_held")
        empty = [F.when(F.col("step") < self.DROPPED, F.col(c)).alias(c) if c in ("payload", "error") else F.col(c) for c in kept.columns]
        kept.select(*empty).write.mode("overwrite").parquet(f"{self.folder}/base/{whole[-1]}")
        store = self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind in ("base", "claims", "ends"):
            for n in self._names(kind):
                if n < whole[-1] or (n == whole[-1] and kind == "claims"):
                    store.delete(self._path(f"{self.folder}/{kind}/{n}"), True)


def expand(batches: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """The jobs of batch jobs (batch_id, files, exports, correlate: what to do): one for each of files (path) and exports (path), one correlation."""
    job = lambda df, kind, level, path: df.select("batch_id", F.lit(kind).alias("job_type"), F.lit(PRIORITIES[level]).alias("priority"), path.alias("path"))
    few = lambda flag: F.broadcast(batches.filter(flag).select("batch_id"))
    out = job(files.crossJoin(few("files")), "file_extraction", "exports", F.col("path")).union(job(exports.crossJoin(few("exports")), "fae_processing", "exports", F.col("path")))
    return out.union(job(batches.filter("correlate"), "correlation", "scheduled", F.lit(None).cast("string")))


def asked_by_events(events: DataFrame) -> DataFrame:
    """File events (kind, path, ...) that ask for a job: those created or modified that no exclusion keeps out; deletes and moves are seen and ignored."""
    name = F.substring_index("path", "/", -1)
    kept = events.filter(F.col("kind").isin("created", "modified") & S.included(F.col("path"), name, watcher=True))
    return kept.withColumn("job_type", F.when(S.export_trigger(name), "fae_processing").otherwise("file_extraction")).withColumn("priority", F.when(S.export_trigger(name), PRIORITIES["exports"]).otherwise(PRIORITIES["recent"]))


def field(text: str, least: int, most: int) -> list[int]:
    """The numbers of a field of a schedule: *, lists, ranges and steps."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        low, _, high = (least, "", most) if span == "*" else span.partition("-")
        out.update(range(int(low), int(high or (most if step and span != "*" and "-" not in span else low)) + 1, int(step or 1)))
    return sorted(out)


def due(time: Column, schedule: str) -> Column:
    """Whether a schedule of five fields (minute, hour, day, month, weekday from Sunday) names the minute of a time."""
    minute, hour, day, month, weekday = schedule.split()
    parts = [(F.minute(time), minute, 0, 59), (F.hour(time), hour, 0, 23), (F.month(time), month, 1, 12)]
    fits = [c.isin(field(f, a, b)) for c, f, a, b in parts]
    of_month, of_week = F.dayofmonth(time).isin(field(day, 1, 31)), (F.dayofweek(time) - 1).isin([w % 7 for w in field(weekday, 0, 7)])
    either = of_month | of_week if day != "*" and weekday != "*" else of_month & of_week
    return fits[0] & fits[1] & fits[2] & either
