"""Streams of file events: leading-edge debounce, rates, sessions, de-duplication, and an upsert sink.

Event times drive everything; what comes later than the watermark is dropped by Spark and counted in its progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs_of(keys: pa.Array, *more: pa.Array) -> np.ndarray:
    """Where a new combination of values starts in columns of sorted rows, then the number of rows."""
    cut = np.zeros(max(len(keys) - 1, 0), bool)
    for c in (keys, *more):
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut |= code[1:] != code[:-1]
    return np.concatenate([[0], np.flatnonzero(cut) + 1, [len(keys)]])


def next_allowed(run: np.ndarray, times: np.ndarray, gap: int) -> np.ndarray:
    """For each event of sorted runs the place of the first one of its run that comes gap or more later, or their number."""
    n = len(times)
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate([times, times + gap]), np.concatenate([run, run])))
    is_event, out = order < n, np.empty(n, np.int64)
    out[order[~is_event] - n] = np.cumsum(is_event)[~is_event]
    return np.where((out < n) & (run[np.minimum(out, n - 1)] == run), out, n)


def ways_out(run: np.ndarray, times: np.ndarray, start: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stretches (runs of sorted times from their start on) make of any clock that enters them: run, end, exit.

    A clock that accepts nothing before some time less than start + gap leaves with the exit of the run's first end that
    isn't before that time; where there is none, nothing of the stretch is accepted. Entries that leave alike are one
    row, as later entries never leave earlier.
    """
    new = np.append(True, run[1:] != run[:-1])
    first = np.flatnonzero(new | (np.append(0, times[:-1]) < start + gap))
    ahead, at = np.append(next_allowed(run, times, gap), len(times)), first.copy()
    while (live := (then := ahead[at]) < len(times)).any():
        at[live] = then[live]
    last = np.append((run[first][1:] != run[first][:-1]) | (at[1:] != at[:-1]), True)
    return run[first[last]], times[first[last]], times[at[last]]


def debounce_batch(events: DataFrame, key: str, time: str, gap: float = 2.0, stretch: int = 256) -> DataFrame:
    """Events of each key that come gap seconds or more after the last accepted one; rejected ones don't reset the clock.

    Ties in time are one event for the clock: the first is accepted. Null times are left out, a null key is a key; a gap
    of 0 accepts all.

    No key is one task's work: its time is cut into stretches of some gaps each. A first pass says what each stretch makes
    of any clock that enters it (only entries in its first gap can differ, so this is about a stretch-th of the rows), a
    second one goes through these per key, a third lets each stretch begin with its clock. A task holds the times of one
    stretch, eight bytes each, in the first pass; in the others one Arrow batch.
    """
    kind, step = dict(events.dtypes)[key], int(gap * 1_000_000)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.filter(F.col(time).isNotNull()).select(F.struct(F.col(key).alias("key")).alias("_k"), t.alias("_t"))
    if step <= 0:
        return rows.select(F.col("_k.key").alias(key), F.timestamp_micros("_t").alias("accepted_at"))
    rows = rows.withColumn("_b", F.col("_t") - F.pmod("_t", F.lit(stretch * step))).repartition("_k", "_b")
    k_type = f"_k struct<key: {kind}>"

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        return runs_of(batch.column("_k").field(0), batch.column("_b"))

    def name(batch: pa.RecordBatch, i: int) -> tuple:
        return batch.column("_k")[i].as_py(), batch.column("_b")[i].as_py()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the stretch that the next batch may go on with

        def summed(batch: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
            which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            own, ends, exits = ways_out(which, batch.column("_t").to_numpy(), batch.column("_b").to_numpy(), step)
            offsets = pa.array(np.searchsorted(own, np.arange(len(cuts))).astype(np.int32))
            at = pa.array(cuts[:-1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ends, exits)]
            return pa.RecordBatch.from_arrays([batch.column("_k").take(at), batch.column("_b").take(at), *lists], ["_k", "_b", "_ends", "_exits"])

        for batch in (b for b in batches if b.num_rows):
            if held and name(held[0], 0) == name(batch, batch.num_rows - 1):
                held.append(batch)
                continue
            both = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            cuts = runs(both)
            if len(cuts) > 2:
                yield summed(both.slice(0, int(cuts[-2])), cuts[:-1])
            held = [both.slice(int(cuts[-2]))]
        if held:
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield summed(both, np.array([0, both.num_rows]))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = (), None
        for batch in (b for b in batches if b.num_rows):
            keys, out = batch.column("_k"), []
            cuts = set(runs_of(keys.field(0))[:-1].tolist())
            if keys[0].as_py() == own:
                cuts.discard(0)
            for i in range(len(keys)):
                if i in cuts:
                    last = None
                out.append(last)
                ends, exits = batch.column("_ends")[i].values.to_numpy(), batch.column("_exits")[i].values.to_numpy()
                at = 0 if last is None else int(np.searchsorted(ends, last + step))
                # Without a clock the first event is accepted, which is the first entry.
                last = int(exits[at]) if at < len(ends) else last
            own = keys[len(keys) - 1].as_py()
            yield pa.RecordBatch.from_arrays([keys, batch.column("_b"), pa.array(out, pa.int64())], ["_k", "_b", "_last"])

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in (b for b in batches if b.num_rows):
            times, cuts = batch.column("_t").to_numpy(), runs(batch)
            lasts = batch.column("_last").take(pa.array(cuts[:-1])).to_pylist()
            if name(batch, 0) == own:
                lasts[0] = last
            begin = [i if x is None else i + int(np.searchsorted(times[i:j], x + step)) for i, j, x in zip(cuts[:-1], cuts[1:], lasts)]
            at, kept = np.array(begin)[np.array(begin) < cuts[1:]], []
            ahead = next_allowed(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), times, step)
            while len(at):
                kept.append(at)
                at = ahead[at]
                at = at[at < len(times)]
            kept = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
            own, last = name(batch, batch.num_rows - 1), int(times[kept[-1]]) if len(kept) and kept[-1] >= cuts[-2] else lasts[-1]
            kept = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(kept), batch.column("_t").take(kept)], ["_k", "_t"])

    sums = rows.sortWithinPartitions("_k", "_b", "_t").mapInArrow(summarise, f"{k_type}, _b long, _ends array<long>, _exits array<long>")
    clocks = sums.repartition("_k").sortWithinPartitions("_k", "_b").mapInArrow(enter, f"{k_type}, _b long, _last long")
    entered = rows.join(clocks, ["_k", "_b"]).select("_k", "_b", "_last", "_t").sortWithinPartitions("_k", "_b", "_t")
    return entered.mapInArrow(accept, f"{k_type}, _t long").select(F.col("_k.key").alias(key), F.timestamp_micros("_t").alias("accepted_at"))


def debounce(events: DataFrame, key: str, time: str, gap: float = 2.0, lateness: str = "10 minutes") -> DataFrame:
    """The same on a stream: per key the last accepted time, dropped after twice the gap."""

    def accept(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for b in batches for x in b[time]):
            s = t.timestamp()
            if last is None or s - last >= gap:
                last = s
                out.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + 2 * gap) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "accepted_at": out})

    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(time, lateness).groupBy(key)
    return rows.applyInPandasWithState(accept, f"{key} {kind}, accepted_at timestamp", "last double", "append", "EventTimeTimeout")


def rates(events: DataFrame, time: str, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows of event time."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, columns: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(columns)


def latest(old: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, the latest version of each key; of equal versions (or without one) the new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = ([F.desc(version)] if version else []) + [F.desc("_new")]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n", "_new")
