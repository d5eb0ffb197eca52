"""Fill-in-the-middle: texts cut at two unit boundaries, found by a sparse index of checkpoints, and put together anew."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

# What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Units between two checkpoints, and bytes that are counted at a time.
EVERY, BLOCK = 256, 1 << 16

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
INNER = np.zeros(256, bool)  # bytes of a code point after its first
INNER[128:192] = True

ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_starts(block: np.ndarray, in_word: bool) -> np.ndarray:
    """Where units begin in a block of UTF-8: runs of A-Z and a-z, and each other code point; in_word: a letter stands before it."""
    letter = LETTER[block]
    before = np.empty_like(letter)
    before[:1], before[1:] = in_word, letter[:-1]
    return np.flatnonzero(np.where(letter, ~before, ~INNER[block]))


class Checkpoints:
    """The number of units of a text, and the byte and code-point offsets of every EVERY-th one."""

    def __init__(self, data: bytes, every: int = EVERY, block: int = BLOCK):
        self.data, self.n, self.chars = np.frombuffer(data, np.uint8), 0, 0
        self.units: list[int] = []
        self.offsets: list[tuple[int, int]] = []
        for at in range(0, len(data), block):
            part = self.data[at : at + block]
            starts = unit_starts(part, at > 0 and bool(LETTER[self.data[at - 1]]))
            kept = starts[-self.n % every :: every]
            if len(kept):
                inner = np.cumsum(INNER[part])
                self.units += range(self.n + -self.n % every, self.n + len(starts), every)
                self.offsets += [(at + int(k), self.chars + int(k - inner[k])) for k in kept]
            self.n += len(starts)
            self.chars += len(part) - int(INNER[part].sum())

    def locate(self, unit: int, block: int = 1 << 12) -> tuple[int, int]:
        """The byte and code-point offset where a unit begins (unit n: where the text ends): the last checkpoint before it, and a short scan from there."""
        if unit >= self.n:
            return len(self.data), self.chars
        k = bisect_right(self.units, unit) - 1
        (at, chars), left = self.offsets[k], unit - self.units[k]
        in_word = False  # a checkpoint begins a unit
        while True:
            part = self.data[at : at + block]
            starts = unit_starts(part, in_word)
            if left < len(starts):
                end = int(starts[left])
                return at + end, chars + end - int(INNER[part[:end]].sum())
            left -= len(starts)
            chars += len(part) - int(INNER[part].sum())
            in_word, at = bool(LETTER[part[-1]]), at + len(part)


def parts_of(data: bytes, draws: tuple[int, int, int, int], plain_from: int, spm_below: int, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output, for a text and its four draws."""
    points = Checkpoints(data, every)
    if not data or draws[2] % 100 >= plain_from or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return points.n, "plain", None, None, data
    first, second = sorted(h % (points.n + 1) for h in draws[:2])
    (a, chars_a), (b, chars_b) = points.locate(first), points.locate(second)
    prefix, middle, suffix = PREFIX.encode() + data[:a], MIDDLE.encode() + data[a:b], SUFFIX.encode() + data[b:]
    form = "spm" if draws[3] % 100 < spm_below else "psm"
    return points.n, form, chars_a, chars_b - chars_a, (suffix + prefix if form == "spm" else prefix + suffix) + middle


def transform(docs: DataFrame, seed: str = "1:", plain_from: int = 90, spm_below: int = 20, every: int = EVERY) -> DataFrame:
    """docs (with doc_id and text) and n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Cuts and form follow from the SHA-256 of seed and doc_id, so equal rows have equal results and a lost task
    gives the same ones again. A null text is empty, and plain, as are texts that hold a mark of their own and the
    share from plain_from of a hundred. A null doc_id counts as no digits. A text of any length is cut whole: one
    pass counts its units in blocks and keeps a checkpoint for every EVERY units, so the index is small beside it.
    Columns of docs stay as they are; columns named as the five added ones are taken over. No rows give no rows.
    """
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    rest = docs.drop(*ADDED)
    names = rest.columns
    rows = rest.withColumn("_draws", draws).withColumn("_text", F.coalesce("text", F.lit("")).cast("binary"))
    schema = T.StructType([*rest.schema.fields, *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text"):
                made = [parts_of(x.as_py(), tuple(d.as_py()), plain_from, spm_below, every) for x, d in zip(b.column("_text"), b.column("_draws"))]
                new = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *new[:4], new[4].cast(pa.string())], [*names, *ADDED])

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. A mark stands in the output once, as texts that hold one are plain."""
    from_mark = lambda mark, to: F.split_part(F.split_part(output, F.lit(mark), F.lit(2)), F.lit(to), F.lit(1))
    last = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(from_mark(PREFIX, SUFFIX), last, from_mark(SUFFIX, MIDDLE))
    spm = F.concat(from_mark(PREFIX, MIDDLE), last, from_mark(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
