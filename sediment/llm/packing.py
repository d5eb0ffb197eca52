"""Best-fit packing of token sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 12  x\n\n<|endoftext|> \u00c9t\u00e9, \u4f60\u597d \t\u0000 don't  "
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids, for a byte-level BPE file of the tokenizers library.

    Where ids are ranks of merges, as in this vocabulary, the file's own vocabulary is run by a faster engine;
    a probe of both is compared on loading, and the library itself encodes where they differ.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, signs = {x["content"]: x["id"] for x in spec["added_tokens"]}, byte_signs()
        ranks = {bytes(signs[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in special}
        engine = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        fast = lambda text: engine.encode_to_numpy(text, allowed_special="all")
        return fast if np.array_equal(fast(PROBE), slow(PROBE)) else slow
    except (ImportError, KeyError, ValueError):
        return slow


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """load, once in each Python worker and not for each task."""
    kept = sys.modules.setdefault("_sediment_worker", types.ModuleType("_sediment_worker")).__dict__
    if path not in kept:
        kept[path] = load(path)
    return kept[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, but for the first, which has the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """The pieces of each document's ids and end token; nth counts pieces of a length within the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen, kinds = np.zeros(capacity + 1, np.int64), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(encode_text(text.as_py()), END).astype("<u4")
                for k, (start, n) in enumerate(cut_points(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n]), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Bins for counts of pieces by length: (number of equal bins, [(length, items per bin, offset), ...]).

    Pieces above a third of the capacity go two to a bin at most: from the longest down, each takes the
    longest other that fits. Smaller pieces then go, longest first, to the bin with the tightest gap, and
    to new bins when no gap is left. Equal bins and equal pieces move together, so the work follows the
    number of different lengths and not the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    third = capacity / 3
    gaps: dict[int, list[list]] = {}  # gap -> groups [number, placements]

    def put(number: int, placed: list, gap: int) -> None:
        gaps.setdefault(gap, []).append([number, placed])

    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m <= capacity - n and left[m] - (m == n) > 0), None)
            if mate is None:
                put(left[n], [(n, 1, 0)], capacity - n)
                left[n] = 0
            elif mate == n:
                put(left[n] // 2, [(n, 2, 0)], capacity - 2 * n)
                left[n] %= 2
            else:
                t = min(left[n], left[mate])
                put(t, [(n, 1, 0), (mate, 1, n)], capacity - n - mate)
                left[n] -= t
                left[mate] -= t
    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                gap, number, placed = capacity, left[n], []
            else:
                number, placed = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            each = min(gap // n, left[n])
            bins = min(number, left[n] // each)
            put(bins, [*placed, (n, each, capacity - gap)], gap - each * n)
            left[n] -= bins * each
            if bins < number and placed:
                put(number - bins, placed, gap)
    return [(number, placed) for g in sorted(gaps) for number, placed in gaps[g]]


def segments(bins: list[tuple[int, list[tuple[int, int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first item, first bin, items per bin, offset) in the order of items."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    at = 0
    for number, placed in bins:
        for n, each, offset in placed:
            rows.setdefault(n, []).append((taken.get(n, 0), at, each, offset))
            taken[n] = taken.get(n, 0) + number * each
        at += number
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most capacity tokens; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty: its
    document is the end token alone. Rows that repeat a document, or have no doc_id, are documents of
    their own. Other columns are ignored. No rows give no rows.

    Only the counts by length (at most capacity numbers) reach the driver, and only the plan, whose size
    follows the number of lengths too, goes back. A piece finds its place by its number among those of its
    length: its number within its task plus the running sum of the counts of earlier tasks.
    """
    pieces = materialize(tokenized_pieces(docs, capacity, vocabulary or default_vocabulary()), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per_part = materialize(per_part.withColumn("before", F.coalesce(before, F.lit(0))), "counts")
    counts = {r["length"]: r["c"] for r in per_part.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    where = segments(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, item = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows, s = np.flatnonzero(length == n), where[int(n)]
                hit = s[np.searchsorted(s[:, 0], item[rows], "right") - 1]
                j = item[rows] - hit[:, 0]
                seq[rows], off[rows] = hit[:, 1] + j // hit[:, 2], hit[:, 3] + j % hit[:, 2] * n
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = pieces.join(per_part.drop("c"), ["part", "length"])
    return joined.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
