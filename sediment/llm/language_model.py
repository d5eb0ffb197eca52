"""Language-model scores from a log-frequency Bloom filter of n-gram counts, beside exact unigram scores."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, discard, materialize, new_path, slices, table
from .dedup import C1, C2, Hashes, mix
from .warc import open_store

PRIOR = 0.1
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Of the filter: growth of a count per level, bits per inserted level, bits set in a word, and the size of the largest file of bigrams.
BASE, BITS, SET, MOST_BYTES = 1.5, 16, 5, 1 << 32
#: Weight of the unigram model in a bigram's probability, in counts.
STRENGTH = 20.0
#: Tokens whose exact counts are broadcast; the counts of rarer ones are joined.
HEAD = 1 << 18
#: Tokens that a task counts before it hands them on, text bytes whose n-grams share a shard, n-grams merged at once, and shards at most.
FLUSH, SHARD_BYTES, MERGE, MOST_SHARDS = 1 << 20, 1 << 23, 1 << 21, 1 << 16


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 10; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def tokens(text: bytes, hashes: Hashes) -> np.ndarray:
    """Hashes of the words of an ASCII-lower-cased text, then the end token."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def bigrams(t: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (history, token) for tokens of many texts in a row, 48 bits high in a word, and the histories; firsts are where texts begin."""
    history = np.empty_like(t)
    history[1:] = t[:-1]
    history[firsts] = START
    return mix(history * C1 + (t ^ C2)) >> np.uint64(16) << np.uint64(16), history


def packed(kind: int, keys: np.ndarray) -> np.ndarray:
    """Keys as rows of bytes: all eight of a token's, the six that a bigram's has."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2 * (kind - 1) :]


def unpacked(kind: int, data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 10 - 2 * kind)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 2 * (kind - 1) :] = rows
    return out.view("<u8").ravel()


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for none."""
    lo, hi = np.ceil(BASE ** (level - 1.0) - 1e-9), np.maximum(np.ceil(BASE ** (level + 0.0) - 1e-9) - 1, 1)
    return np.where(level > 0, (lo + hi) / 2, 0.0)


def place(key: np.ndarray, level: int, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits that stand for (key, level)."""
    h = mix(key + np.uint64(level * int(C1) & (1 << 64) - 1))
    g, one = mix(h ^ C2), np.uint64(1)
    mask = one << (g & np.uint64(63))
    for k in range(1, SET):
        mask |= one << ((g >> np.uint64(6 * k)) & np.uint64(63))
    return start + (h % size.astype(np.uint64)).astype(np.int64), mask


class Filter:
    """A log-frequency Bloom filter in shards by the key's high bits; a key's levels 1, 2, ... up to its count's are members."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts = words, starts

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The quantised counts, by probing level after level until one is missing."""
        shards = len(self.starts) - 1
        shard = (keys >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
        start, size = self.starts[shard], (self.starts[1:] - self.starts[:-1])[shard]
        level, live, at = np.zeros(len(keys), np.int64), np.flatnonzero(size > 0), 1
        while len(live):
            word, mask = place(keys[live], at, size[live], start[live])
            live = live[(self.words[word] & mask) == mask]
            level[live] = at
            at += 1
        return middle(level)


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of one shard."""
    level = levels_of(counts)
    words = np.zeros(-(-int(level.sum()) * BITS // 64), np.uint64)
    at, live = 1, np.arange(len(keys))
    while len(live):
        zero = np.zeros(len(live), np.int64)
        word, mask = place(keys[live], at, zero + len(words), zero)
        np.bitwise_or.at(words, word, mask)
        at += 1
        live = live[level[live] >= at]
    return words


def summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of (keys, counts) as one of different, sorted keys."""
    keys, counts = (np.concatenate([r[i] for r in runs]) if runs else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[firsts], np.add.reduceat(counts, firsts)


def count_ngrams(docs: DataFrame, shards: int, folder: str) -> DataFrame:
    """Rows h, c for each token, and a row shard, kind, path, words, mass for the filter of a shard's tokens (kind 1) and bigrams (2).

    A filter is a file of words in the shared folder; mass is the sum of its quantised counts. A task counts FLUSH
    tokens at a time and hands on packed runs; a shard's runs arrive in a row and are merged as they come, so a task
    holds the different n-grams of one shard and one kind at most.
    """
    shift = np.uint64(64 - shards.bit_length() + 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, n = Hashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            parts.clear()
            for kind in (1, 2):
                keys, c = np.unique(t if kind == 1 else bigrams(t, np.cumsum(sizes) - sizes)[0], return_counts=True)
                shard = (keys >> shift).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
                rows, cuts = np.unique(shard, return_index=True)
                cuts = np.append(cuts, len(keys))
                parts_of = [[x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for x in (packed(kind, keys), c.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(x, pa.binary()) for x in parts_of)], ["shard", "kind", "keys", "counts"])

        for b in batches:
            for text in b.column("text"):
                parts.append(tokens(text.as_buffer().to_pybytes(), hashes))
                n += len(parts[-1])
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if parts:
            yield from flush()

    def finish(shard: int, kind: int, runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(runs)
        words = build(keys, counts)
        path = f"{folder}/{kind}-{shard}-{uuid.uuid4().hex}"
        store, at = open_store(path)
        with store.open_output_stream(at, compression=None) as out:
            out.write(words)
        one = {"h": pa.nulls(1, pa.int64()), "c": pa.nulls(1, pa.int64()), "shard": pa.array([shard], pa.int32()), "kind": pa.array([kind], pa.int32()), "path": pa.array([path]), "words": pa.array([len(words)], pa.int64()), "mass": pa.array([float(middle(levels_of(counts)).sum())])}
        yield pa.RecordBatch.from_pydict(one)
        if kind == 1:
            n = len(keys)
            yield pa.RecordBatch.from_pydict({"h": pa.array(keys.astype(np.int64)), "c": pa.array(counts), **{k: pa.nulls(n, v.type) for k, v in one.items() if k not in "hc"}})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        own, runs, loose = None, [], 0
        for b in batches:
            for shard, kind, keys, counts in zip(*(b.column(c) for c in ("shard", "kind", "keys", "counts"))):
                now = shard.as_py(), kind.as_py()
                if own is not None and now != own:
                    yield from finish(*own, runs)
                    runs, loose = [], 0
                own = now
                runs.append((unpacked(now[1], keys.as_py()), np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)))
                loose += len(runs[-1][0])
                if loose > max(MERGE, 2 * len(runs[0][0])):
                    runs = [summed(runs)]
                    loose = len(runs[0][0])
        if own is not None:
            yield from finish(*own, runs)

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    runs = text.mapInArrow(gather, "shard int, kind int, keys binary, counts binary")
    return runs.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(merge, "h long, c long, shard int, kind int, path string, words long, mass double")


def one_file(spark: SparkSession, paths: list[str], name: str) -> str:
    """One file of the bytes of others in their order, written by a task that streams them, and sent to every executor once."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in b.column("paths").to_pylist():
                path = new + uuid.uuid4().hex
                store, at = open_store(path)
                with store.open_output_stream(at, compression=None) as out:
                    for p in parts:
                        store, at = open_store(p)
                        with store.open_input_stream(at, compression=None) as f:
                            while data := f.read(1 << 22):
                                out.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    new = new_path(spark, name)
    path = spark.createDataFrame([(paths,)], "paths array<string>").coalesce(1).mapInArrow(join, "path string").first()["path"]
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def mapped(name: str | None) -> np.ndarray:
    """The words of a file that one_file sent, shared by the workers of an executor and not copied."""
    return np.asarray(np.memmap(SparkFiles.get(name), np.uint64, "r")) if name else np.zeros(0, np.uint64)


def score(docs: DataFrame, head: int = HEAD, most_bytes: int = MOST_BYTES, strength: float = STRENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of docs (doc_id, text) under models of the documents that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row. A null or empty
    text is the end token alone. Repeated rows count and are scored each by itself. With no training document
    every token is unknown (and a score is 0: one token type, never seen). Other columns are ignored, whatever
    their names; an empty table gives no rows. A text of any length is tokenised whole, in the memory of its
    tokens' hashes (8 bytes each, several times over).

    Counting works on 64-bit hashes of tokens. base_score uses exact counts: those of the most frequent tokens
    (head at most) are broadcast, the rest are joined by token with the few tokens of each document that are rarer.
    score is the log10 probability of a bigram model, each bigram drawn to the unigram model by strength counts;
    all its counts are probed from log-frequency Bloom filters. These grow with the corpus, as files of the shared
    folder that Spark sends to each executor once (SparkContext.addFile) and whose workers map them, so they take
    no worker's memory and do not pass through the driver's. The filter of bigrams goes in runs of shards of
    most_bytes at most; if there are several, each scores the bigrams of its shards in a pass of its own, and a
    document's score is the sum. The unigram part is divided by the sum of the quantised counts, so it sums to 1
    over the vocabulary up to false positives of the filter; a history's bigrams need not, as quantised counts of
    bigrams and of their history are rounded apart from each other.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    trained, size = rows.filter("not held_out").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = 1 << (max(8, min(MOST_SHARDS, -(-size // shard_bytes))) - 1).bit_length()
    folder = new_path(spark, "shards")
    counted = materialize(count_ngrams(rows.filter("not held_out"), shards, folder), "ngrams")
    known = counted.filter("h is not null").select("h", "c")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, kept = 1, 0
    for c, n in known.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():  # different counts, not tokens
        kept += n
        if kept > head:
            least = c + 1
            break
    top = known.filter(F.col("c") >= least).toArrow()
    order = np.argsort(keys := top.column("h").to_numpy().astype(np.uint64))
    top_keys, top_counts = keys[order], top.column("c").to_numpy()[order]
    sizes, paths, mass = np.zeros((3, shards), np.int64), {}, 0.0
    for shard, kind, path, words, own in counted.filter("shard is not null").select("shard", "kind", "path", "words", "mass").toLocalIterator():
        sizes[kind, shard], paths[kind, shard] = words, path
        mass += own if kind == 1 else 0.0
    below, smooth = total + PRIOR * (distinct + 1), mass + PRIOR * (distinct + 1)

    def sent(kind: int, lo: int, hi: int) -> tuple[str | None, np.ndarray]:
        """The file of the words of shards lo to hi, and where each shard's begin; other shards have none."""
        some = [paths[kind, s] for s in range(lo, hi) if sizes[kind, s]]
        held = np.where((np.arange(shards) >= lo) & (np.arange(shards) < hi), sizes[kind], 0)
        return one_file(spark, some, "filter") if some else None, np.concatenate([[0], np.cumsum(held)])

    def measure_with(shared, lo: int, hi: int):
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two, top_keys, top_counts = shared.value
            singles, pairs, hashes = Filter(mapped(one[0]), one[1]), Filter(mapped(two[0]), two[1]), Hashes()
            for b in batches:
                for s in slices(b):
                    parts = [tokens(t.as_buffer().to_pybytes(), hashes) for t in s.column("text")]
                    n = np.array([len(p) for p in parts])
                    firsts, t = np.cumsum(n) - n, np.concatenate(parts)
                    u, back = np.unique(t, return_inverse=True)
                    at = np.minimum(np.searchsorted(top_keys, u), max(len(top_keys) - 1, 0))
                    exact = np.where(top_keys[at] == u, top_counts[at], 0) if len(top_keys) else np.zeros(len(u), np.int64)
                    in_head = (exact > 0)[back]
                    base = np.add.reduceat(np.where(in_head, np.log10((exact + PRIOR) / below)[back], 0.0), firsts)
                    key, _ = bigrams(t, firsts)
                    different, key_back = np.unique(key, return_inverse=True)
                    mine = (different >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)
                    mine = ((mine >= lo) & (mine < hi))[key_back]
                    both, single = pairs.counts(different)[key_back], singles.counts(u)
                    before = np.append(0.0, single[back][:-1])
                    before[firsts] = float(trained)
                    p1 = (single + PRIOR)[back] / smooth
                    p = (np.minimum(both, before) + strength * p1) / (before + strength)
                    rare = np.flatnonzero(~in_head)
                    cut = np.searchsorted(rare, np.append(firsts, len(t))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(t[rare].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([s.column("rid"), s.column("doc_id"), s.column("held_out"), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat(in_head.astype(np.int64), firsts)), pa.array(base), pa.array(np.add.reduceat(np.where(mine, np.log10(p), 0.0), firsts)), lists], ["rid", "doc_id", "held_out", "n_tokens", "head_known", "head_score", "score", "rare"])

        return measure

    runs, lo = [], 0
    for hi in range(1, shards + 1):
        if hi == shards or 8 * sizes[2, lo : hi + 1].sum() > most_bytes:
            runs.append((lo, hi))
            lo = hi
    tokens_filter, out = sent(1, 0, shards), None
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    if len(runs) > 1:
        # Passes are joined by these numbers, so they are given once.
        numbered = materialize(numbered, "numbered")
    for lo, hi in runs:
        shared = spark.sparkContext.broadcast((tokens_filter, sent(2, lo, hi), top_keys, top_counts))
        if hi == shards:
            delete(spark, folder)
        scored = numbered.mapInArrow(measure_with(shared, lo, hi), "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, score double, rare array<long>")
        scored = materialize(scored, "scored")
        shared.destroy()
        out = scored if out is None else materialize(out.join(scored.select("rid", F.col("score").alias("more")), "rid").withColumn("score", F.col("score") + F.col("more")).drop("more"), "scored")
    discard(numbered)
    rare = out.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("tf"))
    found = rare.join(known.filter(F.col("c") < least), "h", "left")
    c = F.coalesce("c", F.lit(0))
    found = found.groupBy("rid").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * F.log10((c + PRIOR) / below)).alias("rare_score"))
    out = out.join(materialize(found, "rare"), "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
