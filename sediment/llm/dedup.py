"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, components, discard, materialize, slices, table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8
#: Bits of the sketch that lets only texts with a candidate through; texts it lets through for nothing cost time only.
SKETCH = 1 << 26
#: Members of a bucket in a block, and how far below the similarity a pair's agreeing registers may stay.
BLOCK, MARGIN = 256, 0.08
#: Lower-cases A-Z and turns other ASCII than digits and letters into spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of size words; of all words where they are fewer; none without words."""
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * C1 + w[i : len(w) - n + 1 + i]
    return mix(h)


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures of many documents at once: (docs, m) elements, 0 where a document has none.

    Each element of a document sends arrivals of a Poisson process whose rate is its weight; an arrival falls
    into one of m registers, and a register keeps the element of its first arrival. An element stops when its
    next arrival is later than the last register's. Two documents agree in a register with the probability
    Jaccard similarity of their weights.
    """
    first, kept = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    alone = np.bincount(doc, minlength=docs)[doc] == 1
    kept.reshape(docs, m)[doc[alone]] = element[alone][:, None]  # an only element gets every register
    doc, element, weight = doc[~alone], element[~alone], weight[~alone]
    state, time = element.copy(), np.zeros(len(element))
    while len(element):
        state = state + C1
        r = mix(state)
        time = time - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        at = doc * m + (mix(r ^ C3) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(time < first[at])
        where, when = at[early], time[early]
        np.minimum.at(first, where, when)
        won = first[where] == when
        kept[where[won]] = element[early[won]]
        live = np.flatnonzero(time < first.reshape(docs, m).max(axis=1)[doc])
        doc, element, weight, state, time = doc[live], element[live], weight[live], state[live], time[live]
    return kept.reshape(docs, m)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, key (MD5 of the text), n (different shingles), the hash of each band (none without shingles), and a byte of each register.

    All shingles weigh the same, so that two texts agree in a register with the probability Jaccard similarity
    of their sets, which is what links are verified by.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for s in slices(b):
                owner, elements, n = [], [], np.zeros(s.num_rows, np.int32)
                for j, text in enumerate(s.column("text")):
                    e = np.unique(shingles(text.as_buffer().to_pybytes(), hashes, size))
                    n[j] = len(e)
                    owner.append(np.full(len(e), j, np.int64))
                    elements.append(e)
                elements = np.concatenate(elements)
                sig = prob_minhash(np.concatenate(owner), elements, np.ones(len(elements)), s.num_rows, bands * rows).reshape(-1, bands, rows)
                short = sig.reshape(s.num_rows, -1).astype(np.uint8)
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
                for r in range(rows):
                    h = mix(h * C1 + sig[:, :, r])
                h = h.astype(np.int64)
                out = pa.array([x if k else x[:0] for x, k in zip(h, n)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("key"), pa.array(n), out, pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "key", "n", "bands", "sig"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.md5(text).alias("key"), text.alias("text")).mapInArrow(sign, "doc_id long, key string, n int, bands array<long>, sig binary")


def packed(elements: np.ndarray) -> bytes:
    """A set of hashes, sorted, by the upper six bytes of each: what shuffles carry."""
    return np.unique(elements >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: pa.Scalar) -> np.ndarray:
    bytes_ = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(bytes_), 8), np.uint8)
    out[:, :6] = bytes_
    return out.view("<u8").ravel()


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v) those whose shingle sets have a Jaccard similarity of least or more; each u is marked as a centre in sets."""
    left = sets.filter("centre").select(F.col("gid").alias("u"), F.col("set").alias("set_u"))
    right = sets.select(F.col("gid").alias("v"), F.col("set").alias("set_v"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_u"), b.column("set_v")):
                keep.append(jaccard_reaches(unpacked(x), unpacked(y), least))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(k := pa.array(keep, pa.bool_())), b.column("v").filter(k)], ["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v").mapInArrow(verify, "u long, v long")


def links_across(members: DataFrame, groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between members (bucket, gid, n, component, blocks) of one bucket and different components.

    Members of a bucket meet in cells of two blocks. There, sizes and signatures leave the pairs that may reach
    least, each in the first bucket that both share; they stay packed, as a list of partners with each member.
    The members that have any then meet once more with their shingle sets. Of the links found in a cell those
    that join more of it are returned: rows follow the members of a bucket, not its pairs.
    """
    own = F.pmod(F.xxhash64("gid", "bucket"), F.col("blocks")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("gid", "n", "component", "own", "bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") == F.col("other")).alias("inner"))
    placed = materialize(cells, "cells")
    cells = placed.join(groups.select("gid", "sig", "bands"), "gid")
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def promising(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            return
        gid, n, part, own = (t.column(c).to_numpy() for c in ("gid", "n", "component", "own"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(gid), -1)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(gid), -1)
        inner, bucket = t.column("inner")[0].as_py(), t.column("bucket")[0].as_py()
        left = np.arange(len(gid)) if inner else np.flatnonzero(own == own.min())
        right = left if inner else np.flatnonzero(own != own.min())
        partners: dict[int, np.ndarray] = {}
        for i in left.tolist():
            near = right[(part[right] != part[i]) & (np.minimum(n[right], n[i]) >= least * np.maximum(n[right], n[i]))]
            if inner:
                near = near[near > i]
            if len(near):
                near = near[(sig[near] == sig[i]).mean(axis=1) >= least - MARGIN]
                near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == bucket] if len(near) else near
            if len(near):
                partners[i] = gid[near]
                for j in near.tolist():
                    partners.setdefault(j, gid[:0])
        if partners:
            at = np.array(sorted(partners))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t.column("cell")[0].as_py())), pa.array(gid[at]), pa.array([partners[i] for i in at.tolist()], pa.list_(pa.int64()))], ["cell", "gid", "partners"])

    def verify(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        gid = t.column("gid").to_pylist()
        own = {g: unpacked(x) for g, x in zip(gid, t.column("set"))}
        root, found = {g: g for g in gid}, []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for g, others in zip(gid, t.column("partners").to_pylist()):
            for o in others:
                if top(g) != top(o) and jaccard_reaches(own[g], own[o], least):
                    root[top(g)] = top(o)
                    found.append((g, o))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    meet = lambda rows, work, schema: rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(by_key("cell", work), schema)
    partners = materialize(meet(cells, promising, "cell long, gid long, partners array<long>"), "partners")
    discard(placed)
    return meet(partners.join(sets, "gid"), verify, "u long, v long")


def jaccard_reaches(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of least or more."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both >= least * (len(x) + len(y) - both)


def position(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SKETCH)) + 1


def sketch_of(at: DataFrame) -> DataFrame:
    """_block, _bits: which of SKETCH positions (at, from 1) are taken; SKETCH / 8 bytes at most."""
    return at.groupBy(F.bitmap_bucket_number("at").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))


def broadcast_sketch(at: DataFrame):
    """sketch_of as bytes in a broadcast."""
    sketch = np.zeros(SKETCH // 8, np.uint8)
    for r in sketch_of(at).toLocalIterator():
        sketch[(r["_block"] - 1) * 4096 : r["_block"] * 4096] = np.frombuffer(r["_bits"], np.uint8)
    return at.sparkSession.sparkContext.broadcast(sketch)


def shared_bands(groups: DataFrame) -> DataFrame:
    """gid, n, bucket for the bands of groups (gid, n, bands) that several texts may have: all such, and few others.

    A count by bucket tells which are shared; a sketch of these (broadcast) then keeps a text's other bands
    out of every later shuffle.
    """
    buckets = groups.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    shared = broadcast_sketch(buckets.select((F.col("bucket").bitwiseAND(F.lit(SKETCH - 1)) + 1).alias("at")))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            bands = b.column("bands")
            flat = bands.flatten().to_numpy()
            at, owner = flat & (SKETCH - 1), np.repeat(np.arange(b.num_rows), np.diff(bands.offsets.to_numpy()))
            hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            take = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([b.column("gid").take(take), b.column("n").take(take), pa.array(flat[hit])], ["gid", "n", "bucket"])

    return groups.select("gid", "n", "bands").mapInArrow(hits, "gid long, n int, bucket long")


def sets_of(docs: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """gid, centre, set (packed) for the texts of ends (gid, key, centre). Only their sets are shuffled, no text is."""
    shared = broadcast_sketch(ends.select(position(F.col("key")).alias("at")))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), shared.value
        for b in batches:
            at = b.column("at").to_numpy() - 1
            hit = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
            for s in slices(b.filter(pa.array(hit.astype(bool)))):
                out = [packed(shingles(t.as_buffer().to_pybytes(), hashes, size)) for t in s.column("text")]
                yield pa.RecordBatch.from_arrays([s.column("key"), pa.array(out, pa.binary())], ["key", "set"])

    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.md5(text).alias("key"), text.alias("text")).select("key", position(F.col("key")).alias("at"), "text").mapInArrow(shingle, "key string, set binary")
    return found.groupBy("key").agg(F.first("set").alias("set")).join(ends, "key").select("gid", "centre", "set")


def classes(docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text): doc_id, key, class_id, kept.

    Two texts link if the sets of their five-word shingles (lower-cased words of letters, digits and
    non-ASCII characters) have a Jaccard similarity of least or more; classes are the connected components,
    class_id the smallest doc_id of one, kept (doc_id = class_id). A text of one to four words has one
    shingle, all its words. Texts without words link with equal texts only. A null text is empty; empty
    texts are copies of each other. Repeated rows are copies; rows that repeat a whole class's smallest
    doc_id are all kept. A null doc_id is larger than any other; a class of only such rows has a null class_id and is kept.
    Other columns are ignored.

    Equal texts become one row first. Candidates share a band of a ProbMinHash signature (shingles weigh
    the same, however often they occur). Every bucket first compares its members with one of them, so that a bucket of n
    copies costs n comparisons and not n*n. Pairs of a bucket that are then still in different classes meet in
    cells of bounded size, where signatures tell apart those that may reach least; these are all compared.
    """
    spark = docs.sparkSession
    signed = materialize(signatures(docs, size=size), "signed")
    groups = signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "texts")
    rows = materialize(shared_bands(groups), "bands")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("gid", "n")).alias("m")).filter("c > 1")
    buckets = materialize(buckets.select("bucket", F.col("m.gid").alias("u"), F.col("m.n").alias("nu")), "buckets")
    members = materialize(rows.join(buckets, "bucket"), "members")
    discard(rows, buckets)
    ratio = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(least)

    pairs = materialize(members.filter(F.col("gid") != F.col("u")).filter(ratio(F.col("n"), F.col("nu"))).select("u", F.col("gid").alias("v")).distinct(), "pairs")
    ends = members.select("gid", F.lit(False).alias("centre")).union(pairs.select("u", F.lit(True))).groupBy("gid").agg(F.max("centre").alias("centre"))
    ends = materialize(ends.join(groups.select("gid", "key"), "gid"), "ends")
    sets = materialize(sets_of(docs, ends, size), "sets")
    edges = materialize(similar(pairs, sets, least), "edges")
    labels = components(edges)
    named = members.select("bucket", "gid", "n").join(labels.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    named = materialize(named, "named")
    discard(members, pairs, ends)
    open_ = named.groupBy("bucket").agg(F.count("*").alias("c"), F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket", "c")
    still = named.join(open_ := materialize(open_, "open"), "bucket").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    more = materialize(links_across(still := materialize(still, "open"), groups, sets, least), "edges")
    discard(named, open_, still, sets)
    if not more.isEmpty():
        discard(labels)
        labels = components(edges.union(more))
    per_text = groups.select("key", "gid", "least_id").join(labels.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    per_text = materialize(per_text, "labels")
    smallest = materialize(per_text.groupBy("component").agg(F.min("least_id").alias("class_id")), "classes")
    named = materialize(per_text.join(smallest, "component").select("key", "class_id"), "named")
    discard(groups, labels, edges, more, per_text, smallest)
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text and any others) with one row of each near-duplicate class: the one with the smallest doc_id.

    Rows equal in doc_id and text count as one row, of which one stays. A sketch of bounded size (broadcast)
    tells which rows may have to go; only these are shuffled with their texts.
    """
    found = materialize(classes(docs, least, size), "classes")
    gone = found.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    gone = materialize(gone, "gone")
    key = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("_doc_key", key).withColumn("_at", position(F.col("_doc_key")))
    rows = rows.join(F.broadcast(sketch_of(gone.select(position(F.col("_key")).alias("at")))), F.bitmap_bucket_number("_at") == F.col("_block"), "left")
    byte, bit = F.floor(F.bitmap_bit_position("_at") / 8).cast("int"), (F.bitmap_bit_position("_at") % 8).cast("int")
    hit = F.coalesce(F.getbit(F.conv(F.hex(F.substring("_bits", byte + 1, F.lit(1))), 16, 10).cast("int"), bit) == 1, F.lit(False))
    rows = rows.withColumn("_hit", hit)
    held = rows.filter("_hit").join(gone, (F.col("_doc_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    left = rows.filter("not _hit").select(*docs.columns).unionByName(held.select(*docs.columns))
    again = found.filter("kept").groupBy("class_id").count().filter("count > 1")
    return left if again.isEmpty() else left.withColumn("_key", key).dropDuplicates(["doc_id", "_key"]).drop("_key")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
