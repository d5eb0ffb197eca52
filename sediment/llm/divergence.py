"""How the sources of a language differ in their terms: sorted runs, scanned twice, exact in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, slices, table

#: What probabilities are scaled by, documents that a kept term has at least, and ranks of terms that are returned.
SCALE, LEAST_DOCS, MOST_TERMS = 1_000_000_000, 3, 200
#: Bytes of text that are sorted at once, and pairs of sources that are computed at once.
BLOCK_BYTES, BLOCK_PAIRS = 1 << 23, 1 << 18

#: Bytes of terms are letters, A-Z lower-cased, and all that isn't ASCII; others part terms.
TERM_BYTES = bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

RUN = "lang string, term string, source string, block long, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, first boolean"
PAIR = "lang string, source string, other string, plus long, minus long"


def block_runs(texts: list[bytes], keys: list[tuple[str, str]], block: int) -> pa.RecordBatch:
    """The runs of a block of documents: its tokens sorted by (lang, term, source, document) and scanned for each
    run's documents and tokens. Each group has a run of the empty term too, so that one without terms isn't lost."""
    named = sorted(set(keys))
    number = {k: i for i, k in enumerate(named)}
    group = np.array([number[k] for k in keys])
    by_group = np.argsort(group, kind="stable")  # documents in the order of their (lang, source)
    rank = np.empty_like(by_group)
    rank[by_group] = np.arange(len(keys))
    langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in named}))}
    lang_of = np.array([langs[lang] for lang, _ in keys])

    ids: dict[bytes, int] = {}
    split = [x.translate(TERM_BYTES).split() for x in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    tokens = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    most = max(1, len(ids))
    order = (np.repeat(lang_of * most, sizes) + tokens) * len(keys) + np.repeat(rank, sizes)
    order.sort()
    spelt, doc = np.divmod(order, len(keys))
    g = group[by_group[doc]]
    new_run = np.ones(len(order), bool)
    new_run[1:] = (spelt[1:] != spelt[:-1]) | (g[1:] != g[:-1])
    new_doc = new_run.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new_run)
    docs = np.add.reduceat(new_doc, first, dtype=np.int64) if len(first) else first
    counts = np.diff(np.append(first, len(order)))

    every = np.arange(len(named))
    zero = np.zeros(len(named), np.int64)
    words = pa.array([*ids, b""], pa.binary()).cast(pa.string()).take(pa.array(np.append(spelt[first] % most, zero + len(ids))))
    of = [pa.array([k[j] for k in named], pa.string()).take(pa.array(np.append(g[first], every))) for j in (0, 1)]
    rest = [pa.array(np.append(x, zero)) for x in (docs, counts)]
    return pa.RecordBatch.from_arrays([of[0], words, of[1], pa.array(np.full(len(words), block)), *rest], ["lang", "term", "source", "block", "docs", "n"])


def runs_of_blocks(docs: DataFrame) -> DataFrame:
    """The runs of docs (text, lang, source; none null) by blocks of about BLOCK_BYTES: what is shuffled in place of tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        keys: list[tuple[str, str]] = []
        held, block = 0, 0
        for batch in batches:
            for b in slices(batch):
                texts += b.column("text").to_pylist()
                keys += zip(b.column("lang").to_pylist(), b.column("source").to_pylist())
                held += b.column("text").nbytes
                if held >= BLOCK_BYTES:
                    yield block_runs(texts, keys, block)
                    texts, keys, held, block = [], [], 0, block + 1
        if texts:
            yield block_runs(texts, keys, block)

    return docs.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(scan, RUN)


def changes(t: pa.Table, *columns: str) -> np.ndarray:
    """Where rows begin that differ from the one before in some column."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = t.column(c)
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], merge) -> Iterator[pa.Table]:
    """Tables of whole (lang, term) runs from sorted batches; merge shortens what is held of an unfinished run."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = merge(t if held is None else pa.concat_tables([held, t]).combine_chunks())
        last = int(changes(t, "lang", "term")[-1])
        if last:
            yield t.slice(0, last)
        held = t.slice(last)
    if held is not None:
        yield held


def kept_runs(runs: DataFrame, least_docs: int) -> DataFrame:
    """One row per kept term and source (n: tokens there; total: in the lang; first: of the term's rows), and per group
    one with the empty term. Runs of blocks are dealt by (lang, term), sorted down to the block, and scanned; what is
    held of a term is one row per source."""

    def merged(t: pa.Table) -> pa.Table:
        first = changes(t, "lang", "term", "source")
        sums = {c: pa.array(np.add.reduceat(t.column(c).to_numpy(), first)) for c in ("docs", "n")}
        return pa.table({c: sums[c] if c in sums else t.column(c).take(pa.array(first)) for c in ("lang", "term", "source", "docs", "n")})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs((b.select(["lang", "term", "source", "docs", "n"]) for b in batches), merged):
            start = changes(t, "lang", "term")
            size = np.diff(np.append(start, t.num_rows))
            docs, total = (np.repeat(np.add.reduceat(t.column(c).to_numpy(), start), size) for c in ("docs", "n"))
            marks = pc.equal(t.column("term"), "").to_numpy(zero_copy_only=False)
            first = np.zeros(t.num_rows, bool)
            first[start] = True
            out = pa.table({"lang": t.column("lang"), "term": t.column("term"), "source": t.column("source"), "n": t.column("n"), "total": pa.array(total), "first": pa.array(first & ~marks)})
            yield from out.filter(pa.array((docs >= least_docs) | marks)).to_batches()

    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block").mapInArrow(scan, KEPT)


def scaled(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total) as a long, null where total is 0; decimals on the way, so that no count is too large."""
    return F.when(F.col(total) > 0, F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} as decimal(20,0))"))


def distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def met_pairs(placed: DataFrame) -> DataFrame:
    """lang, source, other and what a term that both have adds beyond what each adds alone; partial sums by block.

    The scan of the runs of terms: each row of a run meets the others of its run, in blocks of BLOCK_PAIRS, so a
    term of many sources is no more at once than one of few. plus and minus stay below 3 * 10**18 each for up to
    2 * 10**8 terms of a language.
    """

    def add(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, lambda t: t):
            start = changes(t, "lang", "term")
            size = np.diff(np.append(start, t.num_rows))
            from_, k = np.repeat(start, size), np.repeat(size, size)
            lang, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            lang, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, source))
            sources = len(source.dictionary)
            at, p, p0 = source.indices.to_numpy().astype(np.int64), t.column("p").to_numpy(), t.column("p0").to_numpy()
            group = lang.indices.to_numpy().astype(np.int64) * sources + at
            ends = np.cumsum(k)
            row = 0
            while row < t.num_rows:
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BLOCK_PAIRS, "right")))
                one = np.repeat(np.arange(row, stop), k[row:stop])
                two = np.arange(len(one)) - np.repeat(np.cumsum(k[row:stop]) - k[row:stop], k[row:stop]) + np.repeat(from_[row:stop], k[row:stop])
                row = stop
                one, two = one[one != two], two[one != two]
                if not len(one):
                    continue
                key = group[one] * sources + at[two]
                order = np.argsort(key, kind="stable")
                one, two, key = one[order], two[order], key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                plus = np.add.reduceat(add(p[one], p[two]) + add(p0[one], p0[two]), first)
                minus = np.add.reduceat(add(p[one], p0[two]) + add(p0[one], p[two]), first)
                pick = lambda x, i: x.dictionary.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pick(lang, key[first] // sources // sources), pick(source, key[first] // sources % sources), pick(source, key[first] % sources), pa.array(plus), pa.array(minus)], ["lang", "source", "other", "plus", "minus"])

    runs = placed.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return runs.mapInArrow(scan, PAIR)


def whole(c: str) -> Column:
    return F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(c)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    Part pair: each other source of the lang, with the distance of the group's smoothed term shares from its. Part
    term: the most_terms terms that set the group most apart from its lang. Nulls are empty texts, langs and sources;
    a row is a document, also if it repeats another; other columns are ignored and no rows give no rows. Ties go by
    the item's UTF-8. Texts of any length are read whole, in blocks of whole documents.

    What is shuffled are runs of blocks, not tokens. The sums over all kept terms of a lang are taken from those a
    group has: a term that neither source has adds the same each time, one that only one has adds what follows from
    its count there (summed by different shares, with each different share of absent terms), and one that both have
    is met in its run.
    """
    clean = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = materialize(kept_runs(runs_of_blocks(clean), least_docs), "runs")
    size = runs.groupBy("lang", "source").agg(F.sum("n").alias("tokens"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("all_tokens"), F.count_if("first").alias("terms"))
    groups = size.join(langs, "lang").withColumns({"size": F.col("tokens") + F.col("terms"), "all_size": F.col("all_tokens") + F.col("terms")})
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, scaled("0", "size"))), "groups")

    placed = runs.filter("term <> ''").join(groups.select("lang", "source", "size", "all_size", "p0"), ["lang", "source"])
    placed = materialize(placed.select("lang", "term", "source", scaled("n", "size").alias("p"), "p0", scaled("total", "all_size").alias("q")), "placed")
    discard(runs)

    apart = placed.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    by_value = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = apart.withColumn("rank", by_value).filter(F.col("rank") <= most_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    shares = placed.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    absent = groups.filter("p0 is not null").select("lang", F.col("p0").alias("z")).distinct()
    alone = shares.join(absent, "lang")
    m = F.col("m").cast("decimal(20,0)")
    alone = alone.select("lang", "source", "z", (m * F.expr(f"{distance('p', 'z')} - {distance('p0', 'z')}")).alias("as_one"), (m * F.expr(f"{distance('z', 'p')} - {distance('z', 'p0')}")).alias("as_other"))
    alone = materialize(alone.groupBy("lang", "source", "z").agg(whole("as_one"), whole("as_other")), "alone")
    met = materialize(met_pairs(placed).groupBy("lang", "source", "other").agg(whole("plus"), whole("minus")), "met")

    one = groups.select("lang", "source", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("z"))
    both = one.join(other, "lang").filter("source <> other")  # the rows that are asked for
    both = both.join(alone.drop("as_other"), ["lang", "source", "z"], "left")
    both = both.join(alone.select("lang", F.col("source").alias("other"), F.col("z").alias("p0"), "as_other"), ["lang", "other", "p0"], "left").join(met, ["lang", "source", "other"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)"))
    value = F.coalesce(F.expr(f"cast(terms as decimal(20,0)) * {distance('p0', 'z')}").cast("decimal(38,0)"), F.lit(0)) + zero("as_one") + zero("as_other") + zero("plus") - zero("minus")
    both = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.cast("long").alias("value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
