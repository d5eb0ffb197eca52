"""Quality rules with thresholds of their own for each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, discard, materialize, slices, table

# ASCII blanks, the signs that count as symbols, and the base rules.
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

NOT_WORDS = BLANKS + bytes(range(128, 192))  # what doesn't begin a code point of a word
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: The measures that thresholds are set for, in thousandths: name, the numerator, the denominator, which sides are
#: bounded, and the least distance of a bound from its quartile (thousandths, or None: half the median).
RULES = (
    ("word_length", "word_chars", "n_words", ("low", "high"), None),
    ("symbols", "n_symbols", "n_words", ("high",), 100),
    ("dup_lines", "n_dup_lines", "n_lines", ("high",), 400),
    ("repeat_words", "n_repeat_words", "n_words", ("high",), 300),
)
#: A bound lies SPREAD times the distance of the quartiles beyond its quartile; a group of fewer documents than
#: LEAST_DOCS goes by the sketch of its language, and that of all where the language has fewer too.
SPREAD, LEAST_DOCS = 4, 100
ADDED = (*MEASURES, "base_failed", "failed_rules", "kept")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more. Hashes rule out most texts; equality is settled by ranks of doubled windows."""
    if len(words) <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[: len(h) - window + 1].copy()
        for k in range(1, window):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - window + 1 + k]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = 1
    while size < window:  # the window is a power of two
        rank = np.unique(rank[:-size] * (rank.max() + 1) + rank[size:], return_inverse=True)[1]
        size *= 2
    found = np.flatnonzero(np.bincount(rank)[rank] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def measures_of(data: bytes) -> tuple[int, ...]:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), len(data.translate(None, NOT_WORDS)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame, *left_out: str) -> DataFrame:
    """docs (with text), but for the columns left out, and its whole text's measures: words, code points in words,
    symbols, repeated lines, words in repeated windows, lines with a word. A null text is empty."""
    rest = docs.drop(*MEASURES, *left_out)
    names = rest.columns
    schema = T.StructType([*rest.schema.fields, *[T.StructField(m, T.LongType()) for m in MEASURES]])
    rows = docs.select(*names, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text"):
                made = zip(*[measures_of(x.as_py()) for x in b.column("_text")])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array(c, pa.int64()) for c in made]], [*names, *MEASURES])

    return rows.mapInArrow(run, schema)


def value_of(of: str, over: str) -> Column:
    """A measure in whole thousandths, null without a denominator."""
    return F.when(F.col(over) > 0, F.expr(f"(1000 * {of}) div {over}"))


def cell(value: Column) -> Column:
    """The cell of a whole number in a log-linear sketch: exact below 64, then 32 cells for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (32 * shift + F.call_function("shiftright", value, shift)).cast("int")


def least_of(cell_: Column) -> Column:
    """The least number of a cell."""
    shift = F.greatest(F.floor(cell_ / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (cell_ - 32 * shift).cast("long"), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, cell, n: a quantile sketch for each group and rule, as counts by cell.

    Sketches merge by adding counts, in any order, so tasks combine theirs before the shuffle, and those of a
    language and of all are sums of those of its sources. A quartile is off by a 32nd of itself at most.
    """
    each = [F.struct(F.lit(name).alias("rule"), cell(value_of(of, over)).alias("cell")) for name, of, over, _, _ in RULES]
    cells = rows.select("lang", "source", F.inline(F.array(*each))).filter("cell is not null")
    return cells.groupBy("lang", "source", "rule", "cell").agg(F.count("*").alias("n"))


def bounds(found: DataFrame, *keys: str) -> DataFrame:
    """keys, docs, and a map of low and high bounds by rule, from sketches merged by keys; a rule has a few hundred cells."""
    merged = found.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"))
    one = merged.groupBy(*keys, "rule").agg(F.sum("n").alias("docs"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))

    def quantile(quarters: int) -> Column:
        """The least value that a number of quarters of the documents don't exceed."""
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("at"))
        step = lambda a, c: F.struct((a["sum"] + c["n"]).alias("sum"), F.coalesce(a["at"], F.when(4 * (a["sum"] + c["n"]) >= quarters * F.col("docs"), c["cell"])).alias("at"))
        return least_of(F.aggregate("cells", start, step, lambda a: a["at"]))

    one = one.select(*keys, "rule", "docs", *[quantile(k).alias(f"q{k}") for k in (1, 2, 3)])
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for name, _, _, _, m in RULES if m for x in (name, m)]), F.col("rule")), F.expr("q2 div 2"))
    far = F.greatest(least, SPREAD * (F.col("q3") - F.col("q1")))
    both = F.struct((F.col("q1") - far).alias("low"), (F.col("q3") + far).alias("high"))
    return one.groupBy(*keys).agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("rule", both))).alias("bounds"))


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, docs, bounds: the group's own bounds, or of fewer than LEAST_DOCS documents those of its language, or of all."""
    found = materialize(sketches(rows), "sketches")
    own, by_lang, by_all = bounds(found, "lang", "source"), bounds(found, "lang"), bounds(found)
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.col("docs").alias("_docs"), F.col("bounds").alias("_bounds"))
    out = own.join(by_lang, F.col("lang") == F.col("_lang"), "left").crossJoin(F.broadcast(by_all.select(F.col("bounds").alias("_all"))))  # one row
    chosen = F.when(F.col("docs") >= LEAST_DOCS, F.col("bounds")).when(F.col("_docs") >= LEAST_DOCS, F.col("_bounds")).otherwise(F.col("_all"))
    out = materialize(out.select("lang", "source", "docs", chosen.alias("bounds")), "thresholds")
    discard(found)
    return out


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (measured, lang and source not null) joined with their group's bounds: base_failed, failed_rules (names), kept.

    A frequent group's bounds are broadcast (512 groups at most), the others are joined by key.
    """
    both = rows.withColumn("_group", F.concat_ws("\u0000", "lang", "source"))
    keyed = materialize(limits.select(F.concat_ws("\u0000", "lang", "source").alias("_group"), F.col("docs").alias("_n"), F.col("bounds").alias("_bounds")), "limits")
    out = attach(both, "_group", keyed, "_n", F.xxhash64("n_words", "word_chars", "n_lines"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))

    def fails(name: str, of: str, over: str, sides: tuple[str, ...], _: int | None) -> Column:
        at, value = F.try_element_at("_bounds", F.lit(name)), value_of(of, over)
        tests = {"low": value < at["low"], "high": value > at["high"]}
        return F.when(F.coalesce(F.array_max(F.array(*[tests[s] for s in sides])), F.lit(False)), F.lit(name))

    failed = F.array_compact(F.array(*[fails(*r) for r in RULES]))
    out = out.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_group", "_n", "_bounds")


def grouped(docs: DataFrame) -> DataFrame:
    """docs with null lang and source as empty, so that such rows are groups too."""
    return docs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed, failed_rules and kept for each row of docs (doc_id, text, lang, source).

    Texts are read once; the thresholds and the join see the measures only, written as a table. A null text has
    no words and fails the base rules; a null lang or source is an empty one. A row that fails no rule is kept:
    bounds are far from a group's quartiles, so a group without odd documents loses none, and up to a quarter of
    a group may be odd without moving them far. Repeated rows count each and are judged alike. No rows give no rows.
    Other columns are ignored; texts of any length are measured whole, one at a time.
    """
    rows = materialize(measured(grouped(docs.select("doc_id", "text", "lang", "source")), "text"), "measures")
    return judged(rows, thresholds(rows))


def good_only(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are.

    Two passes over the texts, as nothing but the thresholds of the first is written; rows of small groups, texts
    included, are shuffled to their bounds only where there are more than 512 groups.
    """
    named = docs.select(*docs.columns, F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"))
    own = {"_lang": "lang", "_source": "source"}
    narrow = measured(named.select("text", "_lang", "_source"), "text")
    limits = thresholds(narrow.withColumnsRenamed(own))
    plain = [c for c in docs.columns if c not in ADDED and c not in ("lang", "source")]
    held = F.struct(*[F.col(c) for c in docs.columns if c not in plain])
    rows = measured(named.select(*plain, held.alias("_held"), F.col("_lang").alias("lang"), F.col("_source").alias("source")))
    kept = judged(rows, limits).filter("kept")
    return kept.select(*[F.col(c) if c in plain else F.col(f"_held.{c}").alias(c) for c in docs.columns])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *MEASURES[:5], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
