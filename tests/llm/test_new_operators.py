"""Quality rules, source divergence and fill-in-the-middle: on odd inputs, against plain Python and against their own definitions."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sediment.llm import divergence, fill_middle, quality

ODD = [None, "", " ", "\n\n", "a", "é", " x　y", "<P>", "x<S>y", "ab12 cd\tEF\r\n", "naïve café 東京 😀 ok", "<", "<<P", "A" * 5000, "é" * 3000 + "b", "a b " * 3000]


def table(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


def random_text(rng, n):
    return "".join(rng.choice(["ab", "Z", "é", " ", "\n", "<", "S>", "7", "東", "😀", "word "]) for _ in range(n))


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def test_fill_middle_equals_its_definition(spark):
    rng = random.Random(3)
    texts = ODD + [random_text(rng, rng.randint(0, 400)) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "twice", "en", "s")] * 2 + [(None, "no id at all", None, None)]
    made = fill_middle.transform(table(spark, rows).withColumn("n", F.lit("clash")).withColumn("more", F.lit(7)), every=4)
    assert made.columns == ["doc_id", "text", "lang", "source", "more", *fill_middle.ADDED]
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["more"] for r in got} == {7}
    forms = Counter()
    for r in got:
        t, u = r["text"] or "", units(r["text"] or "")
        h = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(u) + 1) for x in h[:2])
        parts = ["".join(x) for x in (u[:a], u[a:b], u[b:])]
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        output = t if plain else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}" if form == "psm" else f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
        assert (r["n"], r["form"], r["output"], r["back"]) == (len(u), form, output, t)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if plain else (len(parts[0]), len(parts[1])))
        forms[form] += 1
    assert min(forms.values()) > 5 and len(forms) == 3


@pytest.mark.parametrize("every,block", [(1, 1), (3, 2), (7, 16), (256, 1 << 16)])
def test_checkpoints_find_every_unit(every, block):
    rng = random.Random(every)
    for text in [t or "" for t in ODD] + [random_text(rng, 60) for _ in range(30)]:
        data, u = text.encode(), units(text)
        points = fill_middle.Checkpoints(data, every, block)
        assert points.n == len(u) and len(points.units) == -(-len(u) // every)
        for k in {0, len(u), *rng.sample(range(len(u) + 1), min(20, len(u) + 1))}:
            head = "".join(u[:k])
            assert points.locate(k, 3) == (len(head.encode()), len(head))


def measures(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(lines)


def quartile(values, quarter):
    """The least number of the cell where a quarter of the values is reached."""
    cells = sorted((v >> max(0, v.bit_length() - 6)) << max(0, v.bit_length() - 6) for v in values)
    return cells[next(i for i in range(len(cells)) if 4 * (i + 1) >= quarter * len(cells))]


def verdicts(rows):
    rows = [(i, t, lang or "", source or "", measures(t)) for i, t, lang, source in rows]
    at = {m: k for k, m in enumerate(quality.MEASURES)}

    def value(m, rule):
        return 1000 * m[at[rule[1]]] // m[at[rule[2]]] if m[at[rule[2]]] else None

    def bounds(group, rule):
        vs = [v for r in group if (v := value(r[4], rule)) is not None]
        q1, q2, q3 = (quartile(vs, k) for k in (1, 2, 3))
        far = max(rule[4] or q2 // 2, quality.SPREAD * (q3 - q1))
        return q1 - far, q3 + far

    out = Counter()
    for i, _, lang, source, m in rows:
        base, failed = m[0] < 20 or 100 * m[4] > 30 * m[0], []
        for rule in quality.RULES:
            has = lambda r: value(r[4], rule) is not None  # noqa: E731, B023
            group, by_lang = ([r for r in rows if has(r) and r[2] == lang and (every or r[3] == source)] for every in (False, True))
            group = group if len(group) >= quality.LEAST_DOCS else by_lang if len(by_lang) >= quality.LEAST_DOCS else [r for r in rows if has(r)]
            v = value(m, rule)
            if v is not None and group:
                low, high = bounds(group, rule)
                if ("low" in rule[3] and v < low) or ("high" in rule[3] and v > high):
                    failed.append(rule[0])
        out[(i, *m, base, not base and not failed, ",".join(failed))] += 1
    return out


def test_quality_rules_equal_their_definition(spark):
    rng = random.Random(5)
    words = ["der", "the", "quick", "brown", "Straße", "fox", "jumps", "over", "lazy", "dog", "et", "naïve"]

    def text(kind):
        w = rng.choices(words, k=rng.randint(21, 60))
        if kind == 1:
            w = [x + "&&&" for x in w]
        if kind == 2:
            w = w[:9] * 6
        lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
        return "\n".join(lines * 3 if kind == 3 else lines)

    rows = [(i, text(rng.choice([0, 0, 0, 0, 0, 0, 1, 2, 3])), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    rows += [(1000 + i, t, None if i % 2 else "xx", "rare") for i, t in enumerate(ODD)] + [rows[0]] * 2
    got = Counter((r["doc_id"], *[r[m] for m in quality.MEASURES], r["base_failed"], r["kept"], ",".join(r["failed_rules"])) for r in quality.scored(table(spark, rows)).collect())
    want = verdicts(rows)
    assert got == want
    assert sum(not k[-2] and not k[-3] for k in want) > 20  # the method has a verdict of its own


def test_quality_keeps_columns_and_clean_rows(spark):
    rng = random.Random(6)
    clean = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=40)), "en", f"s{i % 3}") for i in range(400)]
    docs = table(spark, [*clean, (999, "$$$ ### " * 20 + clean[0][1], None, "s0")]).withColumn("n_words", F.lit("x")).withColumn("bounds", F.col("doc_id")).withColumn("kept", F.lit(3))
    kept = quality.good_only(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400)) and {(r["n_words"], r["kept"], r["lang"]) for r in rows} == {("x", 3, "en")}
    assert all(r["bounds"] == r["doc_id"] for r in rows)


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["a", "bcd", "#", "efghijk"], k=rng.randint(0, 30))), rng.choice("xy"), rng.choice("pq")) for i in range(300)]
    tables = [quality.sketches(quality.measured(table(spark, rows).repartition(n), "text")).collect() for n in (1, 7)]
    assert sorted(tables[0]) == sorted(tables[1])
    values = [*range(2000), *(2**k + d for k in range(6, 40) for d in (-1, 0, 1))]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.least_of(quality.cell(F.col("v"))).alias("low")).collect()
    assert all(r["low"] <= r["v"] and (r["v"] - r["low"]) * 32 <= r["v"] for r in got)


def audited(rows, least=3, most=200):
    """The audit with fractions, over all kept terms."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        seen = Counter(w for r in mine for w in set(r[2]))
        kept = sorted(w for w in seen if seen[w] >= least)
        counts = {s: Counter(w for r in mine if r[1] == s for w in r[2] if seen[w] >= least) for s in {r[1] for r in mine}}
        share = lambda c: {w: 1 + int(Fraction(10**9 * (c[w] + 1), sum(c.values()) + len(kept))) for w in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, items, n in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(items)[:n])]
    return sorted(out)


@pytest.mark.parametrize("block,pairs", [(1 << 23, 1 << 18), (200, 5)])
def test_divergence_equals_its_definition(spark, monkeypatch, block, pairs):
    rng = random.Random(8)
    words = ["der", "The", "the", "quick", "STRASSE", "Straße", "ÉTÉ", "été", "fox", "x1y", "東京", "a", "b", "zz", "😀", "rare", "ab-cd"]
    rows = [(" ".join(rng.choices(words[: rng.randint(2, len(words))], k=rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None])) for _ in range(160)]
    rows += [(t, "odd", f"o{i % 3}") for i, t in enumerate(ODD)] + [("only these", "once", "a"), (None, "once", "b"), ("", "alone", "c")] + [rows[0]] * 3
    monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
    monkeypatch.setattr(divergence, "BLOCK_PAIRS", pairs)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")
    got = divergence.audit(docs, most_terms=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, most=6)


def test_divergence_shuffles_runs_of_blocks(spark):
    texts = [(i, "the same few words in each of them " * 5, "en", f"s{i % 2}") for i in range(500)]
    runs = divergence.runs_of_blocks(table(spark, texts).coalesce(1)).collect()
    assert len(runs) == 2 * (8 + 1)  # a row per source and term, and one per source, of one block
    assert {(r["docs"], r["n"]) for r in runs if r["term"] == "the"} == {(250, 1250)}


def test_empty_tables(spark):
    none = table(spark, [])
    assert fill_middle.transform(none).count() == quality.scored(none).count() == quality.good_only(none).count() == divergence.audit(none).count() == 0
