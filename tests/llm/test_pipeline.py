"""Each stage on what its predecessor kept, against plain Python; and the whole run."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sediment.llm import mixing, packing, secrets, toxicity
from tests.conftest import SF

from .test_documents import SCHEMA, labelled, shingles


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10_000 + i, t, "en", "made", len(t)) for i, t, _ in labelled()]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    told = [(10_000 + i, int(i % 9 != 0), y) for i, _, y in labelled()]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    made = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made.append(corpus_pipeline.materialize(stage(spark, made[-1], str(tmp_path)), name))
        assert made[-1].columns == docs.columns
    start, clean, one, masked, mixed = map(rows_of, made)
    # toxicity: the rows that the score lets through, unchanged
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    assert clean == Counter({r: n for r, n in start.items() if judged[r[0]] == 0}) and len(clean) <= len(start) - 90
    # near-duplicates: the smallest id of each class of texts linked by five-word shingles
    ids = sorted(r[0] for r in clean)
    sets, root = {r[0]: shingles(r[1]) for r in clean}, {i: i for i in ids}
    texts = {r[0]: r[1] for r in clean}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if texts[i] == texts[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert one == Counter({r: 1 for r in clean if top(r[0]) == r[0]})
    # secrets: every base match is masked, all else stays
    spans = {r["doc_id"]: sorted((s["start"], s["end"]) for s in [*r["base_spans"], *r["more_spans"]]) for r in secrets.scan(made[2]).collect()}
    for r in one:
        out, at = "", 0
        for a, b in spans[r[0]]:
            if a >= at:
                out += r[1][at:a] + "[SECRET]"
            at = max(at, b)
        want = out + r[1][at:]
        assert (r[0], want, r[2], r[3], len(want) if spans[r[0]] else r[4]) in masked
        assert not any(len(m[2]) >= 6 for m in re.finditer(secrets.ASSIGN, want)) and not re.search(r"[0-9a-f]{24}", want)
    assert sum(masked.values()) == sum(one.values())
    # mixing: copies by rate; no document that is surely good is lost
    rates = {r["doc_id"]: r for r in mixing.rates(made[3], mixing.domains_of(labels)).collect()}
    assert set(mixed) <= set(masked)
    assert all(mixed[r] >= 1 for r in masked if rates[r[0]]["p_good"] > 0.999)
    # packing: the pieces of every copy, in sequences without gaps
    pieces = corpus_pipeline.STAGES[-1][1](spark, made[4], str(tmp_path)).collect()
    encode, want = packing.encoder(packing.default_vocabulary()), Counter()
    for r, n in mixed.items():
        t = np.append(encode(r[1]), 2).astype("<u4")
        for k, (a, size) in enumerate(packing.cut_points(len(t), 1024)):
            want[r[0], k, a, size, zlib.crc32(t[a : a + size].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([a for a, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist() and sum(n for _, n in p) <= 1024 for p in places.values())
    assert len(places) <= 1.05 * math.ceil(sum(r["length"] for r in pieces) / 1024) + 1


def test_two_runs_stay_readable(spark):
    one, two = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert one.count() == two.count() > 0
    assert one.select(F.sum("length")).first() == two.select(F.sum("length")).first()


def test_stages_on_odd_tables(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "b", 5, 6, "f", "p", 2, "h", "s") for i, t in [(1, None), (1, None), (None, "a b c"), (None, "a b c"), (2, ""), (3, "word " * 20_000), (4, "x y z")]]
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
