"""PMI pairs with keys pruned before pairs are made, and embeddings counted in their rows, against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sediment.operators import correlation, models
from sediment.sources import pdf


@pytest.mark.parametrize("least_pmi,least_files", [(0.3, 2), (1.5, 3), (0.0, 1), (-1.0, 2)])
def test_pmi_pairs_equal_brute_force(spark, least_pmi, least_files):
    rng = random.Random(7)
    keys = [f"k{i}" for i in range(40)]
    files = {i: {k for j, k in enumerate(keys) if rng.random() < (0.9 if j < 3 else 0.3 if j < 15 else 0.03)} for i in range(120)}
    files = {i: ks | ({"p", "q"} if i % 20 == 0 else set()) for i, ks in files.items()}
    rows = [(i, k) for i, ks in files.items() for k in ks]
    files = {i: ks for i, ks in files.items() if ks}
    single, both = Counter(k for _, k in rows), Counter(p for ks in files.values() for p in itertools.combinations(sorted(ks), 2))
    n, e = len(files), 1e-10
    pmi = {p: max(-10, min(10, math.log((c / n + e) / (single[p[0]] / n * (single[p[1]] / n) + e)))) for p, c in both.items() if c >= least_files}
    want = {p: round(v, 9) for p, v in pmi.items() if v >= least_pmi}
    got = correlation.pmi_pairs(spark.createDataFrame(rows + rows[:50], "file_id long, key string"), least_pmi, least_files, None).collect()
    assert {(r["e1"], r["e2"]): round(r["pmi"], 9) for r in got} == want and len(got) == len(want) > 0


def test_keys_that_cannot_pair_go_first(spark):
    rows = [(i, "everywhere") for i in range(100)] + [(i, f"once{i}") for i in range(100)] + [(i, k) for i in range(10) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "file_id long, key string")
    single, files = df.groupBy("key").count().withColumnRenamed("count", "c"), spark.createDataFrame([(100,)], "files long")
    assert sorted(r["key"] for r in correlation.may_pair(single, files, 0.3, 2).collect()) == ["a", "b"]
    assert [(r["e1"], r["e2"], r["cooc"]) for r in correlation.pmi_pairs(df, 0.3).collect()] == [("a", "b", 10)]


def test_embeddings_are_counted_in_their_rows(spark):
    texts = [None, "", "...", "a b a", "Straße ÄÖ x1 x1 x1", "東京 é é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df = models.hashed_embeddings(rows, ["id"], "text", 64)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        words = re.findall(r"[^\W_]+", (texts[r["id"]] or "").lower())
        c = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in words)
        norm = math.sqrt(sum(v * v for v in c.values())) or 1.0
        assert r["v"] == pytest.approx([c[i] / norm for i in range(64)], abs=1e-15)
    assert models.hashed_embeddings(rows.limit(0), ["id"], "text").count() == 0


def test_python_answers_in_slices(spark, monkeypatch):
    """The embedder and the PDF reader hold a slice of a batch as Python objects at a time, never the whole of a large batch."""
    ran = []
    text = spark.createDataFrame([(1, "a")], "id long, text string")
    monkeypatch.setattr(type(text), "mapInArrow", lambda self, f, *a, **k: ran.append(f))
    models.hashed_embeddings(text, ["id"], "text", 16)
    pdf.pdf(text.select(F.col("id").alias("file_id"), F.encode("text", "UTF-8").alias("content")))
    cells = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([[i % 16, 3] for i in range(2000)], pa.list_(pa.int32()))], ["id", "_cells"])
    files = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([pdf.pdf_of([f"n{i}"]) for i in range(2000)])], ["file_id", "content"])
    for f, batch in zip(ran, (cells, files)):
        got = list(f(iter([batch])))
        assert max(b.num_rows for b in got) <= 256 and [x for b in got for x in b.column(0).to_pylist()] == list(range(2000))
    assert [x for b in got for x in b.column("text").to_pylist()] == [f"n{i}" for i in range(2000)]
