"""Chunkers, extractors, catalog and streams, against plain Python and against their batch twins."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sediment.operators import chunking, machines, models, search
from sediment.operators.graph_index import GraphIndex
from sediment.sources import catalog, extract
from sediment.streaming import events


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")


def test_paragraph_kinds_and_offsets(spark):
    rows = chunking.paragraphs(docs(spark, "# Head\nbody\n\n- item\n\n1. one\n\n```\ncode\n```\n\n\nlast", None, "")).collect()
    assert [(r["chunk_type"], r["start_char"]) for r in rows] == [("header", 0), ("list", 13), ("list", 21), ("code_block", 29), ("paragraph", 43)]


def test_text_chunks(spark):
    long = " ".join(f"Sentence number {i} has words." for i in range(300))
    rows = chunking.chunk_text(docs(spark, "tiny", long, "", None)).collect()
    assert [r["content"] for r in rows if r["file_id"] == 0] == ["tiny"]
    parts = [r["content"] for r in rows if r["file_id"] == 1]
    assert len(parts) > 2 and all(len(p.split()) <= 384 for p in parts)
    assert parts[1].startswith(" ".join(parts[0].split(". ")[-2:])[:20]) or parts[0].split(". ")[-2] in parts[1]
    assert {r["file_id"] for r in rows} == {0, 1}
    two = chunking.chunk_text(docs(spark, "a b c d e\n\nf g h i j")).collect()
    assert [(r["token_count"], r["start_char"], r["end_char"]) for r in two] == [(12, 0, 20)]  # 6 and 6, not 13


def test_packed_sentences_lend_two(spark):
    said = [" ".join(["w%d" % i] * 9) + "." for i in range(100)]
    got = chunking.sentence_chunks(docs(spark, " ".join(said)), 130, 260).collect()
    at, want = 0, []
    now: list[str] = []
    for x in said:  # 100 words a chunk
        if now and 9 * (len(now) + 1) > 100:
            want.append(now)
            now = now[-2:]
        now = [*now, x]
    want.append(now)
    assert [r["content"] for r in got] == [" ".join(x) for x in want]
    for r, x, after in zip(got, want, want[1:]):
        assert (r["start_char"], r["end_char"], r["token_count"]) == (at, at + len(" ".join(x)), int(9 * len(x) * 1.3))
        at += len(" ".join(x)) - sum(map(len, after[:2]))


def test_words_and_lines(spark):
    assert [r["content"] for r in chunking.chunk_words(docs(spark, "ab cd ef"), 6).collect()] == ["ab cd", "ef"]
    assert [r["content"] for r in chunking.line_blocks(docs(spark, "a\nb\nc"), 2).collect()] == ["a\nb", "c"]


def test_code_elements(spark):
    code = 'def hello(name):\n    """Say."""\n    return name\n\n\nclass Greeter(object):\n    def greet(self):\n        pass\n'
    df = docs(spark, code, "def broken(").withColumn("elements", extract.python_elements("content"))
    got = chunking.code_elements(df).collect()
    assert [(r["chunk_type"], r["content"].split("\n")[0]) for r in got] == [("code_function", "def hello(name):"), ("code_class", "class Greeter(object):"), ("code_function", "    def greet(self):")]


def test_html_and_markdown_and_yaml(spark):
    page = "<html><title>T</title><nav><a href='x'>no</a></nav><p>One</p><script>var x</script><p>Two</p></html>"
    r = docs(spark, page).select(extract.html("content").alias("x")).first()["x"]
    assert (r["content"], r["title"], r["link_count"]) == ("T\nOne\nTwo", "T", 0)
    r = docs(spark, "<p>One</p><a href='y'>AT&amp;T</a>AT&T").select(extract.html("content").alias("x")).first()["x"]
    assert (r["content"], r["link_count"]) == ("One\nAT&T\nAT&T", 1)
    assert [tuple(h) for h in docs(spark, "# A\nx\n## B").select(extract.markdown_headers(F.col("content"))).first()[0]] == [(1, "A"), (2, "B")]
    assert docs(spark, "a: 1\nb: 2", ": [").select(extract.yaml_keys("content")).collect()[0][0] == ["a", "b"]


def test_references_without_semicolon_stay(spark):
    """A title cut at a length may end within a reference; what is left of it is text as written."""
    r = docs(spark, "<title>a&amp;&amp</title><p>x &lt; y &ltz &#39;q&#39 &copy; &copy 2 & &amp;lt;</p>").select(extract.html("content").alias("x")).first()["x"]
    assert (r["title"], r["content"]) == ("a&&amp", "a&&amp\nx < y &ltz 'q&#39 © &copy 2 & &lt;")


def test_exports(spark):
    one = [{"uuid": "u", "name": "n", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}]}]
    node = lambda role, text, at: {"message": {"author": {"role": role}, "content": {"parts": [text]}, "create_time": at}}
    two = [{"id": "c", "title": "t", "mapping": {"a": node("assistant", "late", 5.0), "b": node("user", "early", 1.0), "c": node("tool", "skip", 2.0), "d": {"message": None}, "e": node("user", " ", None)}}]
    two[0]["mapping"]["f"] = {"message": {"author": {"role": "system"}, "content": {"parts": ["no", "", {"t": 1}, 2]}}}
    odd = [{"uuid": "u", "name": "n", "created_at": "", "chat_messages": ["no message"]}]
    files = spark.createDataFrame([("1", json.dumps(one)), ("2", json.dumps(two)), ("3", "not valid json"), ("4", '{"random": 1}'), ("5", '{"conversations": []}'), ("6", json.dumps(odd)), ("7", "[]")], "path string, value string")
    rows = sorted(extract.exports(files, now=9.0).collect(), key=lambda r: (r["path"], r["sequence"] or 0))
    assert [(r["path"], r["role"], r["content"], r["at"]) for r in rows[:5]] == [("1", "human", "hi", 9.0), ("1", "assistant", "a b", 9.0), ("2", "human", "early", 1.0), ("2", "assistant", "late", 5.0), ("2", "system", "no {'t': 1} 2", 9.0)]
    assert "Invalid JSON" in rows[5]["error"] and rows[6]["error"] == "Could not detect provider format" and rows[7]["success"] and rows[7]["provider"] == "gemini"
    assert rows[8]["error"].startswith("Parse error") and rows[9]["error"] == "Could not detect provider format"


def test_catalog_snapshots(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path))
    assert store.missing(["files"]) == ["files"]
    rows = lambda *x: spark.createDataFrame(list(x), "id string, status string, version int, indexed_at string")
    store.upsert("files", rows(("a", "pending", 1, None), ("b", "pending", 1, None)), ["id"], "version")
    store.upsert("files", rows(("a", "done", 2, None)), ["id"], "version")
    store.update_status("files", spark.createDataFrame([("b", "indexed")], "id string, new_status string"), "id", F.lit("now"))
    assert sorted(tuple(r) for r in store.read("files").select("id", "status", "indexed_at").collect()) == [("a", "done", None), ("b", "indexed", "now")]
    store.delete("files", F.col("id") == "a")
    assert [r["id"] for r in store.read("files").collect()] == ["b"]


GAPS = [("p", 0.0), ("p", 0.5), ("p", 1.9), ("p", 2.0), ("p", 3.9), ("p", 4.0), ("q", 1.0), ("q", 4.0)]


def test_debounce_edges(spark):
    df = spark.createDataFrame(GAPS, "path string, t double").select("path", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    got = sorted((r["path"], r["accepted_at"].timestamp() % 60) for r in events.debounce_batch(df, "path", "ts").collect())
    assert got == [("p", 0.0), ("p", 2.0), ("p", 4.0), ("q", 1.0), ("q", 4.0)]


@pytest.mark.parametrize("form", ["debounce", "rates"])
def test_stream_equals_batch(spark, tmp_path, form):
    df = spark.createDataFrame(GAPS + [("z", 9000.0)], "path string, t double").select("path", F.timestamp_micros(((F.col("t") + 1e6) * 1e6).cast("long")).alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = events.debounce(stream, "path", "ts") if form == "debounce" else events.rates(stream, "ts")
    q = out.writeStream.format("memory").queryName(f"out_{form}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table(f"out_{form}").collect()]
    if form == "debounce":
        want = [tuple(r) for r in events.debounce_batch(df, "path", "ts").collect()]
        assert sorted(got) == sorted(want)
    else:
        want = {tuple(r) for r in events.rates(df, "ts").collect()}
        assert set(got) <= want and got  # the last window stays open


def test_recall_of_the_approximate_searches(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    want = pairs(search.nearest_batch(v, asked, 5))
    assert pairs(search.nearest_batch(v, asked, 5, most=7)) == want  # in groups of queries
    hybrid = lambda strategy, index=None: pairs(search.hybrid(v, asked, 5, strategy, index))
    assert hybrid("auto") == hybrid("flat") == want and len(hybrid("indexed", GraphIndex.build(v))) == len(want)
    with pytest.raises(ValueError):
        hybrid("indexed")
    for got in (models.InvertedFile.build(v, 20).nearest_batch(asked, 5, 16), GraphIndex.build(v).nearest_batch(asked, 5, 128)):
        assert len(want & pairs(got)) >= 0.9 * len(want)


def test_upsert_ties_and_inserts(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int, t string")
    store.insert("x", rows(("a", 1, "old")), ["id"])
    store.insert("x", rows(("b", 1, "old")), ["id"])
    with pytest.raises(ValueError):
        store.insert("x", rows(("b", 2, "new")), ["id"])
    store.upsert("x", rows(("a", 1, "new")), ["id"], "v")
    store.insert("x", rows(("c", 1, "late")))
    assert sorted((r["id"], r["t"]) for r in store.read("x").collect()) == [("a", "new"), ("b", "old"), ("c", "late")]
    store.delete_keys("x", spark.createDataFrame([("a",)], "id string"))
    assert sorted(r["id"] for r in store.read("x").collect()) == ["b", "c"]


def test_context_rendering(spark):
    one = spark.range(1)
    chunk = F.array(F.struct(F.lit("x" * 600).alias("content"), F.lit("s").alias("source"), F.lit(0.5).alias("similarity"), F.lit("t").alias("chunk_type")))
    none = F.array().cast("array<struct<discovery_type:string,title:string,description:string,confidence:double>>")
    names = F.array().cast("array<struct<entity_type:string,canonical_value:string>>")
    got = one.select(models.rendered(F.lit("q"), chunk, none, names, "markdown")).first()[0]
    assert got == "## Context: q\n\n### Relevant Content\n\n**[1]** _s_ (similarity: 0.50)\n\n> " + "x" * 500 + "...\n\n"
    assert "<discoveries>" not in one.select(models.rendered(F.lit("q"), chunk, none, names)).first()[0]


def test_machines(spark):
    words = spark.createDataFrame([("a", f"w{i}") for i in range(12)] + [("b", f"w{i}") for i in range(6)], "machine string, entity string")
    idx = machines.index(words)
    r = machines.collaboration(idx).first()
    assert (r["shared"], r["only1"], r["only2"]) == (6, 6, 0)
    assert machines.silos(idx).count() == 0 and machines.silos(idx, 6).first()["machine"] == "a"
    master = spark.createDataFrame([("x",)], "content string").select(F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))
    chunks = spark.createDataFrame([("b", 1, 0, "same"), ("a", 2, 0, "same"), ("a", 3, 0, "x")], "machine string, file_id long, chunk_index int, content string")
    assert [(r["machine"], r["content"]) for r in machines.merge_chunks(chunks, master).collect()] == [("a", "same")]


def test_batch_search_of_copies_and_odd_vectors(spark):
    """Copies tie by vec_id, near copies are told apart, vectors without a distance come last; blocks and groups don't matter."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:220] = x[100]
    x[150] = np.nextafter(x[100], np.float32(9))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for metric in ("cosine", "l2"):
        want = []
        for q, a in rows:
            if q % 10 == 0:
                far = []
                for i, b in rows:
                    if a is None or b is None or len(a) != len(b) or not np.isfinite(b).all():
                        far.append((1, 0.0, i))
                        continue
                    dot = lambda m, n: sum(s * t for s, t in zip(m, n))
                    d = sum((s - t) * (s - t) for s, t in zip(a, b)) if metric == "l2" else 1 - dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) if any(b) else None
                    far.append((d is None, d or 0.0, i))
                want += [(q, r + 1, y[2]) for r, y in enumerate(sorted(far)[:12])]
        for most, block in ((4096, 8192), (7, 50)):
            got = search.nearest_batch(v, asked, 12, metric, most, block).select("query_id", "rank", "vec_id").collect()
            assert sorted(map(tuple, got)) == sorted(want), metric


def test_batch_search_multiplies_matrices(spark):
    """Pairs of a large batch are no rows of a plan: 200 queries against 40,000 vectors within seconds of task time."""
    import numpy as np

    from sediment.operators.search import nearest_rows

    rng = np.random.default_rng(1)
    a, start = rng.normal(size=(40_000, 64)), time.process_time()
    i, j, d = nearest_rows(a, a[::200], 5, "cosine")
    assert time.process_time() - start < 20 and (j[::5] == np.arange(0, 40_000, 200)).all() and len(d) == 1000


def test_parts_read_by_python_are_dealt_to_all_cores(spark, tmp_path):
    """One small file of many parts: every core reads YAML and Python of some of them."""
    from sediment.plans import catalogue

    spark.range(20_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("src_yaml", "src_python", "chunk_code"):
        key = "file_id" if name == "chunk_code" else "p_partkey"
        rows = catalogue.QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct(key).alias("n")).collect()
        assert len(rows) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in rows) < 5_000, name


def test_yaml_by_either_reader():
    for text, keys in (("a: 1\nb: [1, 2]\n1: x", ["a", "b", "1"]), (": [k: 1", []), ("- a\n- b", []), ("", []), (None, []), ("a: !!python/object:os.system x", []), ("&x a: 1\n'b': *x\n", ["a", "b"])):
        assert extract.keys_of(text) == keys, text
