"""Threshold edges and caps of the correlation operators, against plain Python."""

from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from sediment.functions import scalar as S
from sediment.operators import correlation
from sediment.plans import catalogue


def entities(spark, files):
    return spark.createDataFrame([(f, k) for f, keys in files.items() for k in keys], "file_id long, key string")


def test_pairs_per_file_stop_in_nested_loop_order(spark):
    keys = [f"k{i:03d}" for i in range(40)]
    got = {(r["e1"], r["e2"]) for r in correlation.cooccurrence(entities(spark, {1: keys}), pairs_per_file=50).collect()}
    assert got == set(list(combinations(keys, 2))[:50])


def test_strength_at_its_steps(spark):
    rows = {n: spark.range(1).select(S.strength(F.lit(n), F.lit(n)).alias("s")).first()["s"] for n in (2, 3, 4, 5, 10)}
    assert [round(rows[n], 6) for n in (2, 3, 4, 5, 10)] == [0.28, 0.42, 0.56, 0.7, 1.0]


def test_expertise_needs_five_hits(spark):
    def run(n):
        return correlation.expertise(spark.createDataFrame([(i, "we tune docker and kubernetes") for i in range(n)], "file_id long, content string"))

    assert run(2).count() == 0
    assert [r["domain"] for r in run(3).collect()] == ["devops"]


def test_workflow_thresholds(spark):
    def run(n):
        return correlation.workflows(spark.createDataFrame([(i, f"report_v{i}") for i in range(n)], "file_id long, filename string")).count()

    assert (run(5), run(6)) == (0, 1)


def test_tech_stack_needs_two_categories_and_six_files(spark):
    def run(n, names):
        rows = [(i, t, "TECH") for i in range(n) for t in names]
        return correlation.tech_stack(spark.createDataFrame(rows, "file_id long, normalized string, entity_type string"))

    assert run(6, ["python"]).count() == 0
    assert run(5, ["python", "docker"]).count() == 0
    assert {r["category"] for r in run(6, ["python", "docker", "zig"]).collect()} == {"languages", "infrastructure", "other"}


def test_feedback_wins_and_stays(spark):
    fresh = spark.createDataFrame([("a", "t", 0.9, "active"), ("b", "u", 0.8, "active")], "id string, title string, confidence double, status string")
    stored = spark.createDataFrame([("b", "old", "confirmed"), ("c", "gone", "active"), ("d", "gone", "dismissed")], "id string, title string, status string")
    log = spark.createDataFrame([("a", "confirmed", "x", 1), ("a", "dismissed", "y", 2), ("c", "confirmed", "z", 1)], "id string, status string, note string, at long")
    got = {r["id"]: (r["title"], r["confidence"], r["status"], r["user_feedback"]) for r in correlation.merge_feedback(fresh, stored, log).collect()}
    assert got == {"a": ("t", 0.9, "dismissed", "y"), "b": ("u", 0.8, "confirmed", None), "c": ("gone", None, "confirmed", "z"), "d": ("gone", None, "dismissed", None)}
    asked = spark.createDataFrame([("a", "confirmed"), ("q", "confirmed")], "id string, status string")
    assert {r["id"]: r["found"] for r in correlation.give_feedback(fresh, asked).collect()} == {"a": True, "q": False}


def test_consolidation_against_plain_python(spark):
    rows = [(f % 7, k, v, "" if i % 5 == 0 else v.lower(), "c%d" % i if i % 3 else None, "%04d" % i) for i, (f, k, v) in enumerate((i * 13, "PERSON" if i % 2 else "ORG", ("Ann", "ann", "Bob", "The Bob")[i % 4]) for i in range(80))]
    files = spark.createDataFrame([(f, 100 - f) for f in range(6)], "file_id long, t long").select("file_id", F.timestamp_seconds("t").alias("indexed_at"))
    got = {(r["entity_type"], r["normalized"]): r for r in correlation.consolidate(spark.createDataFrame(rows, "file_id long, entity_type string, value string, normalized string, context string, id string"), files).collect()}
    want = {}
    for f, k, v, n, c, i in rows:
        if f < 6:
            key = (k, n or {"The Bob": "robert"}.get(v, v.lower()))  # a person, by the short form's full name
            want.setdefault(key, []).append((100 - f, i, f, v, c))
    assert set(got) == set(want)
    for key, seen in want.items():
        r = got[key]
        assert (r["occurrence_count"], r["file_count"], r["variants"]) == (len(seen), len({x[2] for x in seen}), sorted({x[3] for x in seen}))
        assert r["contexts"] == [x[4] for x in sorted(seen) if x[4]][:10]


def test_pairs_of_a_large_file_meet_in_slices(spark):
    e = entities(spark, {1: [f"k{i:03d}" for i in range(60)], 2: ["k001", "k002"]})
    got = {(r["e1"], r["e2"]): r["cooc"] for r in correlation.all_pairs(e, block=8).collect()}
    assert got == {p: 1 + (p == ("k001", "k002")) for p in combinations([f"k{i:03d}" for i in range(60)], 2)}


def test_names(spark):
    rows = [("PERSON", "The Gabe Smith"), ("ORG", "Acme, Inc."), ("PERSON", None)]
    df = spark.createDataFrame(rows, "kind string, value string")
    assert [r[0] for r in df.select(S.norm_canonical(F.col("value"), F.col("kind"))).collect()] == ["gabriel smith", "acme inc", None]
    assert [r[0] for r in df.select(S.norm_org(F.col("value"))).collect()][1] == "acme"
    assert S.size_limit("100MB") == 100 * 1024**2
    assert spark.range(1).select(S.title(F.lit("o'neil x_y 3m"))).first()[0] == "O'Neil X_Y 3M"


def test_empty_inputs(spark):
    none = entities(spark, {1: []}) if False else spark.createDataFrame([], "file_id long, key string")
    assert correlation.cooccurrence(none).count() == 0
    assert correlation.pmi_pairs(none).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_come_of_one_row_of_keys(spark):
    """Files of repeated keys, below and above the limit of pairs; pairs are made without a join."""
    files = {f: [f"k{(f * 7 + i * i) % 23:02d}" for i in range(f % 19)] * 2 for f in range(60)}
    for limit in (1, 10, 50, 500):
        want = {}
        for keys in files.values():
            for pair in list(combinations(sorted(set(keys)), 2))[:limit]:
                want[pair] = want.get(pair, 0) + 1
        df = correlation.cooccurrence(entities(spark, files), pairs_per_file=limit)
        assert {(r["e1"], r["e2"]): r["count"] for r in df.collect()} == want and "Join" not in plan(df) and "Window" not in plan(df)
    everything = {}
    for keys in files.values():
        for pair in combinations(sorted(set(keys)), 2):
            everything[pair] = everything.get(pair, 0) + 1
    for block in (4, 512):
        assert {(r["e1"], r["e2"]): r["cooc"] for r in correlation.all_pairs(entities(spark, files), block).collect()} == everything


def test_pairs_are_counted_once_for_all_that_read_them(spark):
    """The audit of a run and the statistics read written pairs: neither plan makes pairs again."""
    rows = [(f, "PERSON" if i % 2 else "ORG", f"V{i}", "" if i == 3 else f"v{i}") for f in range(8) for i in range(4)]
    e = spark.createDataFrame(rows, "file_id long, entity_type string, value string, normalized string").withColumn("key", F.concat_ws(":", "entity_type", "value")).withColumn("context", F.lit(None).cast("string")).withColumn("id", F.col("key"))
    seen = spark.createDataFrame([(f, 10) for f in range(7)], "file_id long, t long").select("file_id", F.timestamp_seconds("t").alias("indexed_at"))
    chunks = spark.createDataFrame([(i, "we tune docker and kubernetes") for i in range(5)], "file_id long, content string")
    tech = spark.createDataFrame([(1, "python", "TECH")], "file_id long, normalized string, entity_type string")
    names = spark.createDataFrame([(i, f"report_v{i}") for i in range(8)], "file_id long, filename string")
    audit = correlation.run(e, seen, chunks, tech, names, 0.2, 0.5)[1]
    assert "Generate" not in plan(audit) and audit.collect() == [(4, 6, 6, 4)]  # one expertise and one workflow are less sure
    stats = correlation.consolidated_stats(correlation.consolidated_keys(e, seen), correlation.cooccurrence(e))
    assert "Generate" not in plan(stats) and sorted(map(tuple, stats.collect())) == [("pairs", "all", 6), ("pairs", "strong", 6), ("total", "entities", 4), ("type", "ORG", 2), ("type", "PERSON", 2)]
    keys = lambda df: sorted((r["entity_type"], r["normalized"]) for r in df.collect())
    assert keys(correlation.consolidated_keys(e, seen)) == keys(correlation.consolidate(e, seen))


def test_pairs_are_counted_as_codes(spark):
    """Codes order as keys do over several partitions, pairs of codes are those of keys, and no key is shuffled with a pair."""
    odd = ["é", "Z", "a", "ab", "", "￿", "\U0001f600", *(f"k{i}" for i in range(60))]
    files = {f: [odd[(f * 7 + i * i) % len(odd)] for i in range(f % 19)] for f in range(60)}
    e = entities(spark, files).union(spark.createDataFrame([(99, None), (None, "a"), (7, None)], "file_id long, key string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lists, names = correlation.coded(e)
        assert names.filter("code >= 1L << 33").count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r["key"] for r in names.orderBy("code").collect()]
    assert held == sorted({k for ks in files.values() for k in ks}, key=lambda k: k.encode())
    assert {r["file_id"]: len(r["keys"]) for r in lists.collect()} == {f: len(set(ks)) for f, ks in files.items() if ks} | {99: 0}
    pairs, names = correlation.coded_cooccurrence(e, 10)
    assert dict(pairs.dtypes)["e1"] == dict(pairs.dtypes)["e2"] == "bigint"
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(correlation.named(pairs, names)) == rows(correlation.cooccurrence(e, 10))


def test_keys_of_consolidated_entities_meet_few_files(spark):
    """A key whose smallest or largest file is there needs no join of all rows; one that is in a middle file only is found too."""
    rows = [(f, k, v, "" if v == "Bob" else v.lower()) for f, k, v in [(0, "ORG", "A"), (9, "ORG", "A"), (0, "ORG", "M"), (4, "ORG", "M"), (9, "ORG", "M"), (0, "ORG", "Gone"), (9, "PERSON", "Gone"), (5, "PERSON", "Bob"), (4, None, "N"), (9, None, "N"), (None, "ORG", "Q")]]
    e = spark.createDataFrame(rows, "file_id long, entity_type string, value string, normalized string")
    has = lambda *ids: spark.createDataFrame([(i,) for i in ids], "file_id long")
    got = lambda ids: {tuple(r) for r in correlation.consolidated_keys(e, has(*ids)).collect()}
    assert got([4, 5]) == {("ORG", "m"), ("PERSON", "robert"), (None, "n")}
    assert got([]) == set() and got([0, 5, 9, 5]) == {("ORG", "a"), ("ORG", "m"), ("ORG", "gone"), ("PERSON", "gone"), ("PERSON", "robert"), (None, "n")}
    assert "Join" not in plan(correlation.consolidated_keys(e, has(0, 5, 9)))


def test_keys_are_gathered_again_only_if_some_go(spark, monkeypatch):
    calls, gather = [], correlation.keys_of_files
    monkeypatch.setattr(correlation, "keys_of_files", lambda e: calls.append(1) or gather(e))
    e = entities(spark, {f: ["a", "b"] if f % 2 else ["c", "d"] for f in range(8)})
    assert [(r["e1"], r["e2"], r["cooc"]) for r in correlation.pmi_pairs(e, 0.3).collect()] == [("a", "b", 4), ("c", "d", 4)] and len(calls) == 1
    more = e.union(entities(spark, {f: ["every"] for f in range(8)}))
    assert [(r["e1"], r["e2"], r["cooc"]) for r in correlation.pmi_pairs(more, 0.3).collect()] == [("a", "b", 4), ("c", "d", 4)] and len(calls) == 3


def test_join_cooc_self_has_all_pairs_of_a_file(spark, tmp_path):
    """Orders of 3, 43 and 603 keys (3, 903 and 181,503 pairs, the last of them made in slices): no pair is left out."""
    lines = [(1, 5, 5), (1, 5, 5), *((2, i, i) for i in range(38)), (2, 7, 1), *((3, i, i) for i in range(598))]
    parts = [(i, f"Brand#{i % 3}", f"TYPE {i % 2}") for i in range(598)]
    con = duckdb.connect()
    for name, rows, columns in (("lineitem", lines, "l_orderkey long, l_suppkey long, l_partkey long"), ("part", parts, "p_partkey long, p_brand string, p_type string"), ("supplier", [(i, f"Supplier#{i:04d}") for i in range(598)], "s_suppkey long, s_name string"), ("orders", [(k, 0) for k in (1, 2, 3)], "o_orderkey long, o_orderdate long")):
        rows = [(*r, n) for n, r in enumerate(rows)] if name == "lineitem" else rows
        spark.createDataFrame(rows, columns + ", l_linenumber int" * (name == "lineitem")).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = {}
    for order in (1, 2, 3):
        keys = {k for o, i, p in lines if o == order for k in (f"PERSON:supplier#{i:04d}", f"ORG:brand#{p % 3}", f"PROJECT:type {p % 2}")}
        assert len(keys) == {1: 3, 2: 43, 3: 603}[order]
        for pair in combinations(sorted(keys), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r["e1"], r["e2"]): r["count"] for r in catalogue.QUERIES["join_cooc_self"](spark, str(tmp_path)).collect()} == want
    assert {(a, b): n for a, b, n in con.execute(catalogue.ORACLES["join_cooc_self"]).fetchall()} == want
