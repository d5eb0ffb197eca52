"""Drives, documents, excavations, scalars, jobs and schedules, against plain Python."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sediment.functions import scalar as S
from sediment.sources import catalog, drives, pdf
from sediment.streaming import jobs


def test_walk_and_discover(spark, tmp_path):
    for name in ("a.txt", "deep/b.MD", "deep/er/c.bin", ".hidden/d.txt", "node_modules/e.txt", "deep/.f.txt", "deep/g.tmp", "other/h.docx"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * len(name))
    files = drives.listing(spark, str(tmp_path))
    rows = {r["path"]: (r["name"], r["extension"], r["size_bytes"]) for r in files.collect()}
    assert rows["deep/b.MD"] == ("b.MD", "md", 9) and len(rows) >= 6
    assert {r["path"] for r in drives.walk(files).collect()} <= {"a.txt", "deep/b.MD", "deep/.f.txt", "other/h.docx"}
    sources = spark.createDataFrame([("one", "deep", True, True, None), ("two", "", True, False, ["txt"]), ("off", "", False, True, None)], "source string, root string, enabled boolean, recursive boolean, file_types array<string>")
    got = sorted((r["source"], r["path"]) for r in drives.discover(files, sources).collect() if not r["name"].startswith("."))
    assert got == [("one", "deep/b.MD"), ("one", "deep/er/c.bin"), ("two", "a.txt")]
    assert drives.export_files(files).count() == 0


def test_tables_of_parts_are_one_file(spark, tmp_path):
    """A table that Spark wrote is a folder of parts; the catalogue's queries list it by the folder's name."""
    from sediment.plans import archive, catalogue

    for name in ("region.parquet", "documents.parquet/part-0.parquet", "documents.parquet/part-1.parquet", "deep/pages.PARQUET/k=1/part-0.parquet", "deep/x.parquet"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * 5)
    rows = {r["path"]: (r["name"], r["extension"], r["size_bytes"]) for r in drives.tables_whole(drives.listing(spark, str(tmp_path))).collect()}
    assert rows == {"region.parquet": ("region.parquet", "parquet", 5), "documents.parquet": ("documents.parquet", "parquet", 10), "deep/pages.PARQUET": ("pages.PARQUET", "parquet", 5), "deep/x.parquet": ("x.parquet", "parquet", 5)}
    found = archive.src_discover(spark, str(tmp_path)).collect()
    assert sorted((r["source"], r["name"]) for r in found) == [("all", "documents.parquet"), ("all", "region.parquet"), ("typed", "documents.parquet"), ("typed", "region.parquet")]
    assert {r["name"] for r in catalogue.QUERIES["src_walk_drive"](spark, str(tmp_path)).collect()} == {"documents.parquet", "region.parquet"}


def test_docx(spark):
    data = drives.docx_of(["One", "  ", "Two"], [[["a", "b"], ["c", ""]]])
    assert drives.docx_text(data) == ("One\n\nTwo\n\n[Tables]\na | b\nc | ", 2, 1, None)
    rows = drives.docx(spark.createDataFrame([(1, data), (2, b"no zip"), (3, None)], "file_id long, content binary")).collect()
    assert [(r["file_id"], r["text"][:3], r["error"] is None) for r in rows] == [(1, "One", True), (2, "", False), (3, "", False)]


def test_pdf(spark):
    data = pdf.pdf_of(["One (1)\nÉté \\ x", "", "Two"])
    assert pdf.pdf_text(data) == ("One (1)\nÉté \\ x\n\nTwo", 3, None)
    hexed = b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R] >> endobj 2 0 obj << /Type /Page /Parent 1 0 R /Contents [3 0 R] >> endobj 3 0 obj << /Length 44 >>\nstream\nBT [(He) -20 <6C6C6F>] TJ 0 -14 Td (w\\157) ' ET\nendstream endobj"
    assert pdf.pdf_text(hexed)[0].split() == ["Hello", "wo"]
    rows = pdf.pdf(spark.createDataFrame([(1, data), (2, b"%PDF-1.4 /Encrypt"), (3, None)], "file_id long, content binary")).collect()
    assert [(r["page_count"], r["error"] is None) for r in rows] == [(3, True), (0, False), (0, False)]


def test_excavations_of_one_file_each(spark, tmp_path):
    for machine, file_id in (("m1", "f1"), ("m2", "f2")):
        for part in ("chunks", "metadata"):
            (tmp_path / machine / part).mkdir(parents=True)
        (tmp_path / machine / "metadata" / "excavation.json").write_text(json.dumps({"machine_id": machine}))
        (tmp_path / machine / "chunks" / f"{file_id}.json").write_text(json.dumps({"file_id": file_id, "file_path": "/x/a.TXT", "file_name": "a.TXT", "chunks": [{"index": 0, "content": "hi", "word_count": 1}]}))
    (tmp_path / "m2" / "chunks" / "bad.json").write_text("{")
    got = drives.read_excavations(spark, str(tmp_path))
    assert sorted((r["machine"], r["file_id"], r["chunks"][0]["content"]) for r in got.collect()) == [("m1", "f1", "hi"), ("m2", "f2", "hi")]
    assert [r["machine"] for r in drives.find_excavations(spark, str(tmp_path)).collect()] == ["m1", "m2"]
    log = spark.createDataFrame([("m1", "completed")], "excavation_id string, status string")
    files, chunks, _ = drives.synced_rows(drives.not_synced(got, log))
    assert [(r["id"], r["extension"], r["status"]) for r in files.collect()] == [("f2", "txt", "synced")] and chunks.count() == 1


def test_text_of_bytes(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(drives.text_of(F.col("b"))).collect()] == ["é", "é", ""]


def test_formats_as_in_python(spark):
    n = [0, 1, 59, 60, 90, 150, 3599, 3600, 7265, 20000]
    rows = spark.createDataFrame([(x,) for x in n], "s long").select(S.uptime(F.col("s")).alias("u"), S.elapsed(F.col("s")).alias("e"), S.bar(F.col("s"), F.lit(7200), 10).alias("b")).collect()
    assert [r["u"] for r in rows] == [f"{x:.0f}s" if x < 60 else f"{x / 60:.0f}m" if x < 3600 else f"{x // 3600}h {x % 3600 // 60}m" for x in n]
    assert [r["e"] for r in rows] == [f"{x:.0f}s" if x < 60 else f"{x / 60:.1f}m" if x < 3600 else f"{x / 3600:.1f}h" for x in n]
    assert [r["b"].count("█") for r in rows] == [min(10, int(x / 7200 * 10)) for x in n]
    one = spark.range(1).select(S.elapsed(F.lit(None).cast("long")), S.bar(F.lit(1), F.lit(0), 4), S.sparkline(F.array(*map(F.lit, [5, 1, 9])), 5), S.sparkline(F.array(*map(F.lit, range(30))), 3)).first()
    assert list(one) == ["...", "░░░░", "▄▁█▁▁", "▇▇█"]


def test_times_and_paths(spark):
    now = F.timestamp_seconds(F.lit(7))
    iso = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+01:00", "nonsense", None]
    got = spark.createDataFrame([(x,) for x in iso], "t string").select(F.unix_timestamp(S.parse_iso(F.col("t"), now)).alias("s")).collect()
    assert [r["s"] for r in got] == [1704067200, 1704063600, 7, 7]
    epoch = ["1.5", "0", "x", None, "NaN", "1e300"]
    got = spark.createDataFrame([(x,) for x in epoch], "t string").select(F.unix_micros(S.parse_epoch(F.col("t"), now)).alias("s")).collect()
    assert [r["s"] for r in got] == [1_500_000] + [7_000_000] * 5
    config = json.dumps({"a": [{"b": {"c": 1}}], "d": {"0": "zero"}})
    row = spark.createDataFrame([(config,)], "c string").select(*[S.nested_get(F.col("c"), p).alias(f"x{i}") for i, p in enumerate(("a.0.b.c", "d.0", "a.5.b", "a.x"))]).first()
    assert list(row) == ["1", "zero", None, None]


def test_technology_terms(spark):
    text = "Python, python3 and my_python; GitHub git Git-hub éAPI API"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(S.tech_places(F.col("t"))).alias("x")).select("x.*").collect()
    want = []
    from sediment.functions.vocabulary import TECH_TERMS

    for term in TECH_TERMS:
        low, at = text.lower(), -1
        while (at := low.find(term.lower(), at + 1)) >= 0:
            before, after = text[at - 1 : at] if at else "", text[at + len(term) : at + len(term) + 1]
            if not before.isalnum() and not after.isalnum():
                want.append((at, text[at : at + len(term)]))
    assert [(r["start"], r["value"]) for r in got] == want and len(want) == 6


def test_queue(spark, tmp_path):
    q = jobs.Queue(spark, str(tmp_path))
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    row = lambda i, kind, status, p, s: (i, kind, status, p, "{}", at(s), None, None, None)
    q.enqueue(spark.createDataFrame([row("a", "x", "pending", 3, 1), row("b", "x", "pending", 1, 2), row("c", "y", "pending", 1, 1), row("d", "x", "running", 1, 0)], jobs.JOB))
    again = jobs.Queue(spark, str(tmp_path))
    assert [r["job_id"] for r in jobs.waiting(again.jobs()).collect()] == ["c", "b", "a"]
    seen = []
    assert again.work({"x": lambda df: seen.extend(sorted(r["job_id"] for r in df.collect()))}, F.timestamp_seconds(F.lit(9)), batch=2) == 3
    got = {r["job_id"]: (r["status"], r["error"]) for r in q.jobs().collect()}
    assert seen == ["b", "a"] and got == {"a": ("completed", None), "b": ("completed", None), "c": ("failed", "no handler for y"), "d": ("running", None)}
    q.cleanup(F.lit("2024-01-30").cast("timestamp"))
    assert [r["job_id"] for r in q.jobs().collect()] == ["d"]


def test_schedules(spark):
    times = [datetime(2024, 1, 1 + i // 24, i % 24, i * 7 % 60) for i in range(24 * 14)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    rows = df.select("t", jobs.due(F.col("t"), "*/7 1-5,20 * * 1,3").alias("a"), jobs.due(F.col("t"), "0 0 13 * 5").alias("b")).collect()
    assert [r["a"] for r in rows] == [t.minute % 7 == 0 and t.hour in (1, 2, 3, 4, 5, 20) and (t.weekday() + 1) % 7 in (1, 3) for t in times]
    assert [r["b"] for r in rows] == [t.minute == 0 and t.hour == 0 and (t.day == 13 or t.weekday() == 4) for t in times]


def test_graph_export(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "t", 'say "hi"\n')], "id string, type string, label string")
    catalog.export_graph(nodes, f"{tmp_path}/y", "yaml")
    import yaml

    text = "".join(p.read_text() for p in sorted((tmp_path / "y").glob("part-*")))
    assert yaml.safe_load(text) == [{"id": "1", "type": "t", "label": 'say "hi"\n'}]
