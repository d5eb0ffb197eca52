import base64
import gzip
import hashlib

import pyarrow.fs as fs
import pytest

from sediment.llm import warc


def rows_of(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rid long, same string")
    import tempfile

    archives = warc.write_warc(pages, tempfile.mkdtemp(), **options)
    return archives, pages


def test_round_trip_with_small_splits(spark):
    texts = {1: "a" * 50_000, 2: "é<p>", 3: "é<p>", 4: None, 5: "", 6: "b\r\n\r\nWARC/1.1\r\n\x1f\u008b"}
    archives, _ = rows_of(spark, [(k, f"http://x/{k}", v, 0, "clash") for k, v in texts.items()], max_file_bytes=500)
    got = {r["page_id"]: r for r in warc.read_warc(spark, archives, split_bytes=97).collect()}
    assert set(got) == set(texts)
    for k, v in texts.items():
        data = (v or "").encode()
        assert got[k]["payload_bytes"] == len(data)
        assert got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got[k]["record_type"] == "response":
            assert got[k]["payload"] == data
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (2, 3, 4, 5)] == [("revisit", 3), ("response", None), ("revisit", 5), ("response", None)]


def test_repeated_rows_and_null_ids(spark):
    archives, _ = rows_of(spark, [(7, None, "x", 0, ""), (7, None, "x", 0, ""), (None, None, "x", 0, ""), (None, "u", "y", 0, ""), (None, "u", "y", 0, "")])
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, archives).collect())
    assert got == [("7", "response", None), ("7", "revisit", 7), ("None", "response", None), ("None", "response", None), ("None", "revisit", 7)]


def test_smallest_payload_that_is_revisited(spark):
    archives, _ = rows_of(spark, [(1, None, "abc", 0, ""), (2, None, "abc", 0, ""), (3, None, "abcd", 0, ""), (4, None, "abcd", 0, "")], min_revisit_bytes=4)
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.read_warc(spark, archives).collect() if r["refers_to"]) == [(3, 4)]


def test_no_pages(spark):
    archives, _ = rows_of(spark, [])
    assert warc.read_warc(spark, archives).count() == 0


def test_bytes_between_records_are_skipped(spark, tmp_path):
    data = b"junk\x1f\x8b\x08junk" + warc.member(1, "u", b"one", None, "d") + b"\x1f\x8b\x08" + warc.member(2, "u", b"two", None, "d")
    (tmp_path / "a.warc.gz").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as f:
        whole = [(at, head["x-page-id"]) for at, head, _ in warc.records_in(f, 0, len(data))]
        split = [(at, head["x-page-id"]) for i in range(0, len(data), 13) for at, head, _ in warc.records_in(f, i, min(i + 13, len(data)))]
    assert [x[1] for x in whole] == ["1", "2"] and split == whole


def test_records_of_other_writers(spark, tmp_path):
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nX-Page-Id: none\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody!\r\n\r\n"
    revisit = b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    big = warc.member(5, "u", b"0123456789abcdef" * 400_000, None, "d")
    data = b"".join(gzip.compress(x) for x in (info, bare, revisit)) + big
    (tmp_path / "a.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "archive string, bytes long")
    got = [(r["record_type"], r["payload_bytes"], r["page_id"], r["payload_digest"]) for r in warc.read_warc(spark, archives, split_bytes=100).orderBy("at").collect()]
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert got == [("warcinfo", 9, None, digest(b"software:")), ("response", 5, None, digest(b"body!")), ("revisit", None, None, None), ("response", 6_400_000, 5, digest(b"0123456789abcdef" * 400_000))]
    (tmp_path / "b.warc.gz").write_bytes(data[:-50])
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.warc.gz")) as f, pytest.raises(ValueError, match="breaks off"):
        list(warc.records_in(f, 0, len(data)))
