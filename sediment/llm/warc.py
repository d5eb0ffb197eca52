"""WARC archives: a writer with revisit records and a splittable reader of byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, new_path, table

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNK = 1 << 18
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string, at long"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) or of a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP head of its full payload but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def decide(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html (never null), refers_to: null for a response, else the page of the response.

    Of rows with equal payloads of at least min_revisit_bytes the one with the largest page_id is the
    response (of rows that tie on it, the one read last); a null page_id is smaller than any other and
    a group without any page_id is all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("rid", F.monotonically_increasing_id())
    size = F.octet_length("html")
    rows = rows.withColumn("same", F.when(size >= min_revisit_bytes, F.concat_ws("/", F.sha1("html"), size)))
    groups = rows.filter("same is not null").groupBy("same").agg(F.max(F.struct("page_id", "rid")).alias("w"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1").select("same", F.col("w.page_id").alias("last_page"), F.col("w.rid").alias("last_rid"), "n"), "payloads")
    out = attach(rows, "same", groups, "n", F.xxhash64("rid"))
    return out.select("page_id", "url", "html", F.when(F.col("last_rid") != F.col("rid"), F.col("last_page")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, max_file_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to .warc.gz files in folder; returns archive, bytes, records.

    Each task writes files of its own names; only those of tasks that succeeded are in the returned (and
    written) list, so a task that ran twice does no harm. A null html is an empty payload. Other columns
    are ignored. No rows: an empty list. A payload of any length is written whole; its task holds it a few times over.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        done, out, name, n = [], None, "", 0
        for b in batches:
            for page_id, url, html, to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member(page_id, url, html.encode(), to, date))
                n += 1
                if out.tell() >= max_file_bytes:
                    done.append((name, out.tell(), n))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, out.tell(), n))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in done]), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["archive", "bytes", "records"])

    return materialize(decide(pages, min_revisit_bytes).mapInArrow(write, "archive string, bytes long, records long"), "archives")


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of one inflated record; None unless it is one."""
    if not data.startswith(b"WARC/1.") or (cut := data.find(b"\r\n\r\n")) < 0:
        return None
    lines = data[:cut].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = head.get("content-length", "")
    return (head, data[cut + 4 : cut + 4 + int(size)]) if size.isdigit() and "warc-type" in head else None


def records_in(f, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose gzip member starts in [start, end) of the open file f; the last may reach beyond end.

    A member that begins as a record and then breaks off with the file raises an error.
    """
    f.seek(start)
    data = bytearray(f.read(end - start + CHUNK))
    at = 0
    while at < end - start:
        at = data.find(MAGIC, at)
        if not 0 <= at < end - start:
            return
        inflate, parts, fed, good, cut = zlib.decompressobj(31), [], at, True, False
        while good and not inflate.eof:
            if fed == len(data):
                more = f.read(4 * CHUNK)
                if not more:
                    good, cut = False, b"".join(parts[:2])[:7] == b"WARC/1."
                    break
                data += more
            piece = bytes(data[fed : fed + (1 << 12 if fed == at else 1 << 16)])
            fed += len(piece)
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error:
                good = False
            good = good and (len(parts) > 1 or b"WARC/1."[: len(parts[0])] == parts[0][:7])  # else compressed bytes that look like a member
        if cut:
            raise ValueError(f"the record at {start + at} breaks off at the end of the file")
        found = parse(b"".join(parts)) if good else None
        if found is None:
            at += 1
            continue
        yield start + at, *found
        at = fed - len(inflate.unused_data)


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 1 << 23, payloads: bool = True) -> DataFrame:
    """Read archives (archive, bytes) by byte ranges; one row per record (see RECORD).

    A task searches its range for gzip magic, accepts a candidate only if it inflates to a WARC header,
    and owns the records that start inside its range. The payload's digest is computed again; a record that
    doesn't match its header raises an error, one whose header names no SHA-1 digest is taken as it is. The payload
    of an HTTP record is its body, that of any other (warcinfo, metadata ...) its block; a revisit has the digest of its header
    and the length that its HTTP head tells, null without one. Bytes between records that are no record are
    skipped; a record that breaks off at the end of an archive raises an error. A task holds its range and the
    longest record of it. No archives give no rows.
    """
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    ranges = archives.filter("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(4096, -(-total // split_bytes))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, size, start in zip(*(b.column(c).to_pylist() for c in ("archive", "bytes", "start"))):
                store, path = open_store(archive)
                rows: list[tuple] = []
                with store.open_input_file(path) as f:
                    for at, head, block in records_in(f, start, min(size, start + split_bytes)):
                        kind, told = head["warc-type"], head.get("warc-payload-digest", "")
                        told = told[5:] if told[:5].lower() == "sha1:" else ""
                        http, _, payload = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
                        n = len(payload)
                        if kind == "revisit":
                            size_of = re.search(rb"(?i)\ncontent-length: *(\d+)", http)
                            n, digest = int(size_of[1]) if size_of else None, told or None
                        else:
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if told and digest != told.upper():
                                raise ValueError(f"digest differs in {archive} at {at}")
                        num = lambda k, head=head: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None
                        rows.append((num("x-page-id"), head.get("warc-target-uri"), n, digest, kind, num("x-refers-to-page-id"), payload if payloads else None, archive, at))
                        if len(rows) >= 512:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return ranges.mapInArrow(read, RECORD)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of pages through WARC archives in the shared folder."""
    archives = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
