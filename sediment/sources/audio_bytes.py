"""Audio files from their bytes: tags, duration and technical data of MP3, FLAC, Ogg, MP4, WAV and AIFF files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from .image_bytes import Broken, numbers, part

FOUND = "format string, title string, artist string, album string, year string, genre string, track string, seconds double, sample_rate int, channels int, bitrate int, error string"

# The names of the wanted tags in each format.
ID3 = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TALB": "album", "TAL": "album", "TDRC": "year", "TYER": "year", "TYE": "year", "TCON": "genre", "TCO": "genre", "TRCK": "track", "TRK": "track"}
COMMENTS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "DATE": "year", "GENRE": "genre", "TRACKNUMBER": "track"}
ATOMS = {b"\xa9nam": "title", b"\xa9ART": "artist", b"\xa9alb": "album", b"\xa9day": "year", b"\xa9gen": "genre"}
INFO = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"ICRD": "year", b"IGNR": "genre", b"ITRK": "track"}
# kbit/s of MPEG audio by (version 1 or not, layer), and Hz by version.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def syncsafe(raw: bytes) -> int:
    """A number of seven bits a byte."""
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(reversed(raw)))


def id3_text(raw: bytes) -> str:
    """The first string of a text frame, by the encoding that its first byte says."""
    if not raw:
        return ""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(name, "replace").split("\0")[0].strip("﻿")


def id3v2(data: bytes) -> tuple[dict, int]:
    """The tags of a leading ID3v2 block, and where it ends."""
    if data[:3] != b"ID3":
        return {}, 0
    head = part(data, 0, 10)
    version, flags, size = head[3], head[5], syncsafe(head[6:])
    body, end = part(data, 10, size), 10 + size + (10 if flags & 0x10 else 0)
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:  # an extended header; from version 4 its size holds itself
        at = syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    out: dict[str, str] = {}
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        key = body[at : at + (3 if version == 2 else 4)].decode("latin-1")
        raw = body[at + 3 : at + 6] if version == 2 else body[at + 4 : at + 8]
        n = syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        frame = body[at + head : at + head + n]
        if version == 4 and (body[at + 9] & 0x02 or flags & 0x80):
            frame = frame.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[at + 9] & 0x01:  # the length before it was packed
            frame = frame[4:]
        if key in ID3 and ID3[key] not in out:
            out[ID3[key]] = id3_text(frame)
        at += head + n
    return out, end


def id3v1(data: bytes) -> dict:
    """The tags of the last 128 bytes; a zero before the last comment byte marks a track number."""
    tail = data[-128:]
    if len(tail) < 128 or tail[:3] != b"TAG":
        return {}
    text = lambda a, b: tail[a:b].split(b"\0")[0].decode("latin-1").strip()
    out = {"title": text(3, 33), "artist": text(33, 63), "album": text(63, 93), "year": text(93, 97)}
    if tail[125] == 0 and tail[126]:
        out["track"] = str(tail[126])
    return {k: v for k, v in out.items() if v}


def frame_of(data: bytes, at: int) -> dict | None:
    """The MPEG audio frame at a place, null if there is none."""
    if at + 4 > len(data):
        return None
    head = int.from_bytes(data[at : at + 4], "big")
    version, layer, rate, hz = head >> 19 & 3, 4 - (head >> 17 & 3), head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    kbit, rate_hz, mono = BITRATES[version == 3, layer][rate], RATES[version][hz], (head >> 6 & 3) == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbit // rate_hz + (head >> 9 & 1)) * 4 if layer == 1 else samples * 125 * kbit // rate_hz + (head >> 9 & 1)
    return {"bitrate": 1000 * kbit, "sample_rate": rate_hz, "channels": 1 if mono else 2, "samples": samples, "length": length, "side": (17 if mono else 32) if version == 3 else (9 if mono else 17)}


def mp3(data: bytes) -> dict:
    """Tags, and the duration by the count of frames that a first frame tells (Xing, Info, VBRI), else by the bitrate of the first."""
    tags, at = id3v2(data)
    tags = id3v1(data) | tags
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    while True:
        at = data.find(b"\xff", at, end)
        if at < 0:
            raise Broken("no MPEG audio frame")
        frame = frame_of(data, at)
        if frame and (at + frame["length"] >= end or frame_of(data, at + frame["length"])):
            break
        at += 1
    told, count = at + 4 + frame["side"], 0
    if data[told : told + 4] in (b"Xing", b"Info"):
        flags, count = struct.unpack(">II", part(data, told + 4, 8))
        count = count if flags & 1 else 0
    elif data[at + 36 : at + 40] == b"VBRI":
        (count,) = numbers(data, at + 36 + 14, ">I")
    seconds = count * frame["samples"] / frame["sample_rate"] if count else 8 * (end - at) / frame["bitrate"]
    if count and seconds:
        frame["bitrate"] = int(8 * (end - at) / seconds)
    return {"format": "MP3", **tags, "seconds": seconds, **{k: frame[k] for k in ("sample_rate", "channels", "bitrate")}}


def comments(raw: bytes) -> dict:
    """The tags of a block of comments KEY=value, keys in either case; of equal keys the first."""
    (n,) = numbers(raw, 0, "<I")
    (count,) = numbers(raw, 4 + n, "<I")
    at, out = 8 + n, {}
    for _ in range(count):
        (n,) = numbers(raw, at, "<I")
        key, _, value = part(raw, at + 4, n).decode("utf-8", "replace").partition("=")
        if key.upper() in COMMENTS:
            out.setdefault(COMMENTS[key.upper()], value)
        at += 4 + n
    return out


def flac(data: bytes) -> dict:
    out, at, last = {"format": "FLAC"}, id3v2(data)[1] + 4, False
    while not last:
        kind, size = data[at] if at < len(data) else 0xFF, int.from_bytes(part(data, at + 1, 3), "big")
        body, last = part(data, at + 4, size), bool(kind & 0x80)
        if kind & 0x7F == 0:
            bits = int.from_bytes(part(body, 10, 8), "big")
            out["sample_rate"], out["channels"], samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
            if out["sample_rate"] and samples:
                out["seconds"] = samples / out["sample_rate"]
                out["bitrate"] = int(8 * len(data) / out["seconds"])
        elif kind & 0x7F == 4:
            out = comments(body) | out
        at += 4 + size
    return out


def ogg(data: bytes) -> dict:
    """Of the first stream: its first two packets, and its duration by the last page's position."""
    out, at, stream, packets, open_, last = {"format": "OGG"}, 0, None, [], b"", 0
    while at + 27 <= len(data):
        if data[at : at + 4] != b"OggS":
            raise Broken("no Ogg page where one is due")
        position, serial, count = struct.unpack("<q", data[at + 6 : at + 14])[0], data[at + 14 : at + 18], data[at + 26]
        sizes = part(data, at + 27, count)
        body = part(data, at + 27 + count, sum(sizes))
        at += 27 + count + len(body)
        stream = serial if stream is None else stream
        if serial != stream:
            continue
        last = max(last, position)
        k = 0
        for n in sizes if len(packets) < 2 else b"":
            open_ += body[k : k + n]
            k += n
            if n < 255:
                packets.append(open_)
                open_ = b""
    if len(packets) < 2:
        raise Broken("no Ogg headers")
    if packets[0][:7] == b"\x01vorbis":
        out["channels"], out["sample_rate"], _, rate = numbers(packets[0], 11, "<BIiI")
        out |= comments(packets[1][7:])
        out["seconds"], out["bitrate"] = last / out["sample_rate"] if out["sample_rate"] else None, rate
    elif packets[0][:8] == b"OpusHead":
        out["channels"], skip = numbers(packets[0], 9, "<BH")
        out |= comments(packets[1][8:]) | {"sample_rate": 48000, "seconds": max(0, last - skip) / 48000}
    else:
        raise Broken("a kind of Ogg stream that isn't known")
    return out


def atoms(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The atoms between two places: kind, and where the body begins and ends."""
    while at + 8 <= end:
        size, kind = numbers(data, at, ">I4s")
        head = 8
        if size == 1:
            (size,), head = numbers(data, at + 8, ">Q"), 16
        stop = end if size == 0 else at + size
        if size and size < head or stop > end:
            raise Broken("an atom breaks off")
        yield kind, at + head, stop
        at = stop


def inside(data: bytes, path: tuple[bytes, ...], at: int, end: int) -> tuple[int, int] | None:
    """The body of the first atom on a path; what holds a version before its atoms is skipped over."""
    for kind, a, b in atoms(data, at, end):
        if kind == path[0]:
            if len(path) == 1:
                return a, b
            if found := inside(data, path[1:], a + (4 if kind == b"meta" else 8 if kind == b"stsd" else 0), b):
                return found
    return None


def mp4(data: bytes) -> dict:
    out, whole = {"format": "MP4"}, (0, len(data))
    if inside(data, (b"moov",), *whole) is None:
        raise Broken("no moov atom")
    if found := inside(data, (b"moov", b"mvhd"), *whole):
        scale, length = numbers(data, found[0] + 20, ">IQ") if numbers(data, found[0], "B") == (1,) else numbers(data, found[0] + 12, ">II")
        out["seconds"] = length / scale if scale else None
    if found := inside(data, (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"mp4a"), *whole):
        (out["channels"],), (rate,) = numbers(data, found[0] + 16, ">H"), numbers(data, found[0] + 24, ">I")
        out["sample_rate"] = rate >> 16
    if found := inside(data, (b"moov", b"udta", b"meta", b"ilst"), *whole):
        for kind, a, b in atoms(data, *found):
            value = inside(data, (b"data",), a, b)
            if value and kind in ATOMS:
                out[ATOMS[kind]] = data[value[0] + 8 : value[1]].decode("utf-8", "replace")
            elif value and kind == b"trkn":
                number, of = numbers(data, value[0] + 10, ">HH")
                out["track"] = f"{number}/{of}" if of else str(number)
    return out


def chunks(data: bytes, order: str) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a RIFF or FORM file: kind, place and size, cut at the file's end."""
    at = 12
    while at + 8 <= len(data):
        kind, size = numbers(data, at, order + "4sI")
        yield kind, at + 8, size
        at += 8 + size + size % 2


def wav(data: bytes) -> dict:
    out, a_second = {"format": "WAV"}, 0
    for kind, at, size in chunks(data, "<"):
        if kind == b"fmt ":
            _, out["channels"], out["sample_rate"], a_second = numbers(data, at, "<HHII")
            out["bitrate"] = 8 * a_second
        elif kind == b"data" and a_second:
            out["seconds"] = size / a_second
        elif kind == b"LIST" and data[at : at + 4] == b"INFO":
            for k, a, n in chunks(b" " * 12 + data[at + 4 : at + size], "<"):
                if k in INFO:
                    out[INFO[k]] = data[at + 4 + a - 12 : at + 4 + a - 12 + n].split(b"\0")[0].decode("utf-8", "replace")
    if "sample_rate" not in out:
        raise Broken("no format chunk")
    return out


def aiff(data: bytes) -> dict:
    out = {"format": "AIFF"}
    for kind, at, size in chunks(data, ">"):
        if kind == b"COMM":
            out["channels"], samples, bits, power, fraction = numbers(data, at, ">hIhHQ")
            out["sample_rate"] = int(fraction * 2.0 ** ((power & 0x7FFF) - 16383 - 63))
            out["seconds"] = samples / out["sample_rate"] if out["sample_rate"] else None
            out["bitrate"] = out["channels"] * bits * out["sample_rate"]
        elif kind in (b"NAME", b"AUTH"):
            out["title" if kind == b"NAME" else "artist"] = part(data, at, size).decode("utf-8", "replace")
        elif kind == b"ID3 ":
            out |= id3v2(part(data, at, size))[0]
    if "sample_rate" not in out:
        raise Broken("no COMM chunk")
    return out


def metadata(data: bytes | None) -> dict:
    """What is known of an audio file; error says why nothing is. Seconds are rounded to hundredths; empty tags are none."""
    data = data or b""
    try:
        start = id3v2(data)[1]
        if data[start : start + 4] == b"fLaC":
            found = flac(data)
        elif data[:4] == b"OggS":
            found = ogg(data)
        elif data[4:8] == b"ftyp":
            found = mp4(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WAVE":
            found = wav(data)
        elif data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
            found = aiff(data)
        elif data:
            found = mp3(data)
        else:
            raise Broken("the file is empty")
    except (Broken, struct.error, OverflowError) as e:
        return {"error": str(e)}
    if found.get("seconds") is not None:
        found["seconds"] = round(found["seconds"], 2)
    return {k: v for k, v in found.items() if v != "" and not (isinstance(v, int) and v >= 1 << 31)}


def described(files: DataFrame) -> DataFrame:
    """files (with content, binary), without content, with the columns of FOUND: one row per file, broken ones with an error."""
    schema = T.StructType.fromDDL(FOUND)
    rest = files.drop("content", *schema.fieldNames())
    names = rest.columns
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    kinds = [(f.name, arrow[f.dataType.simpleString()]) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [metadata(x.as_py()) for x in b.column("_content")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array([m.get(f) for m in found], k) for f, k in kinds]], [*names, *[f for f, _ in kinds]])

    return files.select(*names, F.col("content").alias("_content")).mapInArrow(run, T.StructType([*rest.schema.fields, *schema.fields]))


def read(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, file_hash (MD5) and the columns of FOUND for the audio files below a folder."""
    names = "(" + "|".join(V.EXTRACTORS["audio"]) + ")"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.lower("path").rlike(rf"\.{names}$"))
    return described(files.select("path", F.col("length").alias("size_bytes"), F.md5("content").alias("file_hash"), "content"))
