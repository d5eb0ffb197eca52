"""Small image and audio files with given tags, as bytes: what fills an archive with files of known content."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .image_bytes import EXIF, EXIF_AT, FORMATS, GPS, GPS_AT, MAIN, SIZES

# The TIFF type that a tag is written with, where it isn't a text.
TYPES = {"width": 4, "height": 4, "orientation": 3, "iso": 3, "flash": 3, "color_space": 3, "white_balance": 3, "exposure": 5, "f_number": 5, "focal": 5, "exposure_bias": 10, "latitude": 5, "longitude": 5, "altitude": 5, "altitude_ref": 1}


def ratio(x: float) -> tuple[int, int]:
    """A fraction whose quotient is x, of a denominator up to 10,000, or the nearest such."""
    n, d = x.as_integer_ratio()
    if d < 1 << 31 and abs(n) < 1 << 31:
        return n, d
    from fractions import Fraction

    f = Fraction(x).limit_denominator(10_000)
    return f.numerator, f.denominator


def directory(tags: list[tuple[int, int, object]], at: int, order: str) -> bytes:
    """A TIFF directory that stands at a place, with its longer values behind it."""
    head, more = struct.pack(order + "H", len(tags)), b""
    behind = at + 2 + 12 * len(tags) + 4
    for tag, kind, value in sorted(tags):
        if kind == 2:
            raw, count = value.encode() + b"\0", len(value.encode()) + 1
        else:
            values = value if isinstance(value, (list, tuple)) else [value]
            flat = [p for v in values for p in ratio(float(v))] if kind in (5, 10) else [int(v) for v in values]
            raw, count = struct.pack(order + FORMATS[kind] * len(values), *flat), len(values)
        assert len(raw) == SIZES[kind] * count
        if len(raw) > 4:
            head += struct.pack(order + "HHII", tag, kind, count, behind + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            head += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return head + struct.pack(order + "I", 0) + more


def tiff(tags: dict, order: str = "<") -> bytes:
    """A TIFF structure of tags by name: a first directory, and an EXIF and a GPS directory if some tags belong there."""
    of = lambda table: [(t, TYPES.get(name, 2), tags[name]) for t, name in table.items() if tags.get(name) is not None]
    main, exif, gps = of(MAIN), of(EXIF), of(GPS)
    pointers = [(p, 4, 0) for p, some in ((EXIF_AT, exif), (GPS_AT, gps)) if some]
    size = len(directory(main + pointers, 8, order))
    blocks, at = [], 8 + size
    for p, some in ((EXIF_AT, exif), (GPS_AT, gps)):
        if some:
            pointers = [(p, 4, at) if x[0] == p else x for x in pointers]
            blocks.append(directory(some, at, order))
            at += len(blocks[-1])
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + directory(main + pointers, 8, order) + b"".join(blocks)


def jpeg(width: int, height: int, exif: bytes = b"") -> bytes:
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    tags = segment(0xE1, b"Exif\0\0" + exif) if exif else b""
    return b"\xff\xd8" + tags + segment(0xDB, bytes(65)) + segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\0") + segment(0xDA, bytes(6)) + b"\xff\xd9"


def png(width: int, height: int, exif: bytes = b"") -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    tags = chunk(b"eXIf", exif) if exif else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + tags + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def image(tags: dict, k: int) -> bytes:
    """An image of k's format and byte order."""
    order, width, height = "<>"[k % 2], 100 + k % 900, 50 + k % 700
    if k % 3 == 0:
        return jpeg(width, height, tiff(tags, order))
    return png(width, height, tiff(tags, order)) if k % 3 == 1 else tiff(tags | {"width": width, "height": height}, order)


def id3(tags: dict, version: int = 4) -> bytes:
    """An ID3v2.3 block in UTF-16, or one of version 2.4 in UTF-8."""
    frames = b""
    seven = lambda n: bytes(n >> 7 * i & 0x7F for i in (3, 2, 1, 0))
    for key, name in (("TIT2", "title"), ("TPE1", "artist"), ("TALB", "album"), ("TDRC" if version == 4 else "TYER", "year"), ("TCON", "genre"), ("TRCK", "track")):
        if tags.get(name) is not None:
            body = b"\x03" + tags[name].encode() if version == 4 else b"\x01" + tags[name].encode("utf-16")
            frames += key.encode() + (seven(len(body)) if version == 4 else struct.pack(">I", len(body))) + b"\0\0" + body
    return b"ID3" + bytes([version, 0, 0]) + seven(len(frames)) + frames


def mp3(tags: dict, seconds: int, version: int = 4) -> bytes:
    """Tags and a first frame (48 kHz, 128 kbit/s, stereo) that tells how many there are."""
    head = b"\xff\xfb\x94\x00"
    first = (head + bytes(32) + b"Xing" + struct.pack(">II", 1, -(-seconds * 48000 // 1152))).ljust(384, b"\0")
    return id3(tags, version) + first + head.ljust(384, b"\0")


def comments(tags: dict) -> bytes:
    said = [f"{key}={tags[name]}".encode() for key, name in (("TITLE", "title"), ("artist", "artist"), ("ALBUM", "album"), ("DATE", "year"), ("GENRE", "genre"), ("TRACKNUMBER", "track")) if tags.get(name) is not None]
    return struct.pack("<I", 4) + b"none" + struct.pack("<I", len(said)) + b"".join(struct.pack("<I", len(x)) + x for x in said)


def flac(tags: dict, seconds: int, rate: int = 44100) -> bytes:
    stream = bytes(10) + (rate << 44 | 1 << 41 | 15 << 36 | seconds * rate).to_bytes(8, "big") + bytes(16)
    block = lambda kind, body: bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"fLaC" + block(0, stream) + block(0x84, comments(tags))


def ogg(tags: dict, seconds: int, rate: int = 44100) -> bytes:
    def page(position: int, body: bytes, number: int) -> bytes:
        sizes = bytes([255] * (len(body) // 255) + [len(body) % 255])
        return b"OggS\0\0" + struct.pack("<qIII", position, 7, number, 0) + bytes([len(sizes)]) + sizes + body

    return page(0, b"\x01vorbis" + struct.pack("<IBIiIi", 0, 2, rate, 0, 112000, 0) + b"\xb8\x01", 0) + page(0, b"\x03vorbis" + comments(tags) + b"\x01", 1) + page(seconds * rate, b"x", 2)


def mp4(tags: dict, seconds: int) -> bytes:
    atom = lambda kind, *body: struct.pack(">I", 8 + len(b"".join(body))) + kind + b"".join(body)
    data = lambda kind, raw: atom(b"data", struct.pack(">II", kind, 0), raw)
    items = [atom(k, data(1, tags[name].encode())) for k, name in ((b"\xa9nam", "title"), (b"\xa9ART", "artist"), (b"\xa9alb", "album"), (b"\xa9day", "year"), (b"\xa9gen", "genre")) if tags.get(name) is not None]
    if tags.get("track") is not None:
        number, _, of = tags["track"].partition("/")
        items.append(atom(b"trkn", data(0, struct.pack(">HHHH", 0, int(number) & 0xFFFF, int(of or 0), 0))))
    sample = atom(b"mp4a", bytes(16), struct.pack(">HHI", 2, 16, 0), struct.pack(">I", 44100 << 16))
    track = atom(b"trak", atom(b"mdia", atom(b"minf", atom(b"stbl", atom(b"stsd", struct.pack(">II", 0, 1), sample)))))
    meta = atom(b"udta", atom(b"meta", bytes(4), atom(b"ilst", *items)))
    return atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"moov", atom(b"mvhd", bytes(12), struct.pack(">II", 1000, 1000 * seconds), bytes(80)), track, meta)


def audio(tags: dict, k: int) -> bytes:
    """An audio file of k's format."""
    seconds = tags["seconds"]
    made = [lambda: mp3(tags, seconds, 4), lambda: flac(tags, seconds), lambda: ogg(tags, seconds), lambda: mp4(tags, seconds), lambda: mp3(tags, seconds, 3)]
    return made[k % len(made)]()


def files_of(rows: DataFrame, tags: list[str], make: Callable[[dict, int], bytes]) -> DataFrame:
    """rows (with file_id) without the tags, and with the content of a file that make builds of them."""
    rest = rows.drop(*tags)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(t, k) for t, k in zip(b.select(tags).to_pylist(), b.column("file_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(made, pa.binary())], [*names, "content"])

    return rows.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("content", T.BinaryType())]))
