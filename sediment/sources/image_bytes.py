"""Images from their bytes: format, size and EXIF tags of JPEG, PNG, TIFF, WebP, GIF and BMP files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V

# Bytes of a value of each TIFF type, and its struct format (rationals are read as two numbers).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
# Tags of the first directory, of the EXIF and of the GPS directory, with the columns they go to.
MAIN = {0x100: "width", 0x101: "height", 0x10F: "make", 0x110: "model", 0x112: "orientation", 0x131: "software", 0x132: "modified"}
EXIF = {0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x9004: "digitized", 0x9204: "exposure_bias", 0x9209: "flash", 0x920A: "focal", 0xA001: "color_space", 0xA403: "white_balance", 0xA434: "lens"}
GPS = {1: "latitude_ref", 2: "latitude", 3: "longitude_ref", 4: "longitude", 5: "altitude_ref", 6: "altitude"}
EXIF_AT, GPS_AT = 0x8769, 0x8825

FOUND = (
    "format string, width int, height int, make string, model string, lens string, software string, iso int, f_number double, exposure double, focal double, exposure_bias double, flash int, "
    "taken string, modified string, digitized string, orientation int, color_space int, white_balance int, latitude array<double>, latitude_ref string, longitude array<double>, longitude_ref string, altitude double, altitude_ref int, error string"
)
KINDS = dict(x.split(" ") for x in FOUND.split(", "))


class Broken(ValueError):
    """A file that isn't what its first bytes say."""


def part(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise Broken("the file breaks off")
    return data[at : at + size]


def numbers(data: bytes, at: int, form: str) -> tuple:
    return struct.unpack(form, part(data, at, struct.calcsize(form)))


def directory(data: bytes, at: int, order: str) -> dict[int, list | str]:
    """The entries of a TIFF directory: a text, or a list of numbers; a rational without a denominator is None. Values that lie outside the file are left out."""
    out: dict[int, list | str] = {}
    (count,) = numbers(data, at, order + "H")
    for i in range(count):
        tag, kind, n = numbers(data, at + 2 + 12 * i, order + "HHI")
        if kind not in SIZES:
            continue
        place = at + 2 + 12 * i + 8
        if SIZES[kind] * n > 4:
            (place,) = numbers(data, place, order + "I")
        if place + SIZES[kind] * n > len(data):
            continue
        raw = part(data, place, SIZES[kind] * n)
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind == 7:
            out[tag] = list(raw)
        else:
            got = struct.unpack(order + FORMATS[kind] * n, raw)
            out[tag] = [a / b if b else None for a, b in zip(got[::2], got[1::2])] if kind in (5, 10) else list(got)
    return out


def tiff(data: bytes) -> dict:
    """The wanted tags of a TIFF structure: its first directory, and the EXIF and GPS directories that this one points to."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise Broken("no TIFF header")
    first = directory(data, numbers(data, 4, order + "I")[0], order)
    out = {name: first[t] for t, name in MAIN.items() if t in first}
    for pointer, wanted in ((EXIF_AT, EXIF), (GPS_AT, GPS)):
        if isinstance(first.get(pointer), list) and first[pointer]:
            try:
                more = directory(data, first[pointer][0], order)
            except Broken:
                continue  # the other tags stand
            out |= {name: more[t] for t, name in wanted.items() if t in more}
    return out


def exif(data: bytes) -> dict:
    """The tags of an EXIF block inside another format; its size of the picture is not the file's own. A broken block has none."""
    try:
        return {k: v for k, v in tiff(data).items() if k not in ("width", "height")}
    except Broken:
        return {}


def jpeg(data: bytes) -> dict:
    out, at = {"format": "JPEG"}, 2
    while True:
        mark, kind = numbers(data, at, ">BB")
        if mark != 0xFF:
            raise Broken("no JPEG marker where one is due")
        if kind == 0xFF:  # a fill byte
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        if kind in (0xD9, 0xDA):  # the end, or the picture's data
            break
        (size,) = numbers(data, at + 2, ">H")
        body = part(data, at + 4, size - 2)
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            out = exif(body[6:]) | out
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = numbers(body, 1, ">HH")
        at += 2 + size
    if "width" not in out:
        raise Broken("no JPEG frame")
    return out


def png(data: bytes) -> dict:
    out, at = {"format": "PNG"}, 8
    while True:
        size, kind = numbers(data, at, ">I4s")
        body = part(data, at + 8, size)
        if kind == b"IHDR":
            out["width"], out["height"] = numbers(body, 0, ">II")
        elif kind == b"eXIf":
            out = exif(body) | out
        elif kind == b"IEND":
            break
        at += 12 + size
    if "width" not in out:
        raise Broken("no PNG header")
    return out


def webp(data: bytes) -> dict:
    out, at, end = {"format": "WEBP"}, 12, 8 + numbers(data, 4, "<I")[0]
    while at + 8 <= end:
        kind, size = numbers(data, at, "<4sI")
        body = part(data, at + 8, size)
        if kind == b"VP8X":
            out["width"], out["height"] = (1 + int.from_bytes(part(body, k, 3), "little") for k in (4, 7))
        elif kind == b"VP8 " and "width" not in out:
            out["width"], out["height"] = (x & 0x3FFF for x in numbers(body, 6, "<HH"))
        elif kind == b"VP8L" and "width" not in out:
            (bits,) = numbers(body, 1, "<I")
            out["width"], out["height"] = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"EXIF":
            out = exif(body.removeprefix(b"Exif\0\0")) | out
        at += 8 + size + size % 2
    return out


def gif(data: bytes) -> dict:
    width, height = numbers(data, 6, "<HH")
    return {"format": "GIF", "width": width, "height": height}


def bmp(data: bytes) -> dict:
    width, height = numbers(data, 18, "<ii")
    return {"format": "BMP", "width": width, "height": abs(height)}


def metadata(data: bytes | None) -> dict:
    """What is known of an image; error says why nothing is."""
    data = data or b""
    readers = [(b"\xff\xd8", jpeg), (b"\x89PNG\r\n\x1a\n", png), (b"II*\0", lambda d: {"format": "TIFF"} | tiff(d)), (b"MM\0*", lambda d: {"format": "TIFF"} | tiff(d)), (b"GIF87a", gif), (b"GIF89a", gif), (b"BM", bmp)]
    reader = next((r for magic, r in readers if data.startswith(magic)), webp if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None)
    if reader is None:
        return {"error": "no image format is known for these bytes" if data else "the file is empty"}
    try:
        return typed(reader(data))
    except (Broken, struct.error) as e:
        return {"error": str(e)}


def typed(found: dict) -> dict:
    """Values as their columns' types; others, and texts where numbers are due, are left out."""
    out = {}
    for name, value in found.items():
        kind = KINDS[name]
        if kind == "string":
            out[name] = value if isinstance(value, str) else None
        elif kind == "array<double>":
            out[name] = [None if x is None else float(x) for x in value] if isinstance(value, list) else None
        else:
            one = value if isinstance(value, int) else value[0] if isinstance(value, list) and value else None
            out[name] = None if one is None else float(one) if kind == "double" else int(one)
    return {k: v for k, v in out.items() if not (KINDS[k] == "int" and v is not None and abs(v) >= 1 << 31)}


def described(files: DataFrame) -> DataFrame:
    """files (with content, binary), without content, with the columns of FOUND: one row per file, broken ones with an error."""
    schema = T.StructType.fromDDL(FOUND)
    rest = files.drop("content", *schema.fieldNames())
    names, kinds = rest.columns, [f.dataType for f in schema]
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [metadata(x.as_py()) for x in b.column("_content")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array([m.get(f) for m in found], arrow[k.simpleString()]) for f, k in zip(schema.fieldNames(), kinds)]], [*names, *schema.fieldNames()])

    return files.select(*names, F.col("content").alias("_content")).mapInArrow(run, T.StructType([*rest.schema.fields, *schema.fields]))


def read(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, file_hash (MD5) and the columns of FOUND for the images below a folder."""
    names = "(" + "|".join(V.EXTRACTORS["image"]) + ")"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.lower("path").rlike(rf"\.{names}$"))
    return described(files.select("path", F.col("length").alias("size_bytes"), F.md5("content").alias("file_hash"), "content"))
