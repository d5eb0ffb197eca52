"""Images and audio files from hand-made bytes, and through a folder of files."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from sediment.sources import audio_bytes, image_bytes, media_files

# Hand-made: a little-endian TIFF block with make, an EXIF directory (exposure 1/250, f/2.8, ISO 400, bias -1/3) and a GPS one.
EXIF_BLOCK = bytes.fromhex(
    "49492a0008000000" "0300" "0f01020006000000" "32000000" "6987040001000000" "38000000" "2588040001000000" "86000000" "00000000"
    "43616e6f6e00"
    "0400" "9a82050001000000" "6e000000" "9d82050001000000" "76000000" "2788030001000000" "90010000" "04920a0001000000" "7e000000" "00000000"
    "01000000fa000000" "1c0000000a000000" "ffffffff03000000"
    "0600" "0100020002000000" "53000000" "0200050003000000" "d4000000" "0300020002000000" "57000000" "0400050003000000" "ec000000" "0500010001000000" "01000000" "0600050001000000" "04010000" "00000000"
    "21000000010000003300000001000000" "7b0c000064000000"
    "97000000010000000c00000001000000" "1e00000001000000"
    "7d00000002000000"
)
JPEG = bytes.fromhex("ffd8" "ffe1") + struct.pack(">H", len(EXIF_BLOCK) + 8) + b"Exif\0\0" + EXIF_BLOCK + bytes.fromhex("ffff" "c2" "000b" "08" "01e0" "0280" "01" "011100" "ffda" "0002")


def test_hand_made_jpeg():
    got = image_bytes.metadata(JPEG)
    assert (got["format"], got["width"], got["height"], got["make"], got["iso"]) == ("JPEG", 640, 480, "Canon", 400)
    assert (got["exposure"], got["f_number"]) == (1 / 250, 2.8) and got["exposure_bias"] == -1 / 3
    assert (got["latitude_ref"], got["latitude"], got["longitude_ref"], got["longitude"]) == ("S", [33.0, 51.0, 31.95], "W", [151.0, 12.0, 30.0])
    assert (got["altitude"], got["altitude_ref"]) == (62.5, 1)


def test_hand_made_png_gif_bmp_webp():
    png = bytes.fromhex("89504e470d0a1a0a" "0000000d49484452" "00000007" "00000005" "0800000000" "00000000" "0000000049454e44" "ae426082")
    assert image_bytes.metadata(png) == {"format": "PNG", "width": 7, "height": 5}
    assert image_bytes.metadata(b"GIF89a" + bytes.fromhex("0a001400") + bytes(3)) == {"format": "GIF", "width": 10, "height": 20}
    assert image_bytes.metadata(b"BM" + bytes(16) + struct.pack("<ii", 30, -40)) == {"format": "BMP", "width": 30, "height": 40}
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 10) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")
    assert image_bytes.metadata(webp) == {"format": "WEBP", "width": 300, "height": 200}
    lossless = b"RIFF" + struct.pack("<I", 18) + b"WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 15 | 8 << 14) + b"\0"
    assert image_bytes.metadata(lossless) == {"format": "WEBP", "width": 16, "height": 9}


TAGS = {"make": "Make é", "model": "M", "lens": "50mm", "software": "s", "iso": 6400, "f_number": 1.8, "exposure": 1 / 3200, "focal": 35.0, "exposure_bias": -0.5, "flash": 16, "taken": "2023:01:02 10:20:30", "modified": "2024:01:01 00:00:00", "digitized": "x", "orientation": 6, "color_space": 1, "white_balance": 0, "latitude": [1.0, 2.5, 3.25], "latitude_ref": "N", "longitude": [10.0, 0.0, 59.99], "longitude_ref": "E", "altitude": 12.75, "altitude_ref": 0}


@pytest.mark.parametrize("k", range(6))
def test_tags_of_every_format_and_byte_order(k):
    got = image_bytes.metadata(media_files.image(TAGS, k))
    assert {name: got[name] for name in TAGS} == TAGS
    assert (got["width"], got["height"]) == (100 + k, 50 + k)


def hostile(read, whole):
    """Every way to cut a file short, and many to spoil it: a result or an error, never a crash."""
    rng = random.Random(1)
    for n in range(0, len(whole), max(1, len(whole) // 300)):
        read(whole[:n])
    for _ in range(300):
        spoilt = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            spoilt[rng.randrange(min(len(spoilt), 400))] = rng.choice([0, 255, rng.randrange(256)])
        read(bytes(spoilt))


@pytest.mark.parametrize("k", range(6))
def test_broken_images(k):
    hostile(image_bytes.metadata, media_files.image(TAGS, k))
    assert set(image_bytes.metadata(media_files.jpeg(3, 4)[:30])) == {"error"}
    for nothing in (None, b"", b"text", b"RIFF1234WAVE"):
        assert set(image_bytes.metadata(nothing)) == {"error"}
    assert image_bytes.metadata(media_files.jpeg(3, 4, b"II*\0\xff\xff\xff\xff")) == {"format": "JPEG", "width": 3, "height": 4}


SAID = {"title": "Größe 東京", "artist": "A", "album": "B", "year": "1999", "genre": "Rock", "track": "3/12", "seconds": 3725}


@pytest.mark.parametrize("k", range(5))
def test_tags_of_every_audio_format(k):
    got = audio_bytes.metadata(media_files.audio(SAID, k))
    assert {n: got[n] for n in SAID if n != "seconds"} == {n: v for n, v in SAID.items() if n != "seconds"}
    assert 3725 <= got["seconds"] < 3725.03 and got["channels"] == 2 and got["sample_rate"] == (48000 if k in (0, 4) else 44100)


@pytest.mark.parametrize("k", range(5))
def test_broken_audio(k):
    hostile(audio_bytes.metadata, media_files.audio(SAID, k))
    for nothing in (None, b"", b"just text", b"ID3\x04\0\0\0\0\0\0"):
        assert set(audio_bytes.metadata(nothing)) == {"error"}


def test_hand_made_audio():
    # 44.1 kHz, 128 kbit/s, mono, no tags but a trailing block: 417 bytes a frame
    frame = bytes.fromhex("fffb90c0").ljust(417, b"\0")
    got = audio_bytes.metadata(frame * 10 + b"TAG" + b"Old title".ljust(30, b"\0") + b"Singer".ljust(30, b"\0") + b"Record".ljust(30, b" ") + b"1987" + bytes(28) + b"\0\x07" + b"\x11")
    assert got == {"format": "MP3", "title": "Old title", "artist": "Singer", "album": "Record", "year": "1987", "track": "7", "seconds": round(4170 * 8 / 128000, 2), "sample_rate": 44100, "channels": 1, "bitrate": 128000}
    # ID3v2.2 with three-letter frames, Latin-1
    v22 = b"ID3\x02\0\0\0\0\0\x18" + b"TT2\0\0\x06\0\xc4bcde" + b"TP1\0\0\x06\0Band\0"
    assert {k: v for k, v in audio_bytes.metadata(v22 + frame * 3).items() if k in ("title", "artist")} == {"title": "Äbcde", "artist": "Band"}
    # ID3v2.3, unsynchronised: FF 00 stands for FF
    body = b"TIT2\0\0\0\x05\0\0\x01\xff\x00\xfeA\0"
    v23 = b"ID3\x03\0\x80" + bytes([0, 0, 0, len(body)]) + body
    assert audio_bytes.metadata(v23 + frame * 3)["title"] == "A"
    wave = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"LIST" + struct.pack("<I", 18) + b"INFOINAM" + struct.pack("<I", 5) + b"Song\0\0" + b"data" + struct.pack("<I", 64000)
    assert audio_bytes.metadata(wave) == {"format": "WAV", "title": "Song", "seconds": 2.0, "sample_rate": 8000, "channels": 2, "bitrate": 256000}
    form = b"FORM\0\0\0\0AIFFCOMM" + struct.pack(">IhIh", 18, 1, 22050, 16) + bytes.fromhex("400eac44000000000000") + b"NAME" + struct.pack(">I", 4) + b"Tune"
    assert audio_bytes.metadata(form) == {"format": "AIFF", "title": "Tune", "seconds": 0.5, "sample_rate": 44100, "channels": 1, "bitrate": 705600}
    opus = b"".join(b"OggS\0\0" + struct.pack("<qIII", pos, 1, i, 0) + bytes([1, len(p)]) + p for i, (pos, p) in enumerate([(0, b"OpusHead\x01\x01" + struct.pack("<HI", 312, 48000) + b"\0\0\0"), (0, b"OpusTags" + media_files.comments({"title": "T"})), (96312, b"z")]))
    assert audio_bytes.metadata(opus) == {"format": "OGG", "title": "T", "seconds": 2.0, "sample_rate": 48000, "channels": 1}


def test_folders(spark, tmp_path):
    files = {"a.JPG": JPEG, "sub/b.png": media_files.png(2, 3), "c.tiff": b"II*\0", "d.mp3": media_files.mp3({"title": "x"}, 9), "sub/e.flac": b"fLaC", "f.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in image_bytes.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.JPG", "b.png", "c.tiff"}
    assert (rows["a.JPG"]["make"], rows["a.JPG"]["size_bytes"], rows["a.JPG"]["file_hash"]) == ("Canon", len(JPEG), hashlib.md5(JPEG).hexdigest())
    assert rows["c.tiff"]["error"] and rows["c.tiff"]["format"] is None and rows["b.png"]["error"] is None
    songs = {r["path"].rsplit("/", 1)[1]: r for r in audio_bytes.read(spark, str(tmp_path)).collect()}
    assert (songs["d.mp3"]["title"], songs["e.flac"]["format"]) == ("x", None) and songs["e.flac"]["error"]
    more = spark.createDataFrame([(1, bytearray(JPEG), "kept")], "id int, content binary, make string").withColumn("extra", F.lit(4))
    got = image_bytes.described(more).first()
    assert (got["id"], got["make"], got["extra"]) == (1, "Canon", 4)
    assert image_bytes.described(more.limit(0)).count() == audio_bytes.described(more.limit(0)).count() == 0
