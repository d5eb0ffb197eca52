"""Chunkers: paragraphs, packed sentences, merged small chunks, code elements, line blocks, words.

Paragraphs and line blocks are native. The folds (a chunk depends on the one before it) run over Arrow batches,
a document at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 1.3
PARAGRAPH = r"(?m)\n\n+|(?=^#{1,6}\s)"


def kind(part: Column) -> Column:
    return F.when(part.startswith("#"), "header").when(part.startswith("```"), "code_block").when(part.rlike(r"^(?:- |\* |\d+\.)"), "list").otherwise("paragraph")


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row per paragraph of docs (file_id, content): stripped, typed, with running offsets of length + 2."""
    parts = F.filter(F.transform(F.split("content", PARAGRAPH), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate("parts", start, lambda a, p: F.struct((a["at"] + F.length(p) + 2).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    rows = docs.select("file_id", parts.alias("parts")).select("file_id", F.posexplode(F.arrays_zip(F.col("parts"), offsets.alias("start"))).alias("chunk_index", "c"))
    return rows.select("file_id", "chunk_index", F.col("c.parts").alias("content"), kind(F.col("c.parts")).alias("chunk_type"), F.col("c.start").alias("start_char"), (F.col("c.start") + F.length("c.parts")).alias("end_char"))


def line_blocks(docs: DataFrame, lines: int = 100) -> DataFrame:
    """Blocks of lines of docs (file_id, content)."""
    all_lines = F.split("content", "\n")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_lines) - 1, F.lit(0)), F.lit(lines)), lambda i: F.array_join(F.slice(all_lines, i + 1, F.lit(lines)), "\n"))
    return docs.select("file_id", F.posexplode(blocks).alias("chunk_index", "content"))


def code_elements(docs: DataFrame) -> DataFrame:
    """A chunk per element of docs (file_id, content, elements: array of element_type, line_start, line_end), in order."""
    rows = docs.select("file_id", F.split("content", "\n").alias("lines"), F.posexplode("elements").alias("chunk_index", "e"))
    return rows.select("file_id", "chunk_index", F.array_join(F.slice("lines", F.col("e.line_start"), F.col("e.line_end") - F.col("e.line_start") + 1), "\n").alias("content"), F.concat(F.lit("code_"), "e.element_type").alias("chunk_type"))


def count(text: str) -> int:
    return len(text.split())


def tokens(words: int) -> int:
    return int(words * RATIO)


#: A chunk in the making: text, kind, first and last character (from 0, end exclusive; approximate, as blank lines count two), tokens.
Piece = tuple[str, str, int, int, int]


def split_paragraphs(text: str) -> list[Piece]:
    out, at = [], 0
    for part in re.split(r"(?m)\n\n+|(?=^#{1,6}\s)", text):  # fixed value: where paragraphs end
        if part := part.strip():
            out.append((part, label(part), at, at + len(part), tokens(count(part))))
            at += len(part) + 2
    return out


def pack_sentences(piece: Piece, target: int, most: int) -> list[Piece]:
    """The sentences of a piece of over most words, packed up to target words; a chunk of over two lends its last two to the next."""
    text, name, start, *_ = piece
    if count(text) <= most:
        return [piece]
    out: list[Piece] = []
    now: list[str] = []
    words = 0

    def close(content: str) -> None:
        out.append((content, name, start, start + len(content), tokens(words)))

    for sentence in re.split(r"(?<=[.!?])\s+", text):  # fixed value: where sentences end
        n = count(sentence)
        if now and words + n > target:
            close(content := " ".join(now))
            now = now[-2:] if len(now) > 2 else []
            start += len(content) - sum(map(len, now))
            words = sum(map(count, now))
        now.append(sentence)
        words += n
    if now:
        close(" ".join(now))
    return out


def merge_small(pieces: list[Piece], least: int) -> list[Piece]:
    """A piece of under least words takes in the next one and keeps its kind; tokens add up; the tail stays as it is."""
    out: list[Piece] = []
    for p in pieces:
        if out and count(out[-1][0]) < least:
            was = out[-1]
            out[-1] = (f"{was[0]}\n\n{p[0]}", was[1], was[2], p[3], was[4] + p[4])
        else:
            out.append(p)
    return out


def label(part: str) -> str:
    return "header" if part.startswith("#") else "code_block" if part.startswith("```") else "list" if re.match(r"- |\* |\d+\.", part) else "paragraph"


CHUNK = {"file_id": pa.int64(), "chunk_index": pa.int32(), "content": pa.string(), "chunk_type": pa.string(), "start_char": pa.int32(), "end_char": pa.int32(), "token_count": pa.int32()}
SCHEMA = "file_id long, chunk_index int, content string, chunk_type string, start_char int, end_char int, token_count int"


def by_document(docs: DataFrame, pieces_of: Callable[[str], list[Piece]]) -> DataFrame:
    """Chunks of docs (file_id, content) by a function of a text; a batch of documents at a time, a document by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, text in zip(b.column("file_id").to_pylist(), b.column("content")):
                rows = [(file_id, i, *p) for i, p in enumerate(pieces_of(text.as_py() or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNK.values())], list(CHUNK))

    return docs.select("file_id", "content").mapInArrow(run, SCHEMA)


def sentence_chunks(docs: DataFrame, target_tokens: int = 500, most_tokens: int = 1000) -> DataFrame:
    """Each text of docs as one piece, packed by sentences if it is long; blank texts give none."""
    target, most = int(target_tokens / RATIO), int(most_tokens / RATIO)
    whole = lambda t: [(t.strip(), label(t.strip()), 0, len(t.strip()), tokens(count(t)))] if t.strip() else []
    return by_document(docs, lambda t: [q for p in whole(t) for q in pack_sentences(p, target, most)])


def merged_paragraphs(docs: DataFrame, target_tokens: int = 500) -> DataFrame:
    """Paragraphs with the small ones merged, long ones left whole."""
    least = int(target_tokens / RATIO) // 4
    return by_document(docs, lambda t: merge_small(split_paragraphs(t), least))


def chunk_text(docs: DataFrame, target_tokens: int = 500, most_tokens: int = 1000) -> DataFrame:
    """Text chunks of docs (file_id, content): paragraphs, long ones packed by sentences, small ones merged; blank texts give none."""
    target, most = int(target_tokens / RATIO), int(most_tokens / RATIO)
    return by_document(docs, lambda t: merge_small([q for p in split_paragraphs(t) for q in pack_sentences(p, target, most)], target // 4))


def chunk_file(docs: DataFrame) -> DataFrame:
    """Chunks of files (file_id, content, elements): by code element where there are any, else by text."""
    code = F.size(F.coalesce("elements", F.array())) > 0
    columns = ["file_id", "chunk_index", "content", "chunk_type"]
    return code_elements(docs.filter(code)).select(columns).union(chunk_text(docs.filter(~code)).select(columns))


def chunk_words(docs: DataFrame, chars: int = 1000) -> DataFrame:
    """Words added until their lengths, each with a blank, reach chars: a native fold that notes where chunks end."""
    words = F.filter(F.split(F.coalesce("content", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("ends"))

    def step(a: Column, w: Column) -> Column:
        size = a["size"] + F.length(w) + 1
        full = size >= chars
        return F.struct(F.when(full, 0).otherwise(size).alias("size"), (a["at"] + 1).alias("at"), F.when(full, F.concat(a["ends"], F.array(a["at"] + 1))).otherwise(a["ends"]).alias("ends"))

    rows = docs.select("file_id", words.alias("words")).withColumn("ends", F.aggregate("words", start, step, lambda a: F.array_distinct(F.concat(a["ends"], F.array(a["at"])))))
    spans = F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.filter(F.size("words") > 0).select("file_id", "words", F.posexplode(spans).alias("chunk_index", "s"))
    return rows.select("file_id", "chunk_index", F.array_join(F.slice("words", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")), " ").alias("content"), (F.col("s.b") - F.col("s.a")).alias("word_count"))
